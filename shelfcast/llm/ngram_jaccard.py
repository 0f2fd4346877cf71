"""Operator 5, n-gram Jaccard join by vertical partitioning.

All n-grams have one global order, rare ones first. The order is cut into fragments; each document's sorted
set falls into one segment per fragment. Overlaps are counted within each fragment separately and summed per
pair. Pairs to count come from the first n-grams of the order alone: two sets that reach the threshold share
one of their first n - ceil(t n) + 1 n-grams.

Links between documents of one component change nothing, so pairs are proposed in rounds: first between each
document and a few centres of its rare n-grams, last between all documents of different components that share a
rare n-gram. Documents with equal sets are one node throughout.

Defined results: null and empty texts and texts without words have no set and link with nothing. Rows that
share a doc_id are one document with several texts. Rows without a doc_id get no component. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfcast.llm.components import connected_components
from shelfcast.llm.shared_keys import unique_key_counts
from shelfcast.llm.words import SHINGLE_WORDS, Words, text_slices
from shelfcast.session import written_table

PERCENT = 80
FRAGMENTS = 4
CENTRE_ROUNDS = 4


def _sets_of_texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column("doc_id")
    for first, end, data, offsets in text_slices(batch.column("text")):
        yield from zip(ids.slice(first, end - first).to_pylist(), Words(data, offsets).shingles())


def _sets_of_bytes(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    for set_id, grams in zip(batch.column("id").to_pylist(), batch.column("grams")):
        yield set_id, np.frombuffer(grams.as_buffer(), np.uint64)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, grams = [], [], []
        for set_id, values in _sets_of_texts(batch):
            ids.append(set_id)
            sizes.append(len(values))
            grams.append(values.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(grams, pa.binary())], ["id", "n", "grams"]
        )


def _as_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            values = [np.frombuffer(g.as_buffer(), np.int64) for g in part.column("grams")]
            size = np.array([len(v) for v in values], np.int64)
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), size)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(size, size)), pa.array(flat)], ["id", "n", "gram"])


def _reach(n: Column, percent: int) -> Column:
    """n-grams of a set of ``n`` that may differ from a linked set: n - ceil(percent n / 100)."""
    return n - F.ceil(n * F.lit(percent) / F.lit(100))


def _candidates_only(sets: DataFrame, sets_of, n_keys: int, percent: int) -> DataFrame:
    """Ids of the sets that may link with a different set: few enough of their n-grams are unique."""
    counted = unique_key_counts(sets, sets_of, n_keys)
    return counted.filter(F.col("n_unique") <= _reach(F.col("size"), percent)).select("id")


def _segments(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Vertical partitions of ``sets`` (id, n, grams).

    Returns (id, n, fragment, grams) and the postings (gram, id, n, place, alone) of the first n-grams. N-grams of one set
    only are first in the order and can neither overlap nor propose; they count as places.
    """
    rows = written_table(sets.mapInArrow(_as_longs, "id long, n long, gram long"))
    order = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = written_table(rows.join(order, "gram"))
    rank = F.struct("df", "gram")
    cuts = ranked.select(
        F.percentile_approx("df", [(i + 1) / FRAGMENTS for i in range(FRAGMENTS - 1)], 1000).alias("cuts")
    ).first()["cuts"] or []
    fragment: Column = F.lit(0)
    for cut in sorted(set(cuts)):
        fragment = fragment + (F.col("df") > cut).cast("int")
    segments = ranked.groupBy("id", "n", fragment.alias("fragment")).agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    shared = Window.partitionBy("id")
    placed = ranked.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(shared)).withColumn(
        "place", F.row_number().over(shared.orderBy(rank)) + F.col("alone")
    )
    postings = placed.filter(F.col("place") <= _reach(F.col("n"), percent) + 1).select("gram", "id", "n", "place", "alone")
    return written_table(segments), written_table(postings)


def _long_enough(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def count_overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b): overlaps counted per fragment, summed per pair, exact against the threshold."""
    left = segments.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap")
    )
    total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return total.filter(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent).select("a", "b")


def _centre_pairs(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each document with one centre per rare n-gram, where that lies in another component.

    First the centre is the document with the fewest n-grams of its own, the likely origin of a group; later any.
    Documents of one length class are compared with a centre of that class or the next, as others cannot link.
    """
    width = float(np.log(100 / percent))
    cell = F.floor(F.log(F.col("n")) / F.lit(width))
    near = postings.withColumn("cell", cell)
    first = F.struct(F.lit(0) if turn else F.col("alone"), F.xxhash64("id", F.lit(turn)), "id", "n", "label")
    centre = near.groupBy("gram", "cell").agg(F.min(first).alias("c"))
    centre = centre.select("gram", "cell", F.col("c.id").alias("a"), F.col("c.n").alias("n_a"), F.col("c.label").alias("label_a"))
    spots = near.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
    pairs = spots.join(centre, ["gram", "cell"]).filter(F.col("label") != F.col("label_a")).filter(_long_enough("n", "n_a", percent))
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Every pair from different components that shares a first n-gram and can still reach the threshold."""
    right = postings.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "place", "label")])
    n, m = F.col("n"), F.col("n_b")
    need = F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))
    most = 1 + F.least(n - F.col("place"), m - F.col("place_b"))
    pairs = postings.join(right, "gram").filter("id < id_b and label <> label_b").filter(_long_enough("n", "n_b", percent))
    return pairs.filter(most >= need).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def _open_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of the n-grams that still join different components."""
    labelled = postings.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("component", "id")
    )
    open_grams = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    return written_table(labelled.join(open_grams.select("gram"), "gram").select("gram", "id", "n", "place", "alone", "label"))


def similar_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect the different ``sets`` (id, n, grams) of each component; spanning, not all links."""
    segments, postings = _segments(sets, percent)
    links = sets.sparkSession.createDataFrame([], "a long, b long")
    turn, n_links = 0, 0
    while turn <= CENTRE_ROUNDS:
        left = _open_postings(postings, connected_components(links))
        if left.isEmpty():
            break
        pairs = _centre_pairs(left, turn, percent) if turn < CENTRE_ROUNDS else _all_pairs(left, percent)
        links = written_table(links.unionByName(count_overlaps(written_table(pairs), segments, percent)))
        before, n_links = n_links, links.count()
        # Once centres find nothing, all remaining pairs are few enough to count; they are in any case counted last.
        turn = CENTRE_ROUNDS if turn < CENTRE_ROUNDS and n_links == before else turn + 1
    return links


def ngram_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    suspects = written_table(_candidates_only(texts, _sets_of_texts, n_bytes // SHINGLE_WORDS, percent).distinct())
    near = texts.join(suspects.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = near.mapInArrow(_shingle_sets, "id long, n long, grams binary").filter("n > 0")
    sets = written_table(sets.withColumn("key", F.md5("grams")))
    classes = written_table(sets.groupBy("key").agg(F.min("id").alias("first"), F.sum("n").alias("grams_in_all")))
    member = sets.select("id", "key").join(classes, "key").select(F.col("id").alias("a"), F.col("first").alias("b"))
    # One set per class; a document with several texts may stand for several classes.
    own = sets.join(classes.select("key", F.col("first").alias("id")), ["key", "id"]).dropDuplicates(["key"])
    own = own.select(F.xxhash64("key").alias("id"), "n", "grams", F.col("id").alias("doc"))
    own = written_table(own)
    n_grams = own.select(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = _candidates_only(own, _sets_of_bytes, n_grams, percent).distinct()
    rest = written_table(own.join(rest, "id", "left_semi").select(F.col("doc"), F.col("id"), "n", "grams"))
    links = similar_components(rest.drop("doc"), percent)
    name = rest.select("id", "doc")
    found = links.join(name.select(F.col("id").alias("a"), F.col("doc").alias("x")), "a").join(
        name.select(F.col("id").alias("b"), F.col("doc").alias("y")), "b"
    )
    labels = connected_components(member.unionByName(found.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    sizes = texts.mapInArrow(_sizes, "doc_id long, n_shingles long")
    joined = sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = [], []
        for set_id, values in _sets_of_texts(batch):
            ids.append(set_id)
            sizes.append(len(values))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_shingles"])


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
