"""Operator 8, benchmark decontamination by spaced-seed hashing.

Fixed masks hash some words of a window and ignore the others, so a changed word spoils only the seeds that look at
it. Seeds of texts are joined with seeds of the benchmark; around each hit the aligned words are compared, and a text
is contaminated where OVERLAP_WORDS aligned words (the whole item, if shorter) agree in PERCENT of them. The masks
find every such window with at most two changed words. Shorter items have masks of their own length, each ignoring as
many groups of words as may change, so they too are found with every allowed change.

Texts are scanned once. A bitmap of the benchmark's seeds, of bounded size, rules out nearly all positions inside the
tasks; what passes is joined exactly. A larger benchmark fills the bitmap more and sends more to the join, never less.

Defined results: words are compared without regard to ASCII case. Items of fewer than MIN_ITEM_WORDS words, null and empty
texts contaminate nothing and are never contaminated. Rows without a doc_id are not reported. Repeated rows
count once. Extra columns are ignored; an empty documents or benchmark table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import Words, mix, text_slices
from shelfcast.session import written_table

# Fixed masks: 1 reads a word, 0 ignores it. Together they hit every 13 words with two of them changed.
MASKS = ["1101111", "110010111"]
OVERLAP_WORDS = 13
PERCENT = 80
MIN_ITEM_WORDS = 5
MAX_BITMAP_BITS = 1 << 27  # 16 MB, whatever the benchmark's size
_BITS_PER_SEED = 64
_LEAST_BITS = 1 << 16

_PROBES = 4
_SHORT = range(MIN_ITEM_WORDS, OVERLAP_WORDS)  # items of so many words have masks of their own
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def short_masks(n: int) -> list[str]:
    """Masks for an item of n words of which m may change: of m + 2 groups of words each ignores another m."""
    changes = n - -(-PERCENT * n // 100)
    groups = changes + 2
    return ["".join("0" if i % groups in ignored else "1" for i in range(n)) for ignored in combinations(range(groups), changes)]


def _all_masks(lengths: list[int]) -> list[str]:
    return [*MASKS, *(mask for n in lengths for mask in short_masks(n))]


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words from each position on that has room for the mask."""
    total = np.zeros(max(0, len(words) - len(mask) + 1), np.uint64)
    for j, read in enumerate(mask):
        if read == "1":
            total += words[j : j + len(total)] * _PLACE[j]
    return mix(total + np.uint64(int(mask, 2)))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("item").to_pylist()
        for first, _, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets)
            for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                own = words.hashes[a:b]
                masks = short_masks(len(own)) if len(own) in _SHORT else MASKS if len(own) >= MIN_ITEM_WORDS else []
                hashes = [_seeds(own, m) for m in masks]
                if not hashes:
                    continue
                n = sum(map(len, hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, keys[first + i], np.int64)), pa.array(np.full(n, len(own), np.int32)),
                     pa.array(np.concatenate(hashes).view(np.int64)),
                     pa.array(np.concatenate([np.arange(len(h)) for h in hashes]).astype(np.int32))],
                    ["item", "n_item", "seed", "item_place"],
                )


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets)
            rows = [words.hashes[a:b].tobytes() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(first, end - first), pa.array(rows, pa.binary())], ["item", "item_words"]
            )


def _bit_places(seeds: np.ndarray, n_bits: int, probe: int) -> np.ndarray:
    return ((seeds & np.uint64(n_bits - 1)) + np.uint64(probe) * (seeds >> np.uint64(34) | np.uint64(1))) & np.uint64(n_bits - 1)


def seed_bitmap(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """_PROBES bits per seed in a bitmap of at most MAX_BITMAP_BITS, and the lengths of the short items.

    The driver receives words of the bitmap, already combined, so its share is bounded by the bitmap's size.
    """
    n = max(1, seeds.count())
    n_bits = int(min(MAX_BITMAP_BITS, max(_LEAST_BITS, 1 << int(n * _BITS_PER_SEED - 1).bit_length())))
    mask = F.lit(n_bits - 1)
    first, step = F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 34).bitwiseOR(F.lit(1))
    probes = F.array(*[(first + k * step).bitwiseAND(mask) for k in range(_PROBES)])
    bits = seeds.select(F.explode(probes).alias("bit"))
    packed = bits.groupBy(F.shiftright("bit", 5).alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("value")
    )
    found = packed.toArrow()
    bitmap = np.zeros(n_bits // 32, np.uint32)
    bitmap[found.column("place").to_numpy()] = found.column("value").to_numpy().astype(np.uint32)
    lengths = seeds.filter(F.col("n_item") < _SHORT.stop).select("n_item").distinct().collect()
    return bitmap, sorted(row["n_item"] for row in lengths)


_HITS = "doc_id long, seeds binary, places binary, words binary"


def _scanner(shared, lengths: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        n_bits = len(bitmap) * 32
        masks = _all_masks(lengths)

        def kept(seeds: np.ndarray) -> np.ndarray:
            spots = None
            for probe in range(_PROBES):
                at = _bit_places(seeds if spots is None else seeds[spots], n_bits, probe)
                hit = np.flatnonzero((bitmap[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                spots = hit if spots is None else spots[hit]
            return spots

        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                seeds, places = [], []
                for mask in masks:
                    hashes = _seeds(words.hashes, mask)
                    spots = kept(hashes)
                    # A seed must not reach over the end of its text.
                    text = np.searchsorted(words.bounds, spots, side="right") - 1
                    spots = spots[spots + len(mask) <= words.bounds[text + 1]]
                    seeds.append(hashes[spots])
                    places.append(spots)
                seeds, places = np.concatenate(seeds), np.concatenate(places)
                text = np.searchsorted(words.bounds, places, side="right") - 1
                order = np.argsort(text, kind="stable")
                seeds, places, text = seeds[order], places[order], text[order]
                own = np.unique(text)
                cuts = np.searchsorted(text, np.r_[own, end - first])
                rows = ([], [], [], [])
                for t, a, b in zip(own.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    doc_id = ids[first + t].as_py()
                    if doc_id is None:
                        continue
                    base = words.bounds[t]
                    rows[0].append(doc_id)
                    rows[1].append(seeds[a:b].tobytes())
                    rows[2].append((places[a:b] - base).astype(np.int32).tobytes())
                    rows[3].append(words.hashes[base : words.bounds[t + 1]].tobytes())
                types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "seeds", "places", "words"]
                )

    return scan


def _hit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seeds = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("seeds")]
        places = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column("places")]
        size = [len(s) for s in seeds]
        docs = np.repeat(batch.column("text_key").to_numpy(), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(np.concatenate([np.zeros(0, np.int64), *seeds])),
             pa.array(np.concatenate([np.zeros(0, np.int32), *places]))],
            ["text_key", "seed", "place"],
        )


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(most equal words, where in the text) of the windows with the item's word j at the text's word shift + j."""
    size = min(OVERLAP_WORDS, len(item))
    a, b = max(0, shift), min(len(doc), shift + len(item))
    if b - a < size:
        return 0, a
    total = np.r_[0, np.cumsum(doc[a:b] == item[a - shift : b - shift])]
    equal = total[size:] - total[:-size]
    return int(equal.max()), a + int(equal.argmax())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [], [])
        columns = (batch.column(c) for c in ("doc_id", "item", "shifts", "words", "item_words"))
        for doc_id, key, shifts, doc, item in zip(*columns):
            words, own = np.frombuffer(doc.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64)
            equal, place = max((best_overlap(words, own, s) for s in shifts.as_py()), key=lambda x: (x[0], -x[1]))
            size = min(OVERLAP_WORDS, len(own))
            if 100 * equal >= PERCENT * size:
                for column, value in zip(out, (doc_id.as_py(), key.as_py(), place, equal, size)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item", "place", "n_equal", "n_window"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, place, n_equal, n_window): the best window of each text and each item found in it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(
        F.col("item_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("item")
    ).filter("text is not null")
    distinct = items.dropDuplicates(["item"]).select("item", "text")
    seeds = written_table(distinct.mapInArrow(_item_seeds, "item long, n_item int, seed long, item_place int"))
    bitmap, lengths = seed_bitmap(seeds)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    hits = texts.mapInArrow(_scanner(shared, lengths), _HITS).withColumn("text_key", F.xxhash64("doc_id", "words"))
    hits = written_table(hits)
    met = hits.select("text_key", "seeds", "places").mapInArrow(_hit_rows, "text_key long, seed long, place int")
    aligned = met.join(seeds.select("item", "seed", "item_place"), "seed").select(
        "text_key", "item", (F.col("place") - F.col("item_place")).alias("shift")
    )
    aligned = aligned.groupBy("text_key", "item").agg(F.collect_set("shift").alias("shifts"))
    words = distinct.mapInArrow(_item_words, "item long, item_words binary")
    pairs = aligned.join(words, "item").join(hits.select("text_key", "doc_id", "words"), "text_key")
    found = pairs.select("doc_id", "item", "shifts", "words", "item_words").mapInArrow(
        _verified, "doc_id long, item long, place long, n_equal long, n_window long"
    )
    named = found.join(items.select("item", "item_id"), "item").drop("item")
    return named.distinct().select("doc_id", "item_id", "place", "n_equal", "n_window")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
