"""Operator 3, repeated passages by sparse suffix arrays.

Suffixes are kept only where a word position is chosen by content: the smallest k-gram hash of each window of
consecutive k-grams (minimisers). Two texts that share MIN_WORDS words share a window, hence a kept suffix.
Kept suffixes whose k-gram occurs once are dropped; the rest are sorted as two distributed suffix arrays, by the words
to the right and by the words to the left (range partitions on the suffix itself, so a suffix in a third of all texts
is spread over tasks), compared with their neighbours of other texts in both, and matches are extended to the left
and to the right. A match spans at most one window to either side of its suffix; the spans of a longer passage
overlap and are merged.

The neighbours of both orders bound how many words any other text can share to either side. Where the bounds leave
open whether a text further away shares both sides (or a neighbour lies in another partition), the windows of MIN_WORDS
words in question are hashed in the suffixes of that k-gram and equal hashes of two texts decide, so results are complete.
Suffixes with the same words all around hold the same windows: those of two texts stand for all of them.

Texts with equal word sequences are one text here; each of their documents is repeated as a whole.

Defined results: words are compared without regard to ASCII case; repeats inside one text do not count. Null, empty
and short texts have no passages. Rows without a doc_id are ignored, repeated rows are one document. Extra
columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfcast.llm.words import Words, mix, text_slices
from shelfcast.session import written_table

MIN_WORDS = 50
GRAM_WORDS = 12
WINDOW = MIN_WORDS - GRAM_WORDS + 1  # k-grams; a shared passage of MIN_WORDS words holds one whole window
REACH = WINDOW - 1  # words carried on either side of a k-gram
CHUNK_ROWS = 20_000


def minimisers(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the smallest hash of some window of consecutive k-grams; ascending."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    # Sliding minimum by doubling, then the sliding maximum of the minima of all windows over a position.
    low, width = grams, 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    high, width = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)]), 1
    while width < window:
        step = min(width, window - width)
        high = np.maximum(high[:-step], high[step:])
        width += step
    return np.flatnonzero(high == grams)


def _sequence_key(hashes: np.ndarray) -> int:
    place = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
    return int(mix(np.array([(mix(hashes) * (place | np.uint64(1))).sum(dtype=np.uint64)]) + np.uint64(len(hashes))).view(np.int64)[0])


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, word hashes) of each text."""
    for batch in batches:
        for first, _, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets)
            for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                yield batch, first + i, words.hashes[a:b]


def _grams(words: np.ndarray) -> np.ndarray:
    total = np.zeros(max(0, len(words) - GRAM_WORDS + 1), np.uint64)
    for j in range(GRAM_WORDS):
        total += mix(words[j : j + len(total)] + np.uint64(j))
    return mix(total)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text one row (doc_id, key, n_words) with place -1, and one row per kept suffix."""
    docs, keys, sizes, grams, places = [], [], [], [], []

    def flush() -> pa.RecordBatch:
        counts = [len(g) for g in grams]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(docs, counts).astype(np.int64)), pa.array(np.repeat(keys, counts).astype(np.int64)),
             pa.array(np.repeat(sizes, counts).astype(np.int64)), pa.array(np.concatenate(grams).view(np.int64)),
             pa.array(np.concatenate(places).astype(np.int32))],
            ["doc_id", "key", "n_words", "gram", "place"],
        )
        for x in (docs, keys, sizes, grams, places):
            x.clear()
        return out

    ids: list = []
    seen = None
    for batch, row, words in _each_text(batches):
        if batch is not seen:
            seen, ids = batch, batch.column("doc_id").to_pylist()
        if ids[row] is None or len(words) < MIN_WORDS:
            continue
        all_grams = _grams(words)
        spots = minimisers(all_grams)
        docs.append(ids[row])
        keys.append(_sequence_key(words))
        sizes.append(len(words))
        grams.append(np.r_[np.zeros(1, np.uint64), all_grams[spots]])
        places.append(np.r_[-1, spots])
        if len(docs) >= 500:
            yield flush()
    if docs:
        yield flush()


def _rows_of_bytes(values: np.ndarray) -> pa.Array:
    """Each row of 16-bit numbers as big-endian bytes, which sort like the numbers."""
    return pa.array([x.tobytes() for x in values.astype(">u2")], pa.binary())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per kept suffix: its k-gram, the words on either side of it nearest first, 16 bits of hash each, and a hash of them all."""
    last, keys, places = None, [], []
    for batch, row, words in _each_text(batches):
        if batch is not last:
            last, keys, places = batch, batch.column("key").to_pylist(), batch.column("places").to_pylist()
        if keys[row] != _sequence_key(words):  # another text under the same doc_id
            continue
        spots = np.sort(np.array(places[row], np.int64))
        edge = np.zeros(REACH, np.uint64)
        whole = np.concatenate([edge, words, edge])
        around = np.zeros(len(spots), np.uint64)
        for j in (*range(REACH), *range(REACH + GRAM_WORDS, 2 * REACH + GRAM_WORDS)):
            around += mix(whole[spots + j] + np.uint64(j))
        padded = (whole & np.uint64(0xFFFF)).astype(np.uint16)
        right = padded[spots[:, None] + REACH + GRAM_WORDS + np.arange(REACH)]
        left = padded[spots[:, None] + REACH - 1 - np.arange(REACH)]
        n = len(spots)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_grams(words)[spots].view(np.int64)),
                _rows_of_bytes(right),
                _rows_of_bytes(left),
                pa.array(np.full(n, keys[row], np.int64)),
                pa.array(spots.astype(np.int32)),
                pa.array(np.minimum(REACH, len(words) - spots - GRAM_WORDS).astype(np.int32)),
                pa.array(np.minimum(REACH, spots).astype(np.int32)),
                pa.array(mix(around).view(np.int64)),
            ],
            [c.split()[0] for c in _CONTEXT.split(", ")],
        )


_CONTEXT = "gram long, right binary, left binary, key long, place int, n_right int, n_left int, around long"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REACH)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = a == b
    return np.where(same.all(axis=1), REACH, same.argmin(axis=1))


def _bits(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
    """Numbers with the bits from lowest to highest set; 0 where there are none."""
    high, low = np.maximum(highest + 1, 0), np.clip(lowest, 0, REACH + 1)
    return np.where(highest >= lowest, (np.int64(1) << high) - (np.int64(1) << low), 0)


def match_neighbours(table: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
    """What each suffix of ``table``, sorted by the words on ``side``, has in common with other texts: (possible, found).

    Both are sets of windows of MIN_WORDS words as bits; bit l is the window that begins l words before the k-gram.
    ``found`` are those that the nearest suffix above or below of another text holds, too. As no other text can
    agree with more words on ``side`` than these two, windows that are not ``possible`` occur in no other text. Suffixes
    without such a neighbour in the table may have one elsewhere: for them all windows inside the text are possible.
    """
    gram, k = (table.column(c).to_numpy() for c in ("gram", "key"))
    n_right, n_left = (table.column(c).to_numpy().astype(np.int64) for c in ("n_right", "n_left"))
    right, left = _matrix(table.column("right").combine_chunks()), _matrix(table.column("left").combine_chunks())
    n = len(gram)
    first = np.r_[True, k[1:] != k[:-1]]
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    far, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for other in (starts[run] - 1, np.r_[starts[1:], n][run]):
        outside = (other < 0) | (other >= n)
        far[outside] = REACH
        a = np.flatnonzero(~outside)
        a = a[gram[a] == gram[other[a]]]
        b = other[a]
        r, l = _common(right[a], right[b]), _common(left[a], left[b])  # noqa: E741
        far[a] = np.maximum(far[a], r if side == "right" else l)
        r = np.minimum(r, np.minimum(n_right[a], n_right[b]))
        l = np.minimum(l, np.minimum(n_left[a], n_left[b]))  # noqa: E741
        found[a] |= _bits(REACH - r, l)
    r, l = (np.minimum(far, n_right), n_left) if side == "right" else (n_right, np.minimum(far, n_left))  # noqa: E741
    return _bits(REACH - r, l), found


_MATCH = "gram long, key long, place int, around long, possible long, found long"


def _matcher(side: str):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def result() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            possible, found = match_neighbours(table, side)
            kept = np.flatnonzero(possible)
            suffix = [table.column(c).combine_chunks().take(pa.array(kept)) for c in ("gram", "key", "place", "around")]
            return pa.RecordBatch.from_arrays([*suffix, pa.array(possible[kept]), pa.array(found[kept])], [c.split()[0] for c in _MATCH.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield result()
                held, rows = [], 0
        if held:
            yield result()

    return match


def _matched(array: DataFrame, side: str) -> DataFrame:
    """Each suffix with its possible and found windows, from its neighbours in the order of the words on one side."""
    order = ["gram", *(("right", "left") if side == "right" else ("left", "right")), "key", "place"]
    return array.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_matcher(side), _MATCH)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows asked for, by text; a window asked for from several suffixes is one."""
    last, keys, asked = None, [], []
    for batch, row, words in _each_text(batches):
        if batch is not last:
            last, keys, asked = batch, batch.column("key").to_pylist(), batch.column("asked").to_pylist()
        if keys[row] != _sequence_key(words):
            continue
        places, masks = (np.array([a[c] for a in asked[row]], np.int64) for c in ("place", "windows"))
        which, offset = np.nonzero(masks[:, None] >> np.arange(WINDOW) & 1)
        starts = np.unique(places[which] - offset)
        for part in np.array_split(starts, len(starts) // CHUNK_ROWS + 1):
            at = np.arange(MIN_WORDS)
            total = mix(words[part[:, None] + at] + at.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
            columns = [pa.array(mix(total).view(np.int64)), pa.array(np.full(len(part), keys[row], np.int64)), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["window", "key", "start"])


def _same_windows(windows: DataFrame) -> DataFrame:
    """(key, start, stop) of the windows that two texts hold."""
    ends = windows.groupBy("window").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    # Written like the repeated k-grams: few shared windows are broadcast, and of many a very common one can be split.
    held = written_table(ends.filter("lo <> hi").select("window"))
    shared = windows.join(held, "window", "left_semi")
    return shared.select("key", "start", (F.col("start") + MIN_WORDS).alias("stop"))


def _highest_bit(mask: Column) -> Column:
    return F.length(F.bin(mask)) - 1


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, whole) of every maximal passage that occurs in another document, too."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written_table(texts.mapInArrow(_suffixes, "doc_id long, key long, n_words long, gram long, place int"))
    members = rows.filter("place < 0").select("doc_id", "key", "n_words").distinct()
    classes = members.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"))
    spots = rows.filter("place >= 0").select("gram", "key", "place")
    seat = F.struct("key", "place")
    ends = spots.groupBy("gram").agg(F.min(seat).alias("lo"), F.max(seat).alias("hi"))
    # Written, so that both sides of the join have exchanges of their own and a very common k-gram can be split.
    repeated = written_table(ends.filter("lo.key <> hi.key").select("gram"))
    wanted = spots.join(repeated, "gram", "left_semi").groupBy("key").agg(F.collect_set("place").alias("places"))
    wanted = wanted.join(classes.select("key", "doc_id"), "key")
    one = texts.join(wanted, "doc_id").select("text", "key", "places")
    array = written_table(one.mapInArrow(_contexts, _CONTEXT))
    both = _matched(array, "right").withColumn("sides", F.lit(1)).unionByName(_matched(array, "left").withColumn("sides", F.lit(2)))
    both = both.groupBy("gram", "key", "place", "around").agg(
        F.bit_and("possible").alias("possible"), F.bit_or("found").alias("found"), F.bit_or("sides").alias("sides")
    )
    suffixes = written_table(both.filter("sides = 3 and possible <> 0").drop("sides"))
    # All windows of a suffix hold its k-gram, so those found are one span.
    found, lowest = F.col("found"), F.col("found").bitwiseAND(-F.col("found"))
    spans = suffixes.filter("found <> 0").select(
        "key",
        (F.col("place") - _highest_bit(found)).alias("start"),
        (F.col("place") - _highest_bit(lowest) + MIN_WORDS).alias("stop"),
    )
    # Whether another text holds a window that no neighbour does is open, unless the spans of its text hold it anyway:
    # compare the hashes of such windows.
    undecided = written_table(_open_windows(suffixes, _islands(spans)))
    grams = written_table(undecided.groupBy("gram").agg(F.bit_or("open").alias("open")))
    asked = _holders(suffixes, grams).unionByName(undecided.select("key", "place", F.col("open").alias("windows")))
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("place", "windows")).alias("asked"))
    asked = asked.join(classes.select("key", "doc_id"), "key")
    again = texts.join(asked, "doc_id").select("text", "key", "asked")
    windows = written_table(again.mapInArrow(_windows, "window long, key long, start int"))
    return _merged(spans.unionByName(_same_windows(windows)), members, classes)


def _islands(spans: DataFrame) -> DataFrame:
    """(key, start_word, end_word): spans of each text, merged where they touch."""
    seen = Window.partitionBy("key").orderBy("start", F.desc("stop"))
    before = F.max("stop").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= before, 0).otherwise(1)
    islands = spans.distinct().withColumn("new", new).withColumn("island", F.sum("new").over(seen))
    return islands.groupBy("key", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word")).drop("island")


def _holders(suffixes: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, place, windows) of suffixes that may hold an open window of their k-gram; two texts for each context.

    A text that shares a window has it found, inside an island or open itself; for the others it is enough to know two of the
    texts that hold it.
    """
    seat = F.struct("key", "place")
    contexts = suffixes.groupBy("gram", "around").agg(F.min(seat).alias("lo"), F.max(seat).alias("hi"), F.bit_or("possible").alias("possible"))
    held = contexts.join(grams, "gram").withColumn("windows", F.expr("possible & open")).filter("windows <> 0")
    seats = F.when(F.col("lo.key") == F.col("hi.key"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return held.select(F.explode(seats).alias("seat"), "windows").select("seat.key", "seat.place", "windows")


def _open_windows(suffixes: DataFrame, islands: DataFrame) -> DataFrame:
    """(gram, key, place, open) of suffixes with windows that are possible, not found and not inside an island of their text."""
    rows = suffixes.select("gram", "key", "place", F.expr("possible & ~found").alias("open"), F.lit(None).cast("int").alias("stop")).filter("open <> 0")
    marks = islands.select(
        F.lit(None).cast("long").alias("gram"), "key", F.col("start_word").alias("place"), F.lit(0).cast("long").alias("open"), F.col("end_word").alias("stop")
    )
    # Islands are disjoint and a window holds its k-gram, so only the last island that begins at or before it counts.
    so_far = Window.partitionBy("key").orderBy("place", "open").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("gram").isNull(), F.struct(F.col("place").alias("start"), "stop")), ignorenulls=True).over(so_far)
    both = rows.unionByName(marks).withColumn("last", last).filter("gram is not null")
    both = both.withColumns({"lo": F.expr(f"greatest(place + {MIN_WORDS} - last.stop, 0)"), "hi": F.expr(f"least(place - last.start, {REACH})")})
    inside = F.expr("case when last is not null and hi >= lo then shiftleft(1L, hi + 1) - shiftleft(1L, lo) else 0L end")
    left = F.col("open").bitwiseAND(F.bitwise_not(inside))
    return both.select("gram", "key", "place", left.alias("open")).filter("open <> 0")


def _merged(spans: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    merged = _islands(spans)
    single = classes.filter("n_docs = 1").select("key", "doc_id")
    parts = merged.join(single, "key").select(
        "doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), F.lit(False).alias("whole")
    )
    copies = members.join(classes.filter("n_docs > 1").select("key"), "key", "left_semi").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.lit(True).alias("whole")
    )
    return parts.unionByName(copies)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
