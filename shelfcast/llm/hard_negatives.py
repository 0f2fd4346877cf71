"""Operator 11, hard negatives by an inverted multi-index.

Each half of the vectors has a codebook; a row lies in the cell of its two nearest codewords. For an anchor, the score
of a row is at most the sum over both halves of (codeword score + length of the anchor's half * radius of the codeword).
A heap pops cells in falling order of that sum, and an anchor is done once no cell left can reach what it still needs:
its fifth best positive, then, for each positive, the third best negative of its score window. So results are exact,
whatever the codebooks; how many cells an anchor visits depends on the data alone.

As a Spark job: rows of neighbouring cells are packed into blocks of about ``BLOCK_ROWS`` rows, a large cell is split into
several. A search is two rounds, a probe of the first cells and then all cells that the probe leaves open. In a round the
anchors' requests, one row per anchor and block, meet the rows by block in one shuffle, rows sorted before requests, so a
task holds one block and streams the requests; both sides may be of any size. Only the best few rows of an anchor
and block leave the task.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors
count as followed by zeros; a vector without components scores 0. Repeated rows are rows of their own: a copy of an
anchor can be its positive, and a repeated anchor repeats its results. Equal scores are ordered by id. Other columns are
ignored; an empty table gives an empty result. Components of 2^31 and more after scaling, or scores that no long holds,
raise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.session import written_table

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # a negative's score lies between these percentages of the positive's
SAMPLE_ROWS = 20_000  # rows the codebooks are fitted on, about; all rows are indexed
MAX_CODES = 64  # codewords of a half
BLOCK_ROWS = 16_384
PROBE_ROWS = 2_048
REQUESTS = 128  # requests scored together
_NONE, _ALL = -(2**62), 2**62

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _binary(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Little-endian 32-bit integers, ``counts`` of them a row, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(4 * counts)])
    buffers = [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(rows, "<i4"))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), buffers).cast(pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a binary column, filled up with zeros to ``width`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
    out = np.zeros((len(counts), width), np.int64)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch]).drop_null().combine_chunks()
        if not len(table):
            continue
        lists = table.column("vector").chunk(0)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        row = np.repeat(np.arange(len(counts)), counts)
        source = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        good = np.bincount(row, ~np.isfinite(source), len(counts)) == 0
        values, counts = values[good[row]], counts[good]
        if len(values) and np.abs(values).max() >= 2**31:
            raise ValueError("a component is too large to be scored in longs")
        peak = int(np.abs(values).max()) if len(values) else 0
        kept = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("id").combine_chunks().filter(kept),
                table.column("label").combine_chunks().filter(kept),
                _binary(values, counts),
                pa.array(counts, pa.int64()),
                pa.array(np.full(len(counts), peak), pa.int64()),
            ],
            ["id", "label", "vector", "width", "peak"],
        )


def fit_codebook(rows: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Codewords of the rows by k-means from evenly spaced rows; empty codewords keep their place."""
    rows = rows[np.lexsort(rows.T[::-1])] if rows.shape[1] else rows
    words = rows[np.linspace(0, len(rows) - 1, codes).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(rows, words)
        sums = np.zeros_like(words)
        np.add.at(sums, near, rows)
        sizes = np.bincount(near, minlength=codes)[:, None]
        words = np.where(sizes > 0, sums / np.maximum(sizes, 1), words)
    return words


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1) - 2 * rows.astype(np.float64) @ words.T).argmin(axis=1)


def falling_sums(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, first[i] + second[j]) of all pairs, largest sum first, by the multi-sequence algorithm."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -total
        for pair in ((i + 1, j), (i, j + 1)):
            if pair[0] < len(a) and pair[1] < len(b) and pair not in seen:
                seen.add(pair)
                heapq.heappush(heap, (-(first[a[pair[0]]] + second[b[pair[1]]]), *pair))


@dataclass
class MultiIndex:
    """Codebooks and radii of both halves, and the rows and blocks of each cell; at most ``MAX_CODES``^2 cells."""

    width: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    rows: dict[int, int] | None = None
    blocks: dict[int, tuple[int, int]] | None = None  # first block of a cell, and how many

    @property
    def half(self) -> int:
        return (self.width + 1) // 2

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row and its distance from both codewords."""
        near, apart = [], []
        for part, words in zip((rows[:, : self.half], rows[:, self.half :]), self.words):
            near.append(_nearest(part, words))
            apart.append(np.sqrt(((part - words[near[-1]]) ** 2).sum(axis=1)))
        return near[0] * len(self.words[1]) + near[1], *apart

    def lay_out(self, stats: list[tuple[int, int, float, float]]) -> None:
        """Take (cell, rows, largest distances) of all cells and pack neighbouring cells into blocks."""
        self.radii = tuple(np.full(len(w), -np.inf) for w in self.words)
        self.rows, self.blocks = {}, {}
        block = filled = 0
        for cell, rows, *apart in sorted(stats):
            for radii, code, far in zip(self.radii, divmod(cell, len(self.words[1])), apart):
                radii[code] = max(radii[code], far)
            if filled and filled + rows > BLOCK_ROWS:
                block, filled = block + 1, 0
            parts = -(-rows // BLOCK_ROWS)
            self.rows[cell], self.blocks[cell] = rows, (block, parts)
            block, filled = (block + parts, 0) if parts > 1 else (block, filled + rows)

    def visits(self, query: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, most, least) a row of the cell can score, cells with rows only, by falling ``most``."""
        middle, spread = [], []
        for part, words, radii in zip((query[: self.half], query[self.half :]), self.words, self.radii):
            middle.append(words @ part)
            # The allowance covers rounding: sums of doubles are exact to about 1e-15 of their terms.
            spread.append(np.sqrt(part @ part) * radii * (1 + 1e-9) + 1e-9 * (np.abs(words) @ np.abs(part)) + 1e-6)
        # A codeword without rows has the radius -inf, so all of its cells come last.
        for i, j, most in falling_sums(middle[0] + spread[0], middle[1] + spread[1]):
            cell = i * len(self.words[1]) + j
            if most == -np.inf:
                return
            if cell in self.rows:
                yield cell, most, middle[0][i] - spread[0][i] + middle[1][j] - spread[1][j]


def _requests(index: MultiIndex, probe: bool):
    """Tasks that turn anchors (with the score windows they need) into requests, one per block with cells to visit.

    A probe pops cells until they hold ``PROBE_ROWS`` rows. The second round passes over those (the heap yields the
    same cells again) and pops on until no window can be reached; cells above all windows are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), index.width).astype(np.float64)
            probed = batch.column("probed").to_pylist()
            windows = list(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()))
            picks: list[tuple[int, int, list[int]]] = []
            for row, query in enumerate(vectors):
                low, high = windows[row]
                if not low:
                    continue
                done, covered, cells = set(probed[row] or ()), 0, {}
                for cell, most, least in index.visits(query):
                    if most < min(low) or probe and covered >= PROBE_ROWS:
                        break
                    if cell in done or least > max(high):
                        continue
                    covered += index.rows[cell]
                    first, parts = index.blocks[cell]
                    for block in range(first, first + parts):
                        cells.setdefault(block, []).append(cell)
                picks += [(row, block, found) for block, found in cells.items()]
            taken = batch.select(["key", "label", "vector", "low", "high"]).take(pa.array([p[0] for p in picks], pa.int64()))
            blocks = pa.array([p[1] for p in picks], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [blocks, *taken.columns, pa.array([p[2] for p in picks], pa.list_(pa.int32()))],
                ["block", "key", "label", "vector", "low", "high", "cells"],
            )

    return scan


class _Block:
    """Rows of one block, by cell; of equal rows only as many as any answer can hold."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(batches)
        cell, label, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("cell", "label", "key"))
        rows = _matrix(table.column("vector"), width)
        _, kind = np.unique(np.column_stack([cell, label, rows]), axis=0, return_inverse=True)
        order = np.lexsort((ids, kind.ravel()))
        first = np.r_[True, np.diff(kind.ravel()[order]) != 0]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        # np.unique sorts by cell first, so the rows of a cell stay together.
        order = order[place <= POSITIVES]
        self.label, self.ids, self.rows, cell = label[order], ids[order], rows[order], cell[order]
        self.cells, starts = np.unique(cell, return_index=True)
        self.bounds = np.r_[starts, len(cell)]

    def best(self, requests: pa.RecordBatch, width: int, same: bool, keep: int, kind: type) -> list[np.ndarray]:
        """(key, window, score, id) of the ``keep`` best rows of each request and window."""
        queries, rows = _matrix(requests.column("vector"), width).astype(kind), self.rows.astype(kind)
        wanted = [np.isin(self.cells, c) for c in requests.column("cells").to_pylist()]
        wanted = np.array(wanted).reshape(len(queries), len(self.cells))
        label = requests.column("label").to_numpy()
        low, high = requests.column("low").to_pylist(), requests.column("high").to_pylist()
        least, most = np.array([min(x) for x in low]), np.array([max(x) for x in high])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(wanted.any(axis=0)).tolist():
            a, b = self.bounds[i : i + 2].tolist()
            asked = np.flatnonzero(wanted[:, i])
            score = queries[asked] @ rows[a:b].T
            fits = (score >= least[asked, None]) & (score <= most[asked, None])
            fits &= (label[asked, None] == self.label[a:b]) == same
            r, c = np.nonzero(fits)
            found.append((asked[r], score[r, c].astype(np.int64), self.ids[a:b][c]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        if not found:
            return out
        row, score, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        starts = np.searchsorted(row, np.arange(len(queries) + 1)).tolist()
        keys, picks = requests.column("key").to_numpy(), []
        for r in range(len(queries)):
            a, b = starts[r], starts[r + 1]
            for window, (lowest, highest) in enumerate(zip(low[r], high[r])):
                first = a + int(np.searchsorted(-score[a:b], -highest))
                last = min(first + keep, a + int(np.searchsorted(-score[a:b], -lowest, side="right")))
                picks += [(r, window, k) for k in range(first, last)]
        if not picks:
            return out
        r, window, k = np.array(picks, np.int64).T
        return [keys[r], window, score[k], ids[k]]


def _answers(width: int, same: bool, keep: int, kind: type):
    """Tasks over rows and requests sorted by block: hold a block, stream its requests."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, block = None, [], None
        for batch in batches:
            number, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if a == b:
                    continue
                if number[a] != at:
                    at, pieces, block = number[a], [], None
                if side[a] == 0:
                    pieces.append(batch.slice(a, b - a))
                    continue
                if block is None and pieces:
                    block, pieces = _Block(pieces, width), []
                for first in range(a, b, REQUESTS) if block else ():
                    some = batch.slice(first, min(REQUESTS, b - first))
                    arrays = [pa.array(x, pa.int64()) for x in block.best(some, width, same, keep, kind)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "window", "score", "id"])

    return scan


@dataclass
class _Search:
    """One index, searched in rounds."""

    index: MultiIndex
    rows: DataFrame  # block, cell, key, label, vector
    kind: type

    def round(self, state: DataFrame, probe: bool, same: bool, keep: int) -> DataFrame:
        """Answers (key, window, score, id) to anchors: key, label, vector, probed, low, high."""
        requests = state.select("key", "label", "vector", "probed", "low", "high").mapInArrow(
            _requests(self.index, probe),
            "block long, key long, label long, vector binary, low array<long>, high array<long>, cells array<int>",
        )
        rows = self.rows.select("block", F.lit(0).alias("side"), "cell", "key", "label", "vector")
        both = rows.unionByName(requests.withColumns({"side": F.lit(1), "cell": F.lit(-1)}), allowMissingColumns=True)
        both = both.repartition("block").sortWithinPartitions("block", "side", "cell")
        answers = both.mapInArrow(_answers(self.index.width, same, keep, self.kind), "key long, window long, score long, id long")
        return written_table(answers)

    def probed(self, state: DataFrame) -> DataFrame:
        """``state`` with the cells that a probe visits in ``probed`` and the anchor's score with itself in ``own``."""
        index = self.index

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, vectors = [], _matrix(batch.column("vector"), index.width)
                for query in vectors.astype(np.float64):
                    covered, cells = 0, []
                    for cell, *_ in index.visits(query):
                        if covered >= PROBE_ROWS:
                            break
                        covered += index.rows[cell]
                        cells.append(cell)
                    out.append(cells)
                arrays = [*batch.columns, pa.array(out, pa.list_(pa.int32())), pa.array((vectors * vectors).sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "probed", "own"])

        schema = "key long, anchor_id long, label long, vector binary, low array<long>, high array<long>, probed array<int>, own long"
        return state.mapInArrow(scan, schema)


def _best(answers: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return answers.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def _window(score: Column) -> tuple[Column, Column]:
    """Lowest and highest negative score for a positive's score, in longs only; a negative score has an empty window."""
    low, high = WINDOW
    hundreds, rest = F.call_function("div", score, F.lit(100)), score % 100
    least = hundreds * low + F.call_function("div", rest * low + 99, F.lit(100))
    most = hundreds * high + F.call_function("div", rest * high, F.lit(100))
    return F.when(score < 0, 1).otherwise(least), F.when(score < 0, 0).otherwise(most)


def build_index(rows: DataFrame) -> _Search | None:
    """Fit the codebooks on a sample of quantised rows and lay out all of them; None without rows."""
    total, width, peak = rows.agg(F.count(F.lit(1)), F.max("width"), F.max("peak")).first()
    if not total:
        return None
    if width * peak * peak >= 2**63:
        raise ValueError("scores are too large for longs")
    kind = np.float64 if width * peak * peak < 2**53 else np.int64
    some = rows
    if total > SAMPLE_ROWS:
        some = rows.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(total)) < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS)
    sample = _matrix(pa.array([bytes(r[0]) for r in some.select("vector").collect()], pa.binary()), width)
    if not len(sample):
        sample = np.zeros((1, width), np.int64)
    codes = int(min(MAX_CODES, max(2, total**0.5 / 16)))
    half = (width + 1) // 2
    index = MultiIndex(width, (fit_codebook(sample[:, :half], codes), fit_codebook(sample[:, half:], codes)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, *apart = index.cells(_matrix(batch.column("vector"), width))
            arrays = [pa.array(cell, pa.int32()), *(pa.array(x, pa.float64()) for x in apart)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "cell", "apart1", "apart2"])

    placed = rows.select(F.col("id").alias("key"), "label", "vector")
    placed = written_table(placed.mapInArrow(place, "key long, label long, vector binary, cell int, apart1 double, apart2 double"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("apart1"), F.max("apart2")).collect()
    index.lay_out([tuple(r) for r in stats])
    # At most MAX_CODES^2 rows, so the broadcast is bounded.
    blocks = rows.sparkSession.createDataFrame([(c, *b) for c, b in sorted(index.blocks.items())], "cell int, first long, parts long")
    located = placed.select("key", "label", "vector", "cell", F.col("_metadata.row_index").alias("line"))
    located = located.join(F.broadcast(blocks), "cell")
    return _Search(index, located.withColumn("block", F.col("first") + F.pmod("line", "parts")), kind)


def hard_negatives(spark: SparkSession, vectors: DataFrame, anchors: Column) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (id, label, vector) for which ``anchors`` holds.

    Positives of an anchor are its ``POSITIVES`` best other rows of its label. For each of them the ``NEGATIVES`` best
    rows of other labels whose score lies in the ``WINDOW`` of the positive's score, ranked from 1.
    """
    plain = vectors.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")
    )
    rows = written_table(plain.mapInArrow(_quantised, "id long, label long, vector binary, width long, peak long"))
    search = build_index(rows)
    if search is None:
        return spark.createDataFrame([], RESULT)
    state = rows.filter(anchors).select(
        F.monotonically_increasing_id().alias("key"), F.col("id").alias("anchor_id"), "label", "vector",
        F.array(F.lit(_NONE)).alias("low"), F.array(F.lit(_ALL)).alias("high"),
    )
    state = written_table(search.probed(state))

    # Positives: the anchor itself is among them, so one more is kept.
    keep = POSITIVES + 1
    first = search.round(state.withColumn("probed", F.lit(None).cast("array<int>")), True, True, keep)
    known = _best(first, keep).filter(F.col("place") == keep).select("key", F.col("score").alias("reached"))
    rest = state.join(known, "key", "left").withColumn("low", F.array(F.coalesce("reached", F.lit(_NONE))))
    second = search.round(rest, False, True, keep)
    # Ascending order of (-score, id) is the order of positives; one entry equal to the anchor goes.
    listed = _best(first.unionByName(second), keep).groupBy("key")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("back"), "id"))).alias("all"))
    itself = F.struct((-F.col("own")).alias("back"), F.col("anchor_id").alias("id"))
    chosen = state.join(listed, "key").withColumn("self", F.array_position("all", itself))
    chosen = chosen.withColumn("positives", F.slice(F.filter("all", lambda x, i: i + 1 != F.col("self")), 1, POSITIVES))
    low, high = F.transform("positives", lambda x: _window(-x["back"])[0]), F.transform("positives", lambda x: _window(-x["back"])[1])
    chosen = chosen.withColumns({"low": low, "high": high}).select("key", "anchor_id", "label", "vector", "probed", "low", "high", "positives")
    chosen = written_table(chosen)

    # Negatives: one window per positive, from the probe on no lower than the third best found.
    first = search.round(chosen.withColumn("probed", F.lit(None).cast("array<int>")), True, False, NEGATIVES)
    known = _best(first, NEGATIVES).filter(F.col("place") == NEGATIVES)
    known = known.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i.cast("long")), x)))
    second = search.round(chosen.join(known, "key", "left").withColumn("low", raised), False, False, NEGATIVES)
    best = _best(first.unionByName(second), NEGATIVES).withColumnRenamed("id", "negative_id")
    pairs = chosen.select("key", "anchor_id", F.posexplode("positives").alias("window", "positive"))
    return best.join(pairs.withColumn("window", F.col("window").cast("long")), ["key", "window"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), "negative_id",
        (-F.col("positive.back")).alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(spark, rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other, b.label AS label,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs
  WHERE label = anchor_label AND other <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.other AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 3
"""
