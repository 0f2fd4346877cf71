"""Operator 11 against all scores, written out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import hard_negatives as mining
from shelfcast.llm.hard_negatives import falling_sums, hard_negatives

SCHEMA = "id long, label int, vector array<float>, key long, block string, score string"


def plain(rows, is_anchor):
    kept = []
    for i, label, vector, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for k, (i, label, v) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in (r for p, r in enumerate(kept) if p != k)]
        for back, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and 50 * -back <= 100 * -s[0] <= 95 * -back)
            out += [(i, j, r, n[1], -back, -n[0]) for r, n in enumerate(fits[:3], 1)]
    return sorted(out)


def cloud(seed=0, rows=700, width=9):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 1, (7, width))
    data = []
    for i in range(rows):
        v = centres[i % 7] + random.normal(0, 0.25, width)
        data.append((i, int(random.integers(0, 4)), [float(np.float32(round(x, 1))) for x in v], i, "b", "s"))
    return data


def test_sums_come_in_falling_order():
    random = np.random.default_rng(0)
    a, b = random.normal(size=6), random.normal(size=9)
    got = list(falling_sums(a, b))
    assert len({x[:2] for x in got}) == 54 and [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)
    assert all(x[2] == a[x[0]] + b[x[1]] for x in got)


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (50, 20)])
def test_equals_all_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(mining, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(mining, "PROBE_ROWS", blocks[1])
    data = cloud()
    common = data[3][2]
    data += [(1000 + k, k % 3, common, 0, None, None) for k in range(240)]  # one very common vector
    data += [(2000, 1, None, 0, "", ""), (2050, None, common, 0, "", ""), (None, 1, common, 0, "", ""), (2100, 1, [1.0, None], 0, "", "")]
    data += [(2150, 2, [float("nan")] * 9, 0, "", ""), (2200, 2, [float("inf")] * 9, 0, "", ""), (2250, 2, [], 0, "", ""), (2300, 1, [0.5, -0.25], 0, "", "")]
    data += [data[50], data[51], data[100], data[100], (2350, 9, common, 0, "", ""), (-50, 0, data[8][2], 0, "", "")]
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = sorted(map(tuple, hard_negatives(spark, frame, F.col("id") % 50 == 0).collect()))
    want = plain(data, lambda i: i % 50 == 0)
    assert got == want and len(want) > 100


def test_large_components_and_odd_tables(spark):
    random = np.random.default_rng(1)
    data = [(i, i % 3, [float(np.float32(x)) for x in random.normal(0, 3e4, 5)], 0, "", "") for i in range(120)]
    got = sorted(map(tuple, hard_negatives(spark, spark.createDataFrame(data, SCHEMA), F.col("id") % 10 == 0).collect()))
    assert got == plain(data, lambda i: i % 10 == 0) and got
    wide = [(i, i % 3, [float(np.float32(x)) for x in random.normal(0, 4e5, 3)], 0, "", "") for i in range(60)]
    got = sorted(map(tuple, hard_negatives(spark, spark.createDataFrame(wide, SCHEMA), F.col("id") % 10 == 0).collect()))
    assert got == plain(wide, lambda i: i % 10 == 0) and got
    empty = hard_negatives(spark, spark.createDataFrame([], SCHEMA), F.lit(True))
    assert empty.collect() == [] and len(empty.columns) == 6
    alone = spark.createDataFrame([(0, 1, [1.0], 0, "", ""), (50, 2, [1.0], 0, "", "")], SCHEMA)
    assert hard_negatives(spark, alone, F.lit(True)).collect() == []
    none = spark.createDataFrame([(1, 1, [1.0], 0, "", "")], SCHEMA)
    assert hard_negatives(spark, none, F.lit(False)).collect() == []
    with pytest.raises(Exception, match="too large"):
        hard_negatives(spark, spark.createDataFrame([(0, 1, [1e30], 0, "", "")], SCHEMA), F.lit(True)).collect()


def test_clustered_vectors_are_searched_in_part(spark):
    """With tight clusters the certified stop leaves most cells out."""
    random = np.random.default_rng(2)
    centres = random.normal(0, 1, (16, 32))
    rows = np.floor(256 * (centres[np.arange(4000) % 16] + random.normal(0, 0.02, (4000, 32)))).astype(np.int64)
    index = mining.MultiIndex(32, (mining.fit_codebook(rows[:, :16], 16), mining.fit_codebook(rows[:, 16:], 16)))
    cell, a, b = index.cells(rows)
    index.lay_out([(c, int((cell == c).sum()), float(a[cell == c].max()), float(b[cell == c].max())) for c in np.unique(cell).tolist()])
    seen = 0
    for query in rows[:16].astype(float):
        score = rows @ query
        fifth = np.sort(score)[-6]
        visited = [c for c, most, _ in index.visits(query) if most >= fifth]
        assert set(cell[score >= fifth].tolist()) <= set(visited)
        assert all(low - 1 <= score[cell == c].min() and score[cell == c].max() <= high for c, high, low in index.visits(query))
        seen += sum(index.rows[c] for c in visited)
    assert seen < 0.5 * 16 * len(rows)
