"""Operator 10 against the given weights: the deviation does not grow with rows or sources."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.llm.pfair_mixing import BLOCK_ROWS, SPAN_SLOTS, TEMPERATURE, block_slots, block_windows, mix_order, mix_sources


@pytest.mark.parametrize(
    ("sizes", "weights"),
    [
        ({"hot": 17_000, **{f"s{i:02d}": 1_789 for i in range(19)}}, None),
        ({"hot": 6_000, **{f"s{i:03d}": 50 for i in range(150)}}, None),
        ({"a": 9_000, "b": 20_000, "c": 700}, {"a": 0.5049, "b": 0.4942, "c": 0.0009}),
    ],
)
def test_every_source_is_within_one_block_of_its_given_weight(spark, sizes, weights):
    data = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    given = weights and spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = mix_order(docs, given).select("source", "block", "slot").distinct().orderBy("slot").collect()
    blocks = {s: -(-n // BLOCK_ROWS) for s, n in sizes.items()}
    assert [r["slot"] for r in got] == list(range(sum(blocks.values())))
    shares = weights or {s: n**TEMPERATURE for s, n in sizes.items()}
    total = sum(shares.values())
    # Until a source runs out in the ideal schedule the target is its share of all slots.
    until = min(n * total / shares[s] for s, n in blocks.items())
    done = dict.fromkeys(sizes, 0)
    for t, r in enumerate(got, 1):
        if t > until:
            break
        assert r["block"] == done[r["source"]]
        done[r["source"]] += 1
        worst = max(abs(done[s] - t * shares[s] / total) for s in sizes)
        assert worst < 1 + 1e-5, (t, worst)


def test_equal_rows_take_their_own_places(spark):
    """320 equal rows are ten blocks in their source's turns, not ten blocks in a row."""
    data = [(1, "same", "a")] * (10 * BLOCK_ROWS) + [(k, "other", "b") for k in range(10 * BLOCK_ROWS)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    mixed = mix_sources(docs, weights)
    assert mixed.columns == docs.columns
    got = [tuple(r) for r in mixed.collect()]
    assert sorted(map(str, got)) == sorted(map(str, data))
    taken = 0
    for t, (_, _, source) in enumerate(got[: 20 * BLOCK_ROWS], 1):
        taken += source == "a"
        assert abs(taken - t / 2) <= BLOCK_ROWS
    with pytest.raises(ValueError, match="reserved"):
        mix_sources(docs.withColumn("_mix_at", docs["doc_id"]))


def _weighted(spark, blocks, weights):
    total = sum(weights)
    rows = [(f"s{i:04d}", n, w / total) for i, (n, w) in enumerate(zip(blocks, weights))]
    return spark.createDataFrame(rows, "source string, n_blocks long, weight double")


@pytest.mark.parametrize("shape", ["few", "many tiny", "unlike", "equal", "more than a span"])
def test_schedule_equals_earliest_deadline_first_slot_by_slot(spark, shape):
    draw = random.Random(shape)
    if shape == "few":
        blocks, weights = [900, 700, 41], [5.0, 3.0, 0.2]
    elif shape == "many tiny":  # windows over many spans
        blocks, weights = [2_500, *[draw.randint(1, 3) for _ in range(120)]], [1.0, *[draw.uniform(1e-4, 1e-3) for _ in range(120)]]
    elif shape == "unlike":
        blocks, weights = zip(*[(draw.randint(1, 90), draw.paretovariate(0.6)) for _ in range(60)])
    elif shape == "equal":  # equal deadlines everywhere
        blocks, weights = [40] * 50, [1.0] * 50
    else:
        blocks, weights = zip(*[(draw.randint(1, 6), draw.uniform(0.2, 3)) for _ in range(SPAN_SLOTS + 70)])
    weighted = _weighted(spark, blocks, weights)
    jobs = sorted((r["ready"], r["due"], r["number"], r["block"], r["source"]) for r in block_windows(weighted).collect())
    waiting, at, want = [], 0, []
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(waiting, jobs[at][1:])
            at += 1
        due, _, block, source = heapq.heappop(waiting)
        assert slot < due
        want.append((slot, source, block))
    got = sorted((r["slot"], r["source"], r["block"]) for r in block_slots(weighted).collect())
    assert got == want


def test_schedule_does_not_depend_on_the_partitions(spark):
    weighted = _weighted(spark, [300, 900, 20], [1.0, 2.0, 0.3])
    digest = F.sum(F.xxhash64("source", "block", "slot").cast("decimal(38,0)"))
    first = block_slots(weighted).agg(digest).first()
    assert block_slots(weighted.repartition(7, "n_blocks")).agg(digest).first() == first
