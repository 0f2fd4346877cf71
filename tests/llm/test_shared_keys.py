"""Unique keys of sets in many tiny partitions against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from shelfcast.llm.ngram_jaccard import ngram_components
from shelfcast.llm.shared_keys import unique_key_counts

N_PARTS = 24


def _sets(batch):
    for i, values in zip(batch.column("doc_id").to_pylist(), batch.column("grams").to_pylist()):
        yield i, np.unique(np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@pytest.mark.parametrize("n_ranges_keys", [10, 13_000_000])
def test_counts_of_tiny_partitions_whose_ids_add_up_alike(spark, n_ranges_keys):
    # Two documents a partition; all partitions have the same sum of ids and the same number of keys.
    data = [(i, [10 * i + k for k in range(4)] + [7]) for p in range(N_PARTS) for i in (p, 1000 - p)]
    rows = spark.sparkContext.parallelize(data, N_PARTS)
    got = unique_key_counts(spark.createDataFrame(rows, "doc_id long, grams array<long>"), _sets, n_ranges_keys).collect()
    seen = Counter(g for _, grams in data for g in grams)
    expected = sorted((i, len(grams), sum(seen[g] == 1 for g in grams)) for i, grams in data)
    assert sorted((r["id"], r["size"], r["n_unique"]) for r in got) == expected


def test_exact_copies_in_tiny_partitions_stay_linked(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    # Each text occurs twice, in different partitions.
    data = [(i, text(k % (N_PARTS // 2) * 2 + n)) for k in range(N_PARTS) for n, i in enumerate((k, 1000 - k))]
    rows = spark.sparkContext.parallelize(data, N_PARTS)
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first: dict = {}
    for i, t in sorted(data):
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in data}
