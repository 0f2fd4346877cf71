"""Operators 3, 5 and 8 against brute force."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from shelfcast.llm.components import connected_components
from shelfcast.llm.decontamination import MASKS, PERCENT, contaminated, short_masks
from shelfcast.llm.ngram_jaccard import ngram_components
from shelfcast.llm.suffix_dedup import WINDOW, minimisers, repeated_passages
from tests.llm.corpus import empty, frame, rows, words_of


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    data = [r for r in rows(seed) if r[0] is not None]
    sets = {r[0]: shingle_set(r[1]) for r in data}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = ngram_components(frame(spark, seed)).collect()
    assert len(got) == len(rows(seed))
    named = [r for r in got if r["doc_id"] is not None]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in named} == {(i, len(s), root(i)) for i, s in sets.items()}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert len({root(i) for i in sets}) < len(sets) - 5


def test_components_of_empty_table(spark):
    assert ngram_components(empty(spark)).collect() == []


def test_connected_components_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (139, 140)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(200, 260)}, 7: 7, 5: 5}


def test_minimisers_cover_every_window():
    grams = np.random.default_rng(0).integers(0, 50, 500, dtype=np.uint64)
    spots = minimisers(grams)
    wanted = {i for s in range(len(grams) - WINDOW + 1) for i in range(s, s + WINDOW) if grams[i] == grams[s : s + WINDOW].min()}
    assert set(spots.tolist()) == wanted
    assert len(minimisers(grams[: WINDOW - 1])) == 0


def test_passages_equal_brute_force(spark):
    data = {r[0]: words_of(r[1]) for r in rows() if r[0] is not None}
    owner: dict = {}
    for i, w in data.items():
        for k in range(len(w) - 49):
            owner.setdefault(tuple(w[k : k + 50]), set()).add(i)
    expected = set()
    for i, w in data.items():
        spans: list[list[int]] = []
        for k in range(len(w) - 49):
            if len(owner[tuple(w[k : k + 50])]) > 1:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        expected |= {(i, a, b) for a, b in spans}
    got = repeated_passages(frame(spark)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == expected
    assert len(got) == len(expected) and {b - a for _, a, b in expected} >= {60}
    assert repeated_passages(empty(spark)).collect() == []


def test_masks_hit_all_windows_with_two_changed_words():
    for changed in combinations(range(13), 2):
        same = [i not in changed for i in range(13)]
        assert any(all(same[o + j] for j, c in enumerate(m) if c == "1") for m in MASKS for o in range(13 - len(m) + 1))


def test_contaminated_texts_equal_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    base = words_of(data[0][1] + " " + data[1][1])
    leak, changed = base[20:50], list(base[20:50])
    for k in (3, 9, 16, 22, 28):
        changed[k] = "changed"
    extra = [(900, " ".join(["pad"] * 9 + leak).upper(), *data[0][2:]), (901, " ".join(changed + ["pad"] * 9), *data[0][2:]),
             (902, "short item of six words", *data[0][2:])]
    items = [(1, " ".join(leak)), (2, "short item of six words"), (3, None), (4, "too short"), (5, ""), (None, " ".join(leak))]
    docs = frame(spark).unionByName(spark.createDataFrame(extra, frame(spark).schema))
    expected = set()
    for doc_id, text in [(r[0], r[1]) for r in [*data, *extra]]:
        w = words_of(text)
        for item, t in items:
            b = words_of(t)
            size = min(13, len(b))
            if size >= 5 and any(
                sum(x == y for x, y in zip(w[i : i + size], b[j : j + size])) * 100 >= 80 * size
                for i in range(len(w) - size + 1) for j in range(len(b) - size + 1)
            ):
                expected.add((doc_id, item))
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    assert {900, 901, 902} <= {i for i, _ in expected}
    assert contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_short_items_are_found_with_every_allowed_change(spark):
    """Items of 5 to 14 words inside texts, with every choice of as many changed words as the verifier allows, and one more."""
    for n in range(5, 13):
        allowed = n - math.ceil(PERCENT * n / 100)
        for changed in combinations(range(n), allowed):
            assert any(all(m[i] == "0" for i in changed) for m in short_masks(n)), (n, changed)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(5, 15)}
    docs, want = [], set()
    for n, words in items.items():
        size = min(n, 13)
        allowed = size - math.ceil(PERCENT * size / 100)
        for count in (allowed, allowed + 1):
            for changed in combinations(range(size), count):
                own = [f"c{len(docs)}" if k in changed else w for k, w in enumerate(words[:size])]
                docs.append((len(docs), " ".join([f"p{len(docs)}", *own, f"q{len(docs)}"])))
                if count == allowed:
                    want.add((len(docs) - 1, n))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
