"""Operator 3: passages shared with a text that is no neighbour in either order."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfcast.llm import suffix_dedup
from shelfcast.llm.suffix_dedup import MIN_WORDS, REACH, _bits, repeated_passages
from tests.llm.corpus import words_of


def brute_force(texts: dict) -> set:
    owners: dict = {}
    for i, w in texts.items():
        for k in range(len(w) - MIN_WORDS + 1):
            owners.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add(i)
    out = set()
    for i, w in texts.items():
        spans: list[list[int]] = []
        for k in range(len(w) - MIN_WORDS + 1):
            if len(owners[tuple(w[k : k + MIN_WORDS])]) > 1:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + MIN_WORDS
                else:
                    spans.append([k, k + MIN_WORDS])
        out |= {(i, a, b) for a, b in spans}
    return out


def family(seed: int, size: int) -> list[str]:
    """One text and others that share a phrase of it with more or fewer words to either side."""
    rng = random.Random(seed)
    free = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, at = free(160), 74
    out = [" ".join(base)]
    for _ in range(size):
        left, right = rng.randint(0, 45), rng.randint(0, 45)
        out.append(" ".join(free(rng.randint(0, 20)) + base[at - left : at + 12 + right] + free(rng.randint(0, 20))))
    return out


def test_bits():
    low, high = np.array([0, 3, 5, 38, 0]), np.array([38, 3, 4, 38, -1])
    assert _bits(low, high).tolist() == [(1 << (REACH + 1)) - 1, 8, 0, 1 << 38, 0]


@pytest.mark.parametrize("parts", [1, 8])
def test_spans_equal_brute_force_where_neighbours_do_not_tell(spark, parts):
    texts = [t for seed in range(40) for t in family(seed, 3 + seed % 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = repeated_passages(docs).collect()
    want = brute_force({i: words_of(t) for i, t in enumerate(texts)})
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == want and len(got) == len(want)
    assert len(want) > 100


def test_windows_without_a_neighbour_in_the_table_stay_possible():
    short = lambda values: pa.array([np.array([v] * REACH, ">u2").tobytes() for v in values], pa.binary())
    reach = pa.array([REACH] * 3, pa.int32())
    table = pa.table({"gram": [1, 1, 2], "right": short([5, 6, 7]), "left": short([5, 5, 5]), "key": [10, 11, 12], "place": [40, 41, 42],
                      "n_right": reach, "n_left": reach})
    possible, found = suffix_dedup.match_neighbours(table, "right")
    every = (1 << (REACH + 1)) - 1
    # Outer rows lack a neighbour; the middle one shares no word to the right, so only the window that ends with the k-gram.
    assert possible.tolist() == [every, 1 << REACH, every] and found.tolist() == [1 << REACH, 1 << REACH, 0]


def test_two_texts_under_one_doc_id_do_no_harm(spark):
    texts = family(3, 8)
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, "few words"), (1, " ".join(f"other{k}" for k in range(300)))]
    assert repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count() >= 1
