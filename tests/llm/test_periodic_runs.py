"""Operator 12 against the definition of a run, tried for every stretch and period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm.periodic_runs import (
    block_occurrences,
    find_runs,
    periodic_runs,
    repeat_tail,
    run_digests,
    transform,
    transform_back,
)
from tests.llm.corpus import SCHEMA, WORD, empty, rows


def plain_runs(words):
    """Every maximal stretch of every period, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                a, b = i, j + q
                smaller = any(all(words[k] == words[k + p] for k in range(a, b - p)) for p in range(1, q))
                if b - a >= max(12, 2 * q) and not smaller:
                    out.append((a, b - a, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def plain_rewrite(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return list(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_transform_multiplies_and_returns():
    random_ = np.random.default_rng(0)
    x, y = random_.integers(0, 998_244_353, (2, 3, 16))
    assert (transform_back(transform(x)) == x.astype(np.uint64)).all()
    z = transform_back(transform(x) * transform(y) % np.uint64(998_244_353))
    for r in range(3):
        want = [sum(int(x[r, i]) * int(y[r, (k - i) % 16]) for i in range(16)) % 998_244_353 for k in range(16)]
        assert z[r].tolist() == want


def test_block_occurrences_equal_comparison():
    random_ = np.random.default_rng(1)
    for size, least in ((2, 1), (4, 8), (8, 16)):
        codes = random_.integers(1, 3, 100)
        places = np.arange(0, 100 - size + 1, size)
        got = set(zip(*(x.tolist() for x in block_occurrences(codes, places, size, least))))
        want = {
            (b, d)
            for b in places.tolist()
            for d in range(least, 4 * size)
            if b + d + size <= 100 and (codes[b : b + size] == codes[b + d : b + d + size]).all()
        }
        assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70), st.integers(1, 20), st.integers(2, 5))
def test_runs_equal_definition(base, period, times):
    words = base[:7] + base[:period] * times + base
    assert find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_runs_of_structured_sequences():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    powers = [1]
    for i in range(2, 8):
        powers = powers + [i] + powers
    for words in (b, [1] * 300, powers, ([1] * 9 + [2]) * 20, list(range(1, 60)) * 4 + [7], [1, 2] * 11 + [2, 1] * 30):
        assert find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_digests_of_documents(spark):
    random_ = random.Random(3)
    data = [r for r in rows() if r[1] is None or len(r[1]) < 3000]
    line = " ".join(random_.choice("abcdefgh") for _ in range(9))
    data += [(1000 + k, " ".join(random_.choice(["p", "q"]) for _ in range(40 * k)), None, None, 0, "x", k, "y") for k in range(8)]
    data += [(2000, "\n".join([line] * 30), None, None, 0, None, 0, None), (2001, " word\x0b" * 25, None, None, 0, None, 0, None)]
    data += [data[-1], (10**12, None, None, None, 0, None, 0, None)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(map(tuple, run_digests(docs, repeat_tail).collect()), key=str)
    want = []
    for doc_id, text, *_ in data:
        words = WORD.findall(text or "")
        words = plain_rewrite(doc_id, words) if doc_id is not None else words
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        kept = plain_collapsed(words, runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        exponent = 1000 * best[1] // best[2] if runs else None
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(kept))]
        want.append((doc_id, len(runs), *best, exponent, *sha, len(kept)))
    assert got == sorted(want, key=str)
    assert any(w[1] > 1 for w in want)
    plain = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert [tuple(x) for x in plain[2000]["runs"]] == [(0, 270, 9)] and plain[2000]["collapsed"] == line
    assert plain[2001]["collapsed"] == "word" and plain[10**12]["runs"] == [] and plain[10**12]["collapsed"] == ""
    assert run_digests(empty(spark), repeat_tail).collect() == [] and periodic_runs(empty(spark)).collect() == []


def test_very_long_text(spark):
    random_ = random.Random(5)
    block = [f"w{random_.randrange(5000)}" for _ in range(30_000)]
    words = ["a", *block, *block, *block[:17], "end", *["x"] * 50_000]
    got = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()[0]
    assert [tuple(x) for x in got["runs"]] == [(1, 60_017, 30_000), (60_019, 50_000, 1)]
    assert got["collapsed"] == " ".join(["a", *block, "end", "x"])
