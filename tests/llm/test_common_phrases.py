"""Operator 3: passages whose minimisers lie in a phrase of very many texts."""

from __future__ import annotations

import random

import numpy as np

from shelfcast.llm import suffix_dedup
from shelfcast.llm.suffix_dedup import _grams, _same_windows, repeated_passages
from shelfcast.llm.words import Words
from shelfcast.session import written_table
from tests.llm.test_complete_passages import brute_force


def _all_grams(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return _grams(Words(data, np.array([0, len(data)])).hashes)


def test_passage_to_the_left_of_a_footer_of_all_texts(spark):
    rng = random.Random(5)
    free = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    # All windows of 25 own words and the footer choose a k-gram of the footer.
    while True:
        own, footer = free(25), free(40)
        if 25 <= int(_all_grams(own + footer).argmin()) <= 38:
            break
    texts = [free(25) + footer + free(45) for _ in range(4000)]
    first = ["a"] + own + footer + ["0first"] + free(45)
    last = ["b"] + own + footer + ["zlast"] + free(45)
    data = [(i, " ".join(t)) for i, t in enumerate([first, *texts, last])]
    # Small partitions would be put together, and the two rows would meet in one.
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(8)).collect()
    finally:
        spark.conf.unset(setting)
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(0, 1, 66), (4001, 1, 66)}


def test_a_window_of_very_many_texts_is_not_dealt_to_one_task(spark):
    rows = [(7, key, 3) for key in range(2000)] + [(100 + key, key, 9) for key in range(2000)] + [(7, 5, 40), (8, 5, 60), (8, 5, 80)]
    windows = spark.createDataFrame(rows, "window long, key long, start int")
    same = _same_windows(windows)
    got = sorted(tuple(r) for r in same.collect())
    assert got == sorted([(key, 3, 53) for key in range(2000)] + [(5, 40, 90)])
    # The shared windows are few: no exchange brings all rows of one of them together.
    assert "hashpartitioning(window" not in same._jdf.queryExecution().executedPlan().toString()


def test_suffixes_with_the_same_words_all_around_are_hashed_for_two_texts(spark, monkeypatch):
    rng = random.Random(11)
    free = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = free(160)
    # Some hold only a part of the passage, with words that leave windows open; very many hold all of it.
    parts = [free(5) + passage[74 - rng.randint(0, 45) : 86 + rng.randint(0, 45)] + free(5) for _ in range(30)]
    texts = [*parts, *(free(20) + passage + free(20) for _ in range(150))]
    hashed = []

    def counted(frame):
        table = written_table(frame)
        if "window" in table.columns and "key" in table.columns:
            hashed.append(table.count())
        return table

    monkeypatch.setattr(suffix_dedup, "written_table", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(docs).collect()}
    assert got == brute_force(dict(enumerate(texts)))
    assert len(hashed) == 1 and 0 < hashed[0] < 1000
