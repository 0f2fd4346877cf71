"""Operators 2, 4, 7, 9 and 10, and the pipeline."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm.byte_gru import label_positions, loss_and_gradient, new_weights
from shelfcast.llm.language_id import fit_language_model, held_out, predict_language
from shelfcast.llm.pfair_mixing import BLOCK_ROWS, mix_order, mix_sources
from shelfcast.llm.quality_rules import fit_rules, quality_rules
from shelfcast.llm.site_quality import fit_evidence, judge_quality, keep_good
from shelfcast.llm.toxicity import LabelModel, toxicity
from tests.llm.corpus import WORD, empty, frame, rows

SF = "/root/testdata/sf0.001"


def test_gradient_equals_differences_and_inference_equals_training():
    weights = {k: v.astype(np.float64) for k, v in new_weights(3, 4).items()}
    random = np.random.default_rng(0)
    codes, labels = random.integers(0, 4, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    real = np.ones((5, 7), bool)
    real[2, 4:] = False
    _, grad = loss_and_gradient(weights, codes, labels, real)
    for name in ("table_f", "table_b", "states_f", "inner_b", "out", "bias"):
        spot = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, sides = weights[name][spot], []
        for step in (0.01, -0.01):
            weights[name][spot] = old + step
            sides.append(loss_and_gradient(weights, codes, labels, real)[0])
        weights[name][spot] = old
        assert (sides[0] - sides[1]) / 0.02 == pytest.approx(grad[name][spot], rel=0.01)
    p = label_positions({k: v.astype(np.float32) for k, v in weights.items()}, codes)
    share = real.T / real.sum()
    loss = -(np.log(p[:, labels, np.arange(5)]) * share).sum()
    assert loss == pytest.approx(loss_and_gradient(weights, codes, labels, real)[0], rel=1e-4)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    languages, weights = fit_language_model(docs.filter(~held_out(3, 1)), rounds=150)
    got = predict_language(docs, languages, weights).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(3, 1)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"]]) > 0.9
    odd = {r["doc_id"]: r for r in predict_language(frame(spark), languages, weights).collect()}
    assert len(odd) == len({r[0] for r in rows()})
    for r in rows():
        letters = any(c.isalpha() for c in r[1] or "")
        assert (odd[r[0]]["lang_pred"] != "und") == letters and 0 <= odd[r[0]]["score"] <= 1
    assert predict_language(empty(spark), languages, weights).collect() == []
    assert fit_language_model(empty(spark)) == ([], {})
    assert {r["lang_pred"] for r in predict_language(frame(spark), [], {}).collect()} == {"und"}


def test_every_one_of_many_languages_is_in_the_sample(spark, monkeypatch):
    from shelfcast.llm import language_id

    monkeypatch.setattr(language_id, "MAX_TRAIN_DOCS", 600)
    # 50 languages, the first ones a hundred times as frequent as the last ones.
    data = [(k * 1000 + i, f"text {k} {i}", f"l{k:02d}") for k in range(50) for i in range(1000 if k < 5 else 10)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    languages, rows = language_id.train_sample(docs)
    drawn = Counter(r["lang"] for r in rows)
    assert languages == sorted({r[2] for r in data}) and len(rows) <= 600
    assert set(drawn) == set(languages) and all(drawn[f"l{k:02d}"] == 10 for k in range(5, 50))


def test_label_model_discounts_voters_that_repeat_each_other():
    random = np.random.default_rng(1)
    truth = random.random(20_000) < 0.2
    vote = lambda: np.where(truth, random.random(20_000) < 0.8, random.random(20_000) < 0.05)
    one = vote()
    votes = np.stack([one, one, one, vote(), vote()], axis=1)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(kinds, counts.astype(float), 0.2)
    assert model.weights[:3].sum() < 2 * model.weights[3] and model.weights[3] > 0
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.9


def test_toxicity(spark):
    table = []
    for i in range(400):
        bad = i % 5 == 0
        own = [f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}" for x in ("qu", "we", "er", "ty", "ui", "op", "as", "df", "gh")]
        marked = ["awfulperson" if k == 3 else "nastyone" if k == 7 else w for k, w in enumerate(own)] if bad else own
        table.append((i, " ".join(marked), int(bad)))
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t, _ in table], "doc_id long, text string, lang string, terms string")
    docs = docs.unionByName(spark.createDataFrame([(1000, None, None, None), (1001, "", None, None), (None, "nastyone awfulperson", None, None)], docs.schema))
    labels = spark.createDataFrame([(i, b) for i, _, b in table] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, labels, ~held_out(5, 0)).collect()}
    assert len(got) == 403
    assert all((got[i] >= 0.5) == bool(b) for i, _, b in table) and got[None] >= 0.5 and max(got[1000], got[1001]) < 0.5
    assert toxicity(docs.limit(0), labels).collect() == []
    assert toxicity(docs, labels.limit(0)).count() == 403


def test_base_counts_equal_brute_force(spark):
    got = quality_rules(frame(spark)).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows():
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by_id[doc_id]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules(empty(spark)).collect() == []


def test_rules_that_agree_outweigh_a_majority_of_silence():
    n_bad, n_good = 9, 2
    clean, symbols, caps = np.zeros(11, int), np.zeros(11, int), np.zeros(11, int)
    clean[n_bad:] = 1
    symbols[[0, 1]] = -1
    caps[[4, 5, 1]] = -1
    patterns, counts = np.array([clean, symbols, caps]), np.array([9000.0, 600, 400])
    prior, ratio, rest = fit_rules(patterns, counts)
    logit = prior + np.where(patterns != 0, ratio, rest).sum(axis=1)
    assert n_bad + n_good == 11 and logit[0] > 2 and logit[1] < -2 and logit[2] < -2
    assert fit_rules(np.zeros((0, 11), int), np.zeros(0))[0] > 0


def test_site_rates_shrink_and_sparse_sites_follow_the_rest(spark):
    table = []
    for i in range(600):
        bad = i % 3 == 0 if i < 300 else i % 30 == 0
        text = "TERRIBLE ###!!! $$$ " * 20 if bad else " ".join(f"word{i}x{k}" for k in range(40))
        table.append((i, text, "en", "junk" if i < 300 else "fine", "clash"))
    table += [(700, "a plain text of some different words", "xx", "lonely", "clash"), (701, None, None, None, None), (701, None, None, None, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n string")
    labels = spark.createDataFrame([(i, int("###" not in t)) for i, t, *_ in table[:600] if i % 2] + [(5, None), (None, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judge_quality(docs, labels).collect()}
    assert all((got[i]["_quality"] >= 0.5) == ("###" not in t) for i, t, *_ in table[:600])
    assert got[1]["_section_rate"] < got[700]["_section_rate"] < got[301]["_section_rate"]
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 700").count() == 1
    assert keep_good(docs, labels.limit(0)).count() == len(table)
    assert keep_good(docs.limit(0), labels).collect() == []
    assert not fit_evidence(np.ones((3, 2)), np.ones(3)).any()


def test_mixing_is_within_one_block_of_the_target(spark):
    sizes = {"a": 90 * BLOCK_ROWS + 5, "b": 30 * BLOCK_ROWS, "c": 7 * BLOCK_ROWS + 1, None: 3}
    data = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(data, "doc_id long, source string").repartition(5)
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), (None, 0.0), ("unused", 1.0)], "source string, weight double")
    got = mix_order(docs, weights).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in data]
    assert all(r["source"] == data[r["doc_id"]][1] for r in got)
    slot_of = {}
    for r in got:
        assert slot_of.setdefault((r["source"], r["block"]), r["slot"]) == r["slot"]
    order = [s for (s, _), _ in sorted(slot_of.items(), key=lambda x: x[1])]
    assert sorted(slot_of.values()) == list(range(len(order)))
    for source in sizes:  # blocks of a source come in order
        slots = [slot_of[source, b] for b in range(sum(s == source for s, _ in slot_of))]
        assert slots == sorted(slots)
    # The given weights 5, 3 and 2 are the target of every slot until c runs out in the ideal schedule.
    done: Counter = Counter()
    for t, source in enumerate(order[: 8 * 10 // 2], 1):
        done[source] += 1
        assert all(abs(done[s] - t * w / 10) < 1 + 1e-5 for s, w in {"a": 5, "b": 3, "c": 2}.items()), (t, done)
    assert order[-1] is None and order.count(None) == 1  # a source without a weight comes after the others


def test_mixing_keeps_rows_columns_and_copies(spark):
    mixed = mix_sources(frame(spark))
    assert mixed.columns == frame(spark).columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, frame(spark).collect()))
    assert mix_sources(empty(spark)).collect() == []
    assert mix_order(empty(spark)).collect() == []


def test_pipeline_stages_and_their_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF).collect()
    kept = corpus_pipeline.quality(spark, docs, SF)
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    clean = corpus_pipeline.decontaminated(spark, one, SF)
    assert kept.columns == one.columns == clean.columns == docs.columns
    sizes = [docs.count(), kept.count(), one.count(), clean.count()]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2]
    assert sorted(r["doc_id"] for r in result) == sorted(r["doc_id"] for r in clean.select("doc_id").collect())
    # Records follow the mixed order, not the ids.
    order = mix_order(clean).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("at")).orderBy("at", "doc_id").collect()
    assert [r["doc_id"] for r in sorted(result, key=lambda r: r["start"])] == [r["doc_id"] for r in order]


def test_one_row_of_each_doc_id_stays_in_the_pipeline(spark):
    text = " ".join(f"w{i}" for i in range(40))
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "fr", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1),
            (None, text, "en", "s", 1), (3, "other words here", "en", "s", 1), (4, None, None, None, None), (4, "", None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns
    rows = [tuple(r) for r in one.collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]
    assert all(r in data for r in rows)
    again = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))
