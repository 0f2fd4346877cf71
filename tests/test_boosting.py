"""Boosted trees against a plain loop, and their curve, importances and files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.boosting import (
    LOSSES,
    UNIT,
    BoostedTrees,
    TreeSettings,
    fit_trees,
    gradients,
    measure,
    permutation_importance,
)

NAMES = ["a", "b", "c"]


def table(n=600, seed=0):
    random = np.random.default_rng(seed)
    x = np.column_stack([random.integers(0, 9, n), random.normal(0, 1, n).round(2), random.integers(0, 3, n)]).astype(float)
    rate = np.exp(0.25 * x[:, 0] - 0.5 * (x[:, 1] > 0))
    y = random.poisson(rate).astype(float)
    w = random.integers(1, 4, n) / 2
    return x, y, w, np.arange(n) % 4 == 3


def frame(spark, x, y, w, held, parts=3):
    rows = [(*map(float, r), float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, held)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double, held boolean").repartition(parts)


def plain_fit(x, y, w, settings, base, cuts):
    """One node after the other, one border after the other, in ordinary loops."""
    score, model = np.full(len(y), base), []
    for _ in range(settings.rounds):
        g, h = (np.rint(v * UNIT) / UNIT for v in gradients(settings.loss, score, y, w))
        level, leaves = {1: np.arange(len(y))}, {}
        for _ in range(settings.depth):
            following = {}
            for node, rows in level.items():
                best, total = None, g[rows].sum() ** 2 / (h[rows].sum() + settings.l2)
                for j, cut in enumerate(cuts):
                    for k, border in enumerate(cut):
                        left = x[rows, j] <= border
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < settings.least_rows:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + settings.l2) + g[b].sum() ** 2 / (h[b].sum() + settings.l2) - total
                        if gain > 0 and (best is None or (gain, -j, -k) > best[0]):
                            best = ((gain, -j, -k), a, b)
                if best is None:
                    leaves[node] = rows
                else:
                    following[2 * node], following[2 * node + 1] = best[1], best[2]
            level = following
        for rows in [*leaves.values(), *level.values()]:
            score[rows] -= settings.step * g[rows].sum() / (h[rows].sum() + settings.l2)
        model.append(score.copy())
    return model


@pytest.mark.parametrize("loss", ["poisson", "tweedie", "logistic", "squared"])
def test_three_rounds_equal_a_plain_loop(spark, loss):
    x, y, w, held = table()
    y = (y > 1).astype(float) if loss == "logistic" else y
    settings = TreeSettings(loss, rounds=3, depth=3, bins=8, least_rows=20, row_share=1.0, column_share=1.0)
    model = fit_trees(frame(spark, x, y, w, held), NAMES, "y", settings, "w", "held")
    train = ~held
    cuts = [np.unique(np.quantile(x[train, j], [i / 8 for i in range(1, 8)], method="inverted_cdf")) for j in range(3)]
    scores = plain_fit(x[train], y[train], w[train], settings, model.base, cuts)
    for rounds, want in enumerate(scores, 1):
        link = {"logistic": lambda f: 1 / (1 + np.exp(-f)), "squared": lambda f: f}.get(loss, np.exp)
        assert np.allclose(model.predict(x[train], rounds), link(want), rtol=1e-9)


@pytest.mark.parametrize("loss", LOSSES)
def test_gradients_equal_differences(loss):
    f, w = np.linspace(-2, 2, 9), np.full(9, 1.5)
    y = np.tile([0.0, 1.0, 3.0], 3) if loss != "logistic" else np.tile([0.0, 1.0, 1.0], 3)

    def value(s):
        if loss == "poisson":
            return w * (np.exp(s) - y * s)
        if loss == "tweedie":
            return w * (np.exp(0.8 * s) / 0.8 + y * np.exp(-0.2 * s) / 0.2)
        return measure(loss, s, y, w) / (2 if loss == "squared" else 1)

    g, h = gradients(loss, f + 0.01, y, w)
    assert np.allclose(g, (value(f + 0.01 + 1e-5) - value(f + 0.01 - 1e-5)) / 2e-5, atol=1e-4)
    if loss != "absolute":
        up, down = gradients(loss, f + 0.01 + 1e-5, y, w)[0], gradients(loss, f + 0.01 - 1e-5, y, w)[0]
        assert np.allclose(h, (up - down) / 2e-5, atol=1e-4)


def test_curve_best_round_and_early_stop(spark):
    x, y, w, held = table(800, 3)
    settings = TreeSettings("poisson", rounds=40, depth=4, step=0.4, bins=16, least_rows=5, patience=6)
    model = fit_trees(frame(spark, x, y, w, held), NAMES, "y", settings, "w", "held")
    want = []
    for rounds in range(1, len(model.curve) + 1):
        want.append(np.sqrt((w[held] * (model.predict(x[held], rounds) - y[held]) ** 2).sum() / w[held].sum()))
    assert np.allclose(model.curve, want, rtol=1e-9)
    assert model.best_round == int(np.argmin(want)) + 1 and len(model.trees) < 40
    assert len(model.curve) - model.best_round >= 6
    rows = frame(spark, x, y, w, held)
    got = model.transform(rows).select("a", "b", "c", "_raw_prediction").collect()
    assert np.allclose([r[3] for r in got], model.predict(np.array([r[:3] for r in got])))


def test_fit_does_not_depend_on_partitions_and_survives_files(spark, tmp_path):
    x, y, w, held = table(400, 5)
    settings = TreeSettings("tweedie", rounds=12, depth=3, bins=16, least_rows=10)
    one = fit_trees(frame(spark, x, y, w, held, 1), NAMES, "y", settings, "w", "held")
    many = fit_trees(frame(spark, x, y, w, held, 7), NAMES, "y", settings, "w", "held")
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(one.trees, many.trees, strict=True))
    one.save(spark, str(tmp_path / "m"))
    again = BoostedTrees.load(spark, str(tmp_path / "m"))
    assert (again.predict(x) == one.predict(x)).all() and again.settings == settings and again.curve == one.curve
    assert again.importances() == one.importances()
    gain = dict((n, g) for n, g, _ in one.importances())
    assert gain["a"] > gain["b"] > 0


def test_absolute_loss_follows_the_median(spark):
    x, y, w, held = table(600, 7)
    y = np.where(x[:, 0] > 4, 10.0, 2.0) + (np.arange(600) % 5 == 0) * 100
    settings = TreeSettings("absolute", rounds=30, depth=2, step=0.3, bins=16, least_rows=5, row_share=1.0, column_share=1.0)
    model = fit_trees(frame(spark, x, y, np.ones(600), held), NAMES, "y", settings, held_out="held")
    assert np.abs(model.predict(x) - np.where(x[:, 0] > 4, 10.0, 2.0)).max() < 0.5


def test_odd_inputs(spark):
    x, y, w, held = table(60, 9)
    settings = TreeSettings("poisson", rounds=2, depth=2, least_rows=5)
    none = fit_trees(frame(spark, x, y, w, held).limit(0), NAMES, "y", settings, "w", "held")
    assert none.curve == [] and np.isfinite(none.predict(x)).all()
    odd = frame(spark, x, y, w, held).withColumns({"a": F.lit(None).cast("double"), "c": F.lit(1.0), "y": F.when(F.col("b") > 2, None).otherwise(F.col("y"))})
    assert np.isfinite(fit_trees(odd, NAMES, "y", settings, "w").predict(x)).all()
    with pytest.raises(ValueError, match="Not a loss"):
        TreeSettings("huber")
    with pytest.raises(ValueError, match="bins"):
        TreeSettings("poisson", bins=300)


def test_permutation_importance_equals_a_plain_exchange(spark):
    x, y, w, held = table(300, 11)
    settings = TreeSettings("poisson", rounds=10, depth=3, bins=16, least_rows=10, row_share=1.0, column_share=1.0)
    rows = frame(spark, x, y, w, np.zeros(300, bool))
    model = fit_trees(rows, NAMES, "y", settings, "w")
    got = {r["feature"]: r for r in permutation_importance(rows, NAMES, "y", model.value_of, "w").collect()}
    again = {r["feature"]: r for r in permutation_importance(rows.repartition(9), NAMES, "y", model.value_of, "w").collect()}
    assert all(got[n]["importance"] == pytest.approx(again[n]["importance"], rel=1e-9, abs=1e-12) for n in NAMES)
    keyed = rows.select(F.array(*NAMES).alias("x"), "y", "w").withColumn("k", F.xxhash64("x", "y", "w"))
    orders = []
    for salt in ("takes", "gives"):
        orders.append([(list(r["x"]), r["y"], r["w"]) for r in keyed.orderBy(F.xxhash64("k", F.lit(salt)), "k").collect()])
    taker = np.array([r[0] for r in orders[0]])
    giver = np.array([r[0] for r in orders[1]])
    ty, tw = (np.array([r[i] for r in orders[0]]) for i in (1, 2))
    plain = (tw * (model.predict(taker) - ty) ** 2).sum() / tw.sum()
    for j, name in enumerate(NAMES):
        swapped = taker.copy()
        swapped[:, j] = giver[:, j]
        loss = (tw * (model.predict(swapped) - ty) ** 2).sum() / tw.sum()
        assert got[name]["loss"] == pytest.approx(loss) and got[name]["importance"] == pytest.approx(loss - plain, abs=1e-9)
    assert got["a"]["importance"] > got["b"]["importance"] > -1e-9
