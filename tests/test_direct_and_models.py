import json
import random

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from shelfcast.config import DIRECT_COLUMNS, MODEL_COLUMNS, ORIGIN_LAGS, ORIGIN_WINDOWS, SOURCE_FALLBACK, SOURCE_MODEL, DirectConfig
from shelfcast.operators import baselines, blend, boosting, direct, frames, models, recursive, scoring
from shelfcast.operators.profile import item_profile
from shelfcast.plans import daily_model, direct_models
from shelfcast.session import written_table
from shelfcast.sources.model_store import ModelStore
from shelfcast.sources.runs import RunStore
from shelfcast.sources.tables import TableStore
from tests.helpers import DAY, by, daily_rows, day, feature_gold, forecast_gold

START, CUT = day("2023-01-01"), day("2024-08-31")
CFG = DirectConfig(
    top_n=3, origin_lookback_days=120, origin_stride=30, end_of_selling_since="2024-01-01", max_iter=2, max_depth=2
)


def series(seed=3):
    rng = random.Random(seed)
    out = {}
    for item, chance in (("A", 0.9), ("B", 0.4), ("C", 0.05), ("D", 0.3)):
        out[item] = {str(START + i * DAY): rng.randint(1, 9) for i in range(670) if rng.random() < chance}
    out["A"][str(START)] = 1
    return out


def dense(values, item, last):
    return [float(values[item].get(str(START + i * DAY), 0)) for i in range((last - START).days + 1)]


@pytest.fixture(scope="module")
def daily(spark):
    return daily_rows(spark, series()).persist()


def test_direct_rows_equal_dense_computation(spark, daily):
    values = series()
    items = direct_models.choose(item_profile(daily, CUT), CFG)
    rows = by(direct.direct_dataset(daily, items, CUT, CFG), "item_code", "origin_date", "horizon")
    first_pos = max(364, (CUT - START).days - 120)
    origins = [START + p * DAY for p in range(first_pos, (CUT - START).days + 1, 30)]
    expected = {(i, o, h) for i in "ABD" for o in origins for h in range(1, 57) if o + (h - 1) * DAY <= CUT}
    assert set(rows) == expected
    for item, origin, h in random.Random(1).sample(sorted(expected), 60):
        row, past = rows[(item, origin, h)], dense(values, item, origin - DAY)
        for k in ORIGIN_LAGS:
            assert row[f"lag_{k}"] == past[-k]
        for n in ORIGIN_WINDOWS:
            assert row[f"mean_{n}"] == pytest.approx(sum(past[-n:]) / n)
            assert row[f"max_{n}"] == max(past[-n:])
            assert row[f"active_{n}"] == sum(v > 0 for v in past[-n:])
        assert row["days_since_last_sale"] == next(i for i, v in enumerate(reversed(past)) if v > 0)
        assert row["target"] == dense(values, item, CUT)[len(past) + h - 1]
        assert row["target_dow"] == (origin + (h - 1) * DAY).weekday()


def test_sample_weights_average_one(spark, daily):
    items = direct_models.choose(item_profile(daily, CUT), CFG)
    weights = [r["sample_weight"] for r in direct.sample_weights(daily, items, CUT).collect()]
    assert sum(weights) / len(weights) == pytest.approx(1.0)


def test_inactive_items_are_dropped_on_request(spark, daily):
    from dataclasses import replace

    late = daily.unionByName(daily_rows(spark, {"LATE": {"2024-08-31": 5000}}))
    items = direct_models.choose(item_profile(late, CUT), CFG)
    kept = direct.direct_dataset(late, items, CUT, CFG).select("item_code").distinct()
    active = direct.direct_dataset(late, items, CUT, replace(CFG, filter_inactive=True))
    assert "LATE" in {r[0] for r in kept.collect()}
    assert "LATE" not in {r[0] for r in active.select("item_code").distinct().collect()}


def test_newest_rows_cut_inside_an_origin(spark, daily):
    from dataclasses import replace

    items = direct_models.choose(item_profile(daily, CUT), CFG)
    rows = direct.direct_dataset(daily, items, CUT, CFG)
    small = replace(CFG, top_n=1, horizon=10)  # quota 80 of the newest rows
    got = direct.newest_rows(rows, small).select("origin_date", "horizon", "item_id").collect()
    order = sorted(rows.select("origin_date", "horizon", "item_id").collect())
    assert sorted(got) == order[-80:]


def test_future_features_use_everything_before_the_first_forecast_day(spark, daily):
    items = direct_models.choose(item_profile(daily, CUT), CFG)
    rows = by(direct.forecast_features(daily, items, CUT, CFG), "item_code", "horizon")
    assert len(rows) == 3 * 56
    assert rows[("A", 1)]["lag_1"] == dense(series(), "A", CUT)[-1]
    assert rows[("A", 56)]["target_date"] == CUT + 56 * DAY


def test_model_matrix_and_fallback(spark):
    items = ["SKU-A", "SKU-B"]
    listed = spark.createDataFrame([(i,) for i in items], "item_code string")
    frame = frames.inference_frame(forecast_gold(spark, items), listed, "2025-09-05")
    ids = models.item_ids(listed.filter("item_code = 'SKU-A'"))
    nine = SQLTransformer(statement="SELECT *, 9.0D AS _raw_prediction FROM __THIS__")
    out = models.predict_with_fallback(frame, nine, ids)
    rows = by(out, "item_code", "horizon")
    assert all(r["predicted_quantity"] == 9.0 and r["prediction_source"] == SOURCE_MODEL for (i, _), r in rows.items() if i == "SKU-A")
    assert all(
        r["predicted_quantity"] == max(r["lag_7"], 0.0) and r["prediction_source"] == SOURCE_FALLBACK
        for (i, _), r in rows.items()
        if i == "SKU-B"
    )
    matrix = models.model_matrix(frame, ids)
    assert {t for c, t in matrix.dtypes if c in MODEL_COLUMNS} == {"double"}
    assert {r["item_code_id"] for r in matrix.select("item_code_id").distinct().collect()} == {0.0, -1.0}
    counts = {r["prediction_source"]: r["rows"] for r in models.source_counts(out).collect()}
    assert counts == {SOURCE_MODEL: 56, SOURCE_FALLBACK: 56}


def test_item_ids_are_alphabetical(spark):
    names = [f"SKU-{n:03d}" for n in range(50)]
    shuffled = random.Random(2).sample(names, 50)
    rows = models.item_ids(spark.createDataFrame([(n,) for n in shuffled + shuffled], "item_code string")).collect()
    assert {r["item_code"]: r["item_code_id"] for r in rows} == {n: i for i, n in enumerate(names)}


def test_daily_model_from_features_to_published_forecast(spark, tmp_path):
    store, runs = TableStore(spark, str(tmp_path / "t")), RunStore(spark, str(tmp_path / "r"))
    store.replace_all("gold", feature_gold(spark))
    assert daily_model.build_features(store, "v1", 2, 20, 7)["rows"] == 2 * 20 * 7
    assert daily_model.build_features(store, "v2", 1, 3, 7)["rows"] == 21
    assert daily_model.build_features(store, "v2", 1, 2, 7)["rows"] == 14
    assert store.features("v1").count() == 280
    result = daily_model.train_and_evaluate(store, "v1", 7, models.DailyModelSettings(max_iter=2, max_depth=2))
    scopes = {r["scope"] for r in result.report.select("scope").distinct().collect()}
    assert scopes == {"overall", "horizon", "sku_group"} and isinstance(result.passed, bool)
    summary = daily_model.run_batch_forecast(
        store, runs, result.model, "gbt", "1", "v1", "2025-03-11", "run-1", 14, lookback_days=60
    )
    assert summary["rows_written"] == 28 and summary["prediction_source_counts"] == {SOURCE_MODEL: 28}
    assert runs.forecasts().filter(F.col("predicted_quantity") < 0).count() == 0
    with pytest.raises(Exception):
        daily_model.run_batch_forecast(
            store, runs, result.model, "gbt", "1", "v1", "2025-03-11", "run-2", 99, lookback_days=60
        )
    assert by(runs.runs(), "run_id")["run-2"]["status"] == "failed"


def test_saved_model_gives_the_same_forecast(spark, tmp_path):
    store, saved = TableStore(spark, str(tmp_path / "t")), ModelStore(spark, str(tmp_path / "m"))
    store.replace_all("gold", feature_gold(spark))
    daily_model.build_features(store, "v1", 2, 20, 7)
    result = daily_model.train_and_evaluate(store, "v1", 7, models.DailyModelSettings(max_iter=2, max_depth=2))
    ids = models.item_ids(store.features("v1"))
    with pytest.raises(ValueError, match="No Production"):
        saved.load("gbt")
    saved.save(result.model, ids, "gbt", "9", "v1")
    saved.save(result.model, ids.limit(1), "gbt", "10", "v1")
    assert saved.load("gbt")[2]["version"] == "10"
    saved.save(result.model, ids, "gbt", "2", "v1", stage="Production")
    with pytest.raises(ValueError, match="exists"):
        saved.save(result.model, ids, "gbt", "2", "v1")
    with pytest.raises(ValueError, match="Not a stage"):
        saved.save(result.model, ids, "gbt", "3", "v1", stage="Live")
    again = ModelStore(spark, str(tmp_path / "m"))
    model, items, row = again.load("gbt")
    assert (row["version"], row["feature_version"], row["passed"]) == ("2", "v1", True)
    gold, listed = store.gold(), ids.select("item_code")
    before = daily_model.forecast_rows(gold, listed, result.model, ids, "2025-03-11", 14).collect()
    after = daily_model.forecast_rows(gold, listed, model, items, "2025-03-11", 14).collect()
    assert sorted(map(str, before)) == sorted(map(str, after)) and len(after) == 28


def test_several_shares_equal_single_recursions(spark):
    frame = daily_rows(spark, {"A": {str(START + i * DAY): 2 for i in range(80)}, "B": {str(START): 3}})
    cut = START + 79 * DAY
    cfg = DirectConfig(top_n=1, horizon=8, end_of_selling_since=str(START))
    items = direct_models.choose(item_profile(frame, cut), cfg)
    table = recursive.recursive_forecasts(frame, items, Constant(), cut, cfg, [0.0, 0.5]).collect()
    for alpha in (0.0, 0.5):
        one = recursive.recursive_forecast(frame, items, Constant(), cut, cfg, alpha).collect()
        assert sorted(map(tuple, one)) == sorted(tuple(r)[1:] for r in table if r["alpha"] == alpha) and len(one) == 16


def test_two_stage_evaluation_and_future(spark, daily):
    result = direct_models.evaluate(daily, day("2024-08-31"), CFG)
    row = result.scores.first()
    assert row["hybrid_wrmsse"] <= row["baseline_wrmsse"] + 1e-9
    best = result.grid.agg(F.min("wrmsse_56")).first()[0]
    assert row["hybrid_wrmsse"] == pytest.approx(min(best, row["baseline_wrmsse"]))
    assert models.feature_importances(result.model, spark).count() == len(DIRECT_COLUMNS)
    wide = direct_models.forecast_future(daily, CUT, CFG, [0.5])[0.5].collect()
    assert [r["id"].split("_")[1] for r in wide] == ["validation"] * 4 + ["evaluation"] * 4
    sunday = f"F{next(h for h in range(1, 8) if (CUT + h * DAY).weekday() == 6)}"
    assert all(r[sunday] == 0.0 for r in wide[:4])


@pytest.mark.parametrize("family", ["two_stage", "tweedie"])
def test_saved_direct_models_forecast_the_same(spark, tmp_path, daily, family):
    items = direct_models.choose(item_profile(daily, CUT), CFG)
    profile = item_profile(daily, CUT)
    model = direct_models.fit_for(daily, items, profile, CUT, CUT, CFG, family)
    ids = models.item_ids(items)
    saved = ModelStore(spark, str(tmp_path))
    saved.save(model, ids, family, "1", "v1")
    again, _, row = ModelStore(spark, str(tmp_path)).load(family)
    assert row["family"] == family and json.loads(row["best_rounds"]) == models.best_rounds(model)
    rows = written_table(direct.forecast_features(daily, items, CUT, CFG))
    before, after = (sorted(map(str, m.predict(rows).select("item_code", "horizon", "yhat").collect())) for m in (model, again))
    assert before == after and len(before) == CFG.top_n * CFG.horizon
    curves = models.held_out_curves(model, spark)
    assert curves.filter("is_best").count() == len(model.parts())
    train = direct.direct_dataset(daily, items, CUT, CFG)
    exchanged = models.exchange_importances(model, train)
    assert exchanged.count() == len(DIRECT_COLUMNS)
    unused = {n for n, _, splits in model.regressor.importances() if not splits}
    if family == "tweedie":
        assert all(abs(r["importance"]) < 1e-9 for r in exchanged.collect() if r["feature"] in unused)


def test_shares_scored_together_equal_one_by_one(spark, daily):
    base = baselines.baseline_forecast(daily, CUT - 60 * DAY, "median_56")
    tried = base.withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).withColumn("yhat", F.col("yhat") * (1 + F.col("alpha")))
    weights = item_profile(daily, CUT - 60 * DAY)
    got = by(blend.share_grid(daily, tried, [0.0, 0.5, 1.0], weights, CUT - 60 * DAY), "alpha")
    for alpha in (0.0, 0.5, 1.0):
        one = scoring.wrmsse(scoring.wrmsse_by_item(daily, tried.filter(F.col("alpha") == alpha), weights, CUT - 60 * DAY)).first()["wrmsse"]
        assert got[alpha]["wrmsse_56"] == pytest.approx(one)


class Constant:
    """A model that always says 4."""

    def predict(self, rows):
        return rows.withColumn("yhat", F.lit(4.0) + 0.0 * F.col("lag_1"))


@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_recursion_equals_a_plain_loop(spark, alpha):
    values = {"A": {str(START + i * DAY): 2 for i in range(80)}, "B": {str(START + i * DAY): 3 for i in range(0, 80, 2)}}
    values["OLD"] = {str(START): 5}
    cut = START + 79 * DAY
    cfg = DirectConfig(top_n=1, horizon=10, end_of_selling_since=str(START + 5 * DAY))
    frame = daily_rows(spark, values)
    items = direct_models.choose(item_profile(frame, cut), cfg)
    rows = by(recursive.recursive_forecast(frame, items, Constant(), cut, cfg, alpha), "item_code", "horizon")
    chosen = items.first()["item_code"]
    for item in values:
        history = [float(values[item].get(str(START + i * DAY), 0)) for i in range(80)]
        for h in range(1, 11):
            target = cut + h * DAY
            recent = sorted(history[-56:])
            value = (recent[27] + recent[28]) / 2
            if item == chosen:
                value = alpha * 4.0 + (1 - alpha) * value
            if target.weekday() == 6 or sum(history[5:]) == 0:
                value = 0.0
            history.append(value)
            assert rows[(item, h)]["yhat"] == pytest.approx(value), (item, h)
            assert rows[(item, h)]["target_date"] == target


def test_recursion_with_trees_plans_each_day_alone(spark, monkeypatch):
    frame = daily_rows(spark, {"A": {str(START + i * DAY): i % 4 for i in range(80)}})
    cut, n = START + 79 * DAY, len(DIRECT_COLUMNS)
    # Both stages split on the last day's quantity, so a day depends on the forecast of the day before.
    def trees(loss, low, high):
        tree = boosting.Tree.empty(1)
        tree.feature[1], tree.threshold[1], tree.value[2], tree.value[3] = DIRECT_COLUMNS.index("lag_1"), 1.0, low, high
        return boosting.BoostedTrees(boosting.TreeSettings(loss), DIRECT_COLUMNS, 0.0, [tree])

    model = models.TwoStageModel(trees("logistic", 1.0, -1.0), trees("poisson", 1.5, 0.5))
    cfg = DirectConfig(top_n=1, horizon=2, end_of_selling_since=None, zero_sundays=False)
    items, sizes, cut_lineage = direct_models.choose(item_profile(frame, cut), cfg), [], recursive.reliable_checkpoint

    def checkpoint(state):
        if "alpha" in state.columns:
            sizes.append(len(state._jdf.queryExecution().optimizedPlan().toString()))
        return cut_lineage(state)

    monkeypatch.setattr(recursive, "reliable_checkpoint", checkpoint)
    rows = by(recursive.recursive_forecast(frame, items, model, cut, cfg, 0.5), "horizon")
    history = [float(i % 4) for i in range(80)]
    for h in (1, 2):
        x = np.zeros((1, n))
        x[0, DIRECT_COLUMNS.index("lag_1")] = history[-1]
        recent = sorted(history[-56:])
        history.append(0.5 * float(model.classifier.predict(x)[0] * model.regressor.predict(x)[0]) + 0.25 * (recent[27] + recent[28]))
        assert rows[h]["yhat"] == pytest.approx(history[-1])
    assert len(sizes) == 2 and max(sizes) < 1.5 * min(sizes)


def test_evaluation_report_json(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1.0, 2.0, 0.5, CUT, "A", 1, CUT), (3.0, 2.0, 0.7, CUT, "B", 1, CUT)],
        "target_quantity double, m double, sku_avg_sales double, target_date date, item_code string, horizon int, as_of_date date",
    )
    store = TableStore(spark, str(tmp_path))
    store.save_report("e", scoring.evaluation_report(frame, ["m"]))
    assert spark.read.json(store.path("reports/e")).count() == 4 * (1 + 1 + 2)
