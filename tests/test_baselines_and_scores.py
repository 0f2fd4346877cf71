import math
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import baselines, blend, postprocess, scoring, selection
from shelfcast.operators.panel import demand_panel
from shelfcast.operators.profile import item_profile
from tests.helpers import DAY, by, daily_rows, day

START, END = day("2024-01-01"), day("2024-12-31")


def random_series(seed: int = 7) -> dict:
    """Items with very different density, all within 2024; the first item fixes the first and last day."""
    rng = random.Random(seed)
    series = {"A": {str(START): 1, str(END): 2}}
    for item, chance in (("A", 0.9), ("B", 0.5), ("C", 0.1), ("D", 0.01)):
        values = series.setdefault(item, {})
        for i in range(366):
            if rng.random() < chance:
                values[str(START + i * DAY)] = rng.randint(1, 9)
    series["E"] = {"2024-02-01": 4, "2024-02-02": 4}
    return series


def dense(series: dict, item: str, last) -> list[float]:
    return [float(series[item].get(str(START + i * DAY), 0)) for i in range((last - START).days + 1)]


def median(values):
    ordered = sorted(values)
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@pytest.mark.parametrize("cut", ["2024-01-10", "2024-06-30", "2024-10-15"])
def test_baselines_equal_dense_computation(spark, cut):
    series = random_series()
    rows = by(baselines.baseline_forecasts(daily_rows(spark, series), cut, horizon=56), "item_code", "horizon")
    assert len(rows) == 5 * 56
    for (item, h), row in rows.items():
        past = dense(series, item, day(cut))
        assert row["zero"] == 0
        assert row["mean_28"] == pytest.approx(sum(past[-28:]) / len(past[-28:]))
        assert row["median_56"] == pytest.approx(median(past[-56:]))
        same = [past[len(past) - 1 + h - 7 * k] for k in range(1, 9) if 0 <= len(past) - 1 + h - 7 * k < len(past)]
        weekday = sum(same) / len(same) if same else 0.0
        assert row["same_weekday_8w"] == pytest.approx(weekday)
        mean_56 = sum(past[-56:]) / len(past[-56:])
        assert row["blend_mean_weekday"] == pytest.approx(0.45 * row["mean_28"] + 0.25 * mean_56 + 0.3 * weekday)
        active = sum(v > 0 for v in past)
        unsold = next((i for i, v in enumerate(reversed(past)) if v > 0), 9999)
        factor = 0.15 if active <= 2 else 0.35 if active <= 5 else 0.65 if active <= 15 else 1.0
        factor *= 0.05 if unsold > 180 else 0.35 if unsold > 90 else 0.7 if unsold > 56 else 1.0
        assert row["conservative_sparse"] == pytest.approx(median(past[-56:]) * factor)


def test_weekday_mean_runs_out_of_history(spark):
    rows = by(baselines.baseline_forecasts(daily_rows(spark, random_series()), "2024-06-30", weeks=2), "item_code", "horizon")
    assert all(rows[("A", h)]["same_weekday_8w"] == 0 for h in range(15, 57))
    assert any(rows[("A", h)]["same_weekday_8w"] > 0 for h in range(1, 15))


def test_blend_weights(spark):
    with pytest.raises(ValueError):
        baselines.weighted_blend({"mean_28": 0.0})
    long = spark.createDataFrame(
        [("a", "I", END, 2.0), ("b", "I", END, 6.0), ("c", "I", END, 99.0)],
        "model string, item_code string, target_date date, yhat double",
    )
    assert baselines.blend_forecasts(long, {"a": 3.0, "b": 1.0}).first()["yhat"] == 3.0


@pytest.mark.parametrize("cut", ["2024-01-01", "2024-02-01", "2024-02-02", "2024-12-31"])
def test_scale_equals_dense_computation(spark, cut):
    series = random_series()
    got = by(scoring.rmsse_denominators(daily_rows(spark, series), cut), "item_code")
    for item in series:
        past = dense(series, item, day(cut))
        first = next((i for i, v in enumerate(past) if v > 0), None)
        changes = [] if first is None else [(b - a) ** 2 for a, b in zip(past[first:], past[first + 1 :])]
        mean = sum(changes) / len(changes) if changes else 0.0
        assert got[item]["rmsse_denom"] == pytest.approx(mean if mean > 0 else 1.0), item


def wrmsse_dense(series, forecast, weights, cut, horizon):
    total, weight_sum = 0.0, sum(weights.values())
    for item, weight in weights.items():
        past, full = dense(series, item, cut), dense(series, item, END)
        actual = full[len(past) : len(past) + horizon]
        mse = sum((forecast(item, h) - a) ** 2 for h, a in enumerate(actual, 1)) / horizon
        first = next((i for i, v in enumerate(past) if v > 0), None)
        changes = [] if first is None else [(b - a) ** 2 for a, b in zip(past[first:], past[first + 1 :])]
        mean = sum(changes) / len(changes) if changes else 0.0
        total += weight / weight_sum * math.sqrt(mse / (mean if mean > 0 else 1.0))
    return total


def test_wrmsse_fills_missing_cells_with_zero(spark):
    series, cut = random_series(), day("2024-10-31")
    daily = daily_rows(spark, series)
    profile = item_profile(daily, cut)
    weights = {r["item_code"]: r["profit_weight"] for r in profile.collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    # Only item A is forecast, and only on even horizons.
    rows = [("A", cut + h * DAY, 3.0) for h in range(2, 57, 2)] + [("UNKNOWN", cut + DAY, 5.0)]
    forecast = spark.createDataFrame(rows, "item_code string, target_date date, yhat double")
    table = scoring.wrmsse_by_item(daily, forecast, profile, cut)
    assert {r["item_code"] for r in table.collect()} == set(series)
    expected = wrmsse_dense(series, lambda i, h: 3.0 if i == "A" and h % 2 == 0 else 0.0, weights, cut, 56)
    assert scoring.wrmsse(table).first()["wrmsse"] == pytest.approx(expected)
    top = scoring.wrmsse_by_item(daily, forecast, profile, cut, only_items=profile.filter("item_code = 'A'"))
    assert top.first()["weight"] == 1.0


def test_backtest_folds(spark):
    series = random_series()
    scores = scoring.backtest_baselines(daily_rows(spark, series), END)
    rows = by(scores, "fold", "model")
    assert len(rows) == 21
    assert rows[(3, "zero")]["train_end"] == END - 56 * DAY
    assert rows[(1, "zero")]["train_end"] == END - (56 + 56) * DAY
    cut = rows[(2, "zero")]["train_end"]
    weights = {i: sum(dense(series, i, cut)) for i in series}
    assert rows[(2, "zero")]["wrmsse_56"] == pytest.approx(wrmsse_dense(series, lambda i, h: 0.0, weights, cut, 56))
    assert rows[(2, "zero")]["wrmsse_28"] == pytest.approx(wrmsse_dense(series, lambda i, h: 0.0, weights, cut, 28))
    summary = scoring.summarize_backtest(scores).collect()
    assert [r["wrmsse_56"] for r in summary] == sorted(r["wrmsse_56"] for r in summary)


def test_profile_keeps_items_first_sold_after_the_cut(spark):
    daily = daily_rows(spark, {"A": {"2024-01-01": 2, "2024-01-10": 1}, "B": {"2024-01-20": 5}}, profit=-1.0)
    rows = by(item_profile(daily, "2024-01-10"), "item_code")
    assert rows["B"]["days_since_last_sale"] == 9999 and rows["B"]["last_sale_date"] is None
    assert rows["A"]["zero_ratio"] == pytest.approx(0.8)
    assert rows["A"]["avg_qty_when_active"] == 1.5
    assert rows["A"]["profit_weight"] == 0.0 and rows["A"]["positive_profit"] == 0.0


def test_selection_filters_before_the_cut_off(spark):
    rows = [("A", 0.5, 10, 100), ("B", 0.3, 60, 5), ("C", 0.2, 60, 90)]
    profile = spark.createDataFrame(
        rows, "item_code string, profit_weight double, active_days int, days_since_last_sale int"
    )

    def chosen(strategy, n=1):
        return [r["item_code"] for r in selection.select_items(profile, strategy, n).collect()]

    assert chosen("top_profit") == ["A"]
    assert chosen("active_top_profit", 2) == ["B", "C"]
    assert chosen("recent_top_profit", 2) == ["B"]
    assert chosen("active_recent_top_profit") == ["B"]
    with pytest.raises(ValueError):
        selection.select_items(profile, "unknown")


def test_plain_metrics(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "target_quantity double, m double")
    row = scoring.metrics_table(frame, ["m"]).first()
    assert row["wape"] == 0.5 and row["mae"] == 1.0 and row["rmse"] == 1.0
    zeros = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0)], "target_quantity double, m double")
    assert scoring.metrics_table(zeros, ["m"]).first()["smape"] == 0.0


def test_registration_rule(spark):
    rows = [("overall", "all", "gbt", "wape", 1.04), ("overall", "all", "b", "wape", 1.0)]
    schema = "scope string, `group` string, model string, metric string, value double"
    report = spark.createDataFrame(rows, schema)
    assert scoring.passes_registration_rule(report, "gbt", ["b"]).first()["passed"] is True
    worse = report.withColumn("value", F.when(F.col("model") == "gbt", 1.06).otherwise(F.col("value")))
    assert scoring.passes_registration_rule(worse, "gbt", ["b"]).first()["passed"] is False


def test_blend_grid_equals_scoring_each_alpha(spark):
    series, cut = random_series(), day("2024-10-31")
    daily = daily_rows(spark, series)
    profile = item_profile(daily, cut)
    base = baselines.baseline_forecast(daily, cut, "median_56")
    model = baselines.baseline_forecast(daily, cut, "same_weekday_8w").filter("item_code IN ('A', 'B')")
    grid = by(blend.blend_grid(daily, base, model, profile, cut), "alpha")
    assert len(grid) == 21
    for alpha in (0.0, 0.35, 1.0):
        candidate = blend.blend_with_model(base, model, alpha)
        score = scoring.wrmsse(scoring.wrmsse_by_item(daily, candidate, profile, cut)).first()["wrmsse"]
        assert grid[min(grid, key=lambda a: abs(a - alpha))]["wrmsse_56"] == pytest.approx(score)


def test_best_alpha_ties_and_no_gain(spark):
    grid = spark.createDataFrame([(0.0, 1.0), (0.1, 0.8), (0.2, 0.8)], "alpha double, wrmsse_56 double")
    assert blend.best_alpha(grid, 1.0) == 0.1
    assert blend.best_alpha(grid, 0.8) == 0.0


def test_rules_for_sundays_and_ended_items(spark):
    daily = daily_rows(spark, {"A": {"2024-01-01": 1, "2024-06-01": 1}, "B": {"2024-01-05": 1}})
    rows = [(i, day("2024-06-30") + h * DAY, h, 5.0) for i in ("A", "B", "C") for h in range(0, 2)]
    forecast = spark.createDataFrame(rows, "item_code string, target_date date, horizon int, yhat double")
    ruled = by(postprocess.apply_rules(forecast, daily, "2024-06-29", True, "2024-03-01"), "item_code", "horizon")
    assert [ruled[(i, 0)]["yhat"] for i in "ABC"] == [0, 0, 0]  # 2024-06-30 is a Sunday
    assert [ruled[(i, 1)]["yhat"] for i in "ABC"] == [5, 0, 5]  # B ended, C is unknown to the history
    untouched = postprocess.zero_ended_items(forecast, daily, "2024-09-01", "2024-06-29")
    assert untouched.agg(F.min("yhat")).first()[0] == 5.0


def test_weekday_reference_equals_dense_computation(spark):
    from shelfcast.config import KeyItemRule

    series, cut = random_series(), day("2024-10-31")
    rules = [KeyItemRule("A", 0.5, 8, "median", True, True), KeyItemRule("C", 0.2, 3, "mean", False, False)]
    got = by(
        postprocess.weekday_reference(daily_rows(spark, series), rules, cut, month_since="2024-03-01"), "item_code", "horizon"
    )
    for rule in rules:
        past = dense(series, rule.item_code, cut)
        days = [START + i * DAY for i in range(len(past))]
        mean = lambda v: sum(v) / len(v)
        opened = [(d, v) for d, v in zip(days, past) if d >= day("2024-03-01") and d.weekday() != 6]
        for h in range(1, 57):
            target = cut + h * DAY
            same = [v for d, v in zip(days, past) if d.weekday() == target.weekday()][-rule.n :]
            value = mean(same) if rule.stat == "mean" else median(same)
            month = [v for d, v in opened if d.month == target.month]
            if rule.month_factor and month:
                value *= (mean(month) + 1) / (mean([v for _, v in opened]) + 1)
            if rule.trend:
                value *= (mean(past[-56:]) + 1) / (mean(past[-112:-56]) + 1)
            expected = 0.0 if target.weekday() == 6 else max(value, 0.0)
            assert got[(rule.item_code, h)]["reference"] == pytest.approx(expected)


def test_panel_is_independent_of_shuffle_partitions(spark):
    daily = daily_rows(spark, random_series())
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(
            (sorted(demand_panel(daily).collect()), sorted(baselines.baseline_forecasts(daily, "2024-06-30").collect()))
        )
    assert results[0] == results[1]
