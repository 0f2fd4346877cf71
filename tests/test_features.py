import pytest
from pyspark.sql import functions as F

from shelfcast.config import HISTORY_COLUMNS
from shelfcast.functions.dates import as_date
from shelfcast.operators import frames, panel
from shelfcast.operators.history import history_as_of, history_features
from shelfcast.operators.panel import demand_panel, inference_panel, listed_gold
from shelfcast.operators.quality import FEATURE_GATES, QualityError, feature_quality, require_clean
from tests.helpers import GOLD_SCHEMA, by, daily_rows, day, feature_gold, forecast_gold

LEAKY = [c for c in HISTORY_COLUMNS] + ["sku_first_sale_date"]


def test_training_frame_shape_and_target(spark):
    frame = frames.training_frame(feature_gold(spark), "v1", 2, 3, 7)
    rows = by(frame, "item_code", "as_of_date", "horizon")
    assert len(rows) == 2 * 3 * 7
    row = rows[("SKU-A", day("2025-03-04"), 1)]
    assert row["target_date"] == day("2025-03-05")
    assert (row["target_quantity"], row["lag_1"]) == (3.0, 1.0)
    report = require_clean(feature_quality(frame), FEATURE_GATES, "Feature")
    assert (report["rows"], report["skus"], report["as_of_dates"], report["horizons"]) == (42, 2, 3, 7)


def test_target_day_does_not_leak(spark):
    key = ("SKU-A", day("2025-03-04"), 1)
    plain = by(frames.training_frame(feature_gold(spark), "v1", 2, 3, 7), "item_code", "as_of_date", "horizon")[key]
    planted = by(
        frames.training_frame(feature_gold(spark, 10_000.0), "v1", 2, 3, 7), "item_code", "as_of_date", "horizon"
    )[key]
    assert planted["target_quantity"] == 10_000.0
    assert {c: planted[c] for c in LEAKY} == {c: plain[c] for c in LEAKY}


def test_later_rows_never_move_features(spark):
    gold = feature_gold(spark)
    cut = day("2025-02-20")
    changed = gold.withColumn(
        "quantity_sold", F.when(F.col("date") >= cut, F.col("quantity_sold") * 7 + 3).otherwise(F.col("quantity_sold"))
    ).withColumn("avg_unit_price", F.when(F.col("date") >= cut, F.lit(1.0)).otherwise(F.col("avg_unit_price")))
    items = gold.select("item_code").distinct()
    before, after = (
        sorted(
            history_features(panel.training_panel(g, items)).filter(F.col("date") <= cut).select("item_code", "date", *LEAKY).collect()
        )
        for g in (gold, changed)
    )
    assert before == after


def test_frame_arguments(spark):
    with pytest.raises(ValueError):
        frames.training_frame(feature_gold(spark), "v1", 2, 3, 57)
    short = feature_gold(spark).filter(F.col("date") < day("2025-01-05"))
    with pytest.raises(ValueError):
        frames.require_rows(frames.training_frame(short, "v1", 2, 3, 56), "too short")


def test_rolling_statistics_of_shifted_series(spark):
    quantities = [0, 3, 0, 2, 0, 5]
    rows = [("A", day(f"2025-01-0{i + 1}"), float(q), 0.0, None) for i, q in enumerate(quantities)]
    gold = spark.createDataFrame(rows, GOLD_SCHEMA)
    shown = history_features(panel.training_panel(gold, gold)).orderBy("date").collect()
    # Seven-day windows over a six-day series are expanding; the artificial first zero counts.
    assert [round(r["rolling_mean_7"], 4) for r in shown] == [0, 0, 1, 0.75, 1, 0.8333]
    assert [round(r["rolling_std_7"], 4) for r in shown] == [0, 0, 1.7321, 1.5, 1.4142, 1.3292]
    assert [r["sku_median_sales"] for r in shown] == [0, 0, 0, 0, 0, 0]
    assert [r["sku_lifecycle_days"] for r in shown] == [0, 0, 1, 2, 3, 4]


@pytest.mark.parametrize("as_of", ["2025-01-01", "2025-01-02", "2025-01-20", "2025-03-01", "2025-03-11"])
def test_sparse_history_equals_dense_history(spark, as_of):
    gold = feature_gold(spark).filter(
        (F.dayofmonth("date") % 3 != 0) | (F.col("item_code") == "SKU-A")
    ).withColumn("avg_unit_price", F.when(F.dayofmonth("date") != 7, F.col("avg_unit_price")))
    gold = gold.unionByName(gold.limit(1).withColumn("item_code", F.lit("SKU-C")))
    items = spark.createDataFrame([("SKU-A",), ("SKU-B",), ("SKU-C",), ("SKU-NEW",)], "item_code string")
    known = gold.filter(F.col("date") <= day(as_of))
    dense = history_features(inference_panel(known, items, as_of)).filter(F.col("date") == day(as_of))
    sparse = history_as_of(listed_gold(known, items), as_date(as_of), as_date("2025-01-01"))
    expected, got = by(dense, "item_code"), by(sparse, "item_code")
    assert set(got) == set(expected) == {"SKU-A", "SKU-B", "SKU-C", "SKU-NEW"}
    for item, row in expected.items():
        for column in LEAKY:
            want, have = row[column], got[item][column]
            if isinstance(want, float):
                assert have == pytest.approx(want, abs=1e-9), (item, column)
            else:
                assert have == want, (item, column)


def test_inference_frame_covers_all_items(spark):
    items = ["SKU-A", "SKU-B", "SKU-C"]
    gold = forecast_gold(spark, items)
    listed = spark.createDataFrame([(i,) for i in items], "item_code string")
    rows = frames.inference_frame(gold, listed, "2025-09-05").collect()
    assert len(rows) == 3 * 56
    assert all((r["target_date"] - r["forecast_date"]).days == r["horizon"] for r in rows)
    assert {r["as_of_date"] for r in rows} == {day("2025-09-05")}


def test_feature_gate(spark):
    frame = frames.training_frame(feature_gold(spark), "v1", 2, 3, 7)
    broken = frame.unionByName(frame.limit(1)).withColumn("lag_7", F.lit(float("inf")))
    report = feature_quality(broken).first()
    assert report["duplicate_keys"] == 1 and report["infinite_features"] == 43
    with pytest.raises(QualityError, match="duplicate_keys"):
        require_clean(feature_quality(broken), FEATURE_GATES, "Feature")


def test_time_split(spark):
    frame = frames.training_frame(feature_gold(spark), "v1", 2, 3, 7)
    train, validation = frames.time_split(frame, 4)
    assert validation.agg(F.min("target_date")).first()[0] == day("2025-03-08")
    assert train.agg(F.max("target_date")).first()[0] == day("2025-03-07")
    assert train.count() + validation.count() == 42


def test_demand_panel_fills_every_day(spark):
    daily = daily_rows(spark, {"A": {"2025-01-02": 3, "2025-01-05": 1}, "B": {"2025-01-01": 2}})
    rows = by(demand_panel(daily), "item_code", "date")
    assert len(rows) == 10
    assert [rows[("A", day(f"2025-01-0{i}"))]["qty"] for i in range(1, 6)] == [0, 3, 0, 0, 1]
    assert [rows[("B", day(f"2025-01-0{i}"))]["qty"] for i in range(1, 6)] == [2, 0, 0, 0, 0]


def test_speed_split_with_odd_rows_and_hot_value(spark):
    from shelfcast.operators.scoring import with_speed_group

    rows = [(0.0, day("2025-01-01"), f"I{i}", 1, day("2024-12-31")) for i in range(5)]
    frame = spark.createDataFrame(
        rows, "sku_avg_sales double, target_date date, item_code string, horizon int, as_of_date date"
    )
    groups = by(with_speed_group(frame), "item_code")
    assert [groups[f"I{i}"]["sku_group"] for i in range(5)] == ["slow_moving"] * 3 + ["fast_moving"] * 2


def test_global_row_number_matches_a_sort(spark):
    from shelfcast.functions.ranking import with_global_row_number

    frame = spark.range(1000).select((F.col("id") % 7).alias("v"), "id")
    rows = with_global_row_number(frame, [F.col("v"), F.col("id")], "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["v"], r["id"]))] == list(range(1, 1001))
