import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.config import RAW_COLUMNS
from shelfcast.operators import quality, serving, wide
from shelfcast.plans import ingest
from shelfcast.plans.daily_model import load_wide_forecast
from shelfcast.sources.raw_csv import check_header, read_raw, read_wide_forecast
from shelfcast.sources.runs import RunStore
from shelfcast.sources.tables import TableStore
from tests.helpers import DAY, by, day

FORECAST_DATE = day("2025-09-05")


def wide_file(folder, rows=None, header=None):
    rows = rows or [
        [f"{item}_{half}", *[float(i + shift) for i in range(1, 29)]]
        for shift, (item, half) in enumerate(
            [("SKU-00001", "validation"), ("SKU-00002", "validation"), ("SKU-00001", "evaluation"), ("SKU-00002", "evaluation")]
        )
    ]
    path = folder / "wide.csv"
    lines = [",".join(header or ["id", *wide.VALUE_COLUMNS])] + [",".join(str(v) for v in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path), rows


def forecast(spark, items, source="gbt"):
    rows = [
        (FORECAST_DATE, i, FORECAST_DATE + h * DAY, h, float(h % 5), source) for i in items for h in range(1, 57)
    ]
    return spark.createDataFrame(
        rows,
        "forecast_date date, item_code string, target_date date, horizon int, predicted_quantity double, prediction_source string",
    )


def items(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item_code string")


def test_wide_to_long(spark, tmp_path):
    path, _ = wide_file(tmp_path)
    frame = read_wide_forecast(spark, path)
    wide.require_valid_wide(frame)
    rows = by(wide.to_long(frame, FORECAST_DATE), "item_code", "horizon")
    assert len(rows) == 112
    dates = [rows[("SKU-00001", h)]["target_date"] for h in (1, 56)]
    assert dates == [day("2025-09-06"), day("2025-10-31")]
    assert rows[("SKU-00001", 29)]["predicted_quantity"] == 3.0


def test_wide_round_trip_and_order(spark, tmp_path):
    frame = read_wide_forecast(spark, wide_file(tmp_path)[0])
    long = wide.to_long(frame, FORECAST_DATE).withColumnRenamed("predicted_quantity", "yhat")
    back = wide.in_file_order(wide.to_wide(long))
    assert [r["id"] for r in back.collect()] == [r["id"] for r in frame.collect()]
    assert sorted(back.collect()) == sorted(frame.collect())


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda rows: rows[0].__setitem__(3, -1.0), "negative"),
        (lambda rows: rows[0].__setitem__(3, ""), "missing"),
        (lambda rows: rows.pop(), "56"),
        (lambda rows: rows.append(rows[0]), "duplicate"),
    ],
)
def test_wide_checks(spark, tmp_path, change, message):
    _, rows = wide_file(tmp_path)
    change(rows)
    frame = read_wide_forecast(spark, wide_file(tmp_path, rows)[0])
    with pytest.raises(ValueError, match=message):
        wide.require_valid_wide(frame)


def test_wide_header_and_foreign_ids(spark, tmp_path):
    with pytest.raises(ValueError):
        read_wide_forecast(spark, wide_file(tmp_path, header=["id", *reversed(wide.VALUE_COLUMNS)])[0])
    _, rows = wide_file(tmp_path)
    frame = read_wide_forecast(spark, wide_file(tmp_path, [*rows, ["SKU-9_other", *[1.0] * 28]])[0])
    wide.require_valid_wide(frame)
    assert wide.to_long(frame, FORECAST_DATE).count() == 112


def test_cover_ids_and_replace_items(spark, tmp_path):
    frame = read_wide_forecast(spark, wide_file(tmp_path)[0])
    ids = frame.select("id")
    assert wide.cover_ids(ids, frame).count() == 4
    with pytest.raises(ValueError):
        wide.cover_ids(ids.union(spark.createDataFrame([("X_validation",)], "id string")), frame)
    new = spark.createDataFrame([("SKU-00002", h, 100.0 + h) for h in range(1, 57)], "item_code string, horizon int, yhat double")
    rows = by(wide.replace_items(frame, new), "id")
    assert rows["SKU-00002_evaluation"]["F28"] == 156.0 and rows["SKU-00001_validation"]["F1"] == 1.0
    with pytest.raises(ValueError):
        wide.replace_items(frame, new.limit(55))
    with pytest.raises(ValueError):
        wide.replace_items(frame.filter("id <> 'SKU-00002_evaluation'"), new)


def test_forecast_gate(spark):
    frame, expected = forecast(spark, ["SKU-A", "SKU-B"]), items(spark, "SKU-A", "SKU-B")
    report = quality.require_clean(quality.forecast_quality(frame, expected), quality.FORECAST_GATES, "Forecast")
    assert (report["rows"], report["skus"], report["horizons"], report["expected_skus"]) == (112, 2, 56, 2)
    cases = {
        "missing_skus": (frame, items(spark, "SKU-A", "SKU-B", "SKU-MISSING")),
        "duplicate_keys": (frame.unionByName(frame.limit(1)), expected),
        "negative_predictions": (frame.withColumn("predicted_quantity", -F.col("horizon").cast("double")), expected),
        "null_predictions": (frame.withColumn("predicted_quantity", F.lit(float("nan"))), expected),
        "wrong_target_date": (frame.withColumn("target_date", F.date_add("target_date", 1)), expected),
        "invalid_horizons": (frame.withColumn("horizon", F.col("horizon") + 1), expected),
    }
    for gate, (broken, wanted) in cases.items():
        with pytest.raises(quality.QualityError, match=gate):
            quality.require_clean(quality.forecast_quality(broken, wanted), quality.FORECAST_GATES, "Forecast")


def test_publish_is_idempotent_and_isolated(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.publish("r1", FORECAST_DATE, "m", "1", forecast(spark, ["A", "B"])) == 112
    assert store.publish("r2", FORECAST_DATE, "m", "1", forecast(spark, ["C"])) == 56
    assert store.publish("r1", FORECAST_DATE, "m", "1", forecast(spark, ["A"])) == 56
    counts = {r["run_id"]: r["count"] for r in store.forecasts().groupBy("run_id").count().collect()}
    assert counts == {"r1": 56, "r2": 56}
    assert serving.latest_run(store.runs()).first()["run_id"] == "r1"
    assert serving.item_forecast(store.runs(), store.forecasts(), "A", 5).count() == 5
    assert serving.item_forecast(store.runs(), store.forecasts(), "B", 5).count() == 0
    assert serving.day_summary(store.runs(), store.forecasts(), "2025-09-06").first()["sku_count"] == 1


def test_failed_run_keeps_no_rows_and_a_short_message(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.publish("good", FORECAST_DATE, "m", "1", forecast(spark, ["A"]))
    broken = forecast(spark, ["B"]).withColumn("predicted_quantity", F.expr("raise_error('x')").cast("double"))
    with pytest.raises(Exception):
        store.publish("bad", FORECAST_DATE, "m", "1", broken)
    store.record_failure("long", FORECAST_DATE, "m", "1", "e" * 5000)
    runs = by(store.runs(), "run_id")
    assert runs["bad"]["status"] == "failed" and len(runs["bad"]["error_message"]) <= 2000
    assert len(runs["long"]["error_message"]) == 2000
    assert serving.latest_run(store.runs()).first()["run_id"] == "good"
    assert {r["run_id"] for r in store.forecasts().select("run_id").distinct().collect()} == {"good"}


def test_failed_rerun_hides_the_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.publish("r", FORECAST_DATE, "m", "1", forecast(spark, ["A"]))
    store.record_failure("r", FORECAST_DATE, "m", "1", "later failure")
    assert serving.latest_run(store.runs()).count() == 0


def test_load_wide_forecast_as_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    frame = read_wide_forecast(spark, wide_file(tmp_path)[0])
    assert load_wide_forecast(store, frame, FORECAST_DATE, "w1", "approved", "1") == 112
    with pytest.raises(ValueError):
        load_wide_forecast(store, frame.limit(3), FORECAST_DATE, "w2", "approved", "1")
    assert by(store.runs(), "run_id")["w2"]["status"] == "failed"


def test_latest_run_ordering(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [
        ("a", "success", t, t + dt.timedelta(hours=1)),
        ("b", "success", t + dt.timedelta(hours=2), None),
        ("c", "failed", t, t + dt.timedelta(days=1)),
        ("d", "success", t + dt.timedelta(minutes=1), t + dt.timedelta(hours=1)),
    ]
    runs = spark.createDataFrame(rows, "run_id string, status string, started_at timestamp, finished_at timestamp")
    assert serving.latest_run(runs).first()["run_id"] == "d"


def test_argument_checks(spark):
    frame = spark.createDataFrame([], "run_id string, status string")
    for call in (
        lambda: serving.item_forecast(frame, frame, "bad code", 5),
        lambda: serving.item_forecast(frame, frame, "A", 57),
        lambda: serving.top_items(frame, frame, "2025-01-01", 0),
        lambda: serving.top_items(frame, frame, "2025-01-01", 5, -1),
    ):
        with pytest.raises(ValueError):
            call()


def test_model_version_choice(spark):
    rows = [("m", "9", "Production"), ("m", "10", "Production"), ("m", "11", "Staging"), ("n", "12", "None")]
    versions = spark.createDataFrame(rows, "name string, version string, stage string")
    assert serving.choose_model_version(versions, "m").first()["version"] == "10"
    with pytest.raises(ValueError):
        serving.choose_model_version(versions, "n")


def transactions_file(folder, rows=3, name="t.csv", header=None):
    path = folder / name
    lines = [",".join(header or RAW_COLUMNS)]
    lines += [f'2025-01-0{i % 3 + 1},{i},sku-0{i % 2 + 1},{i % 4 + 1},"12,5",25,"5,0",10' for i in range(rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_header_contract(spark, tmp_path):
    assert check_header(spark, transactions_file(tmp_path)) == RAW_COLUMNS
    with pytest.raises(ValueError):
        check_header(spark, transactions_file(tmp_path, name="u.csv", header=list(reversed(RAW_COLUMNS))))
    with pytest.raises(Exception):
        check_header(spark, str(tmp_path / "absent.csv"))


def test_row_numbers_are_contiguous_in_file_order(spark, tmp_path):
    path = transactions_file(tmp_path, rows=3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        raw = read_raw(spark, path, "b1")
        assert raw.select("stt_raw").rdd.getNumPartitions() > 3
        rows = sorted(raw.collect(), key=lambda r: r["source_row_number"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["source_row_number"] for r in rows] == list(range(1, 3001))
    assert [int(r["stt_raw"]) for r in rows] == list(range(3000))
    assert rows[0]["source_file"] == "t.csv" and rows[0]["unit_price_raw"] == "12,5"


def test_empty_fields_are_empty_text(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(",".join(RAW_COLUMNS) + '\n2025-01-01,1,,"",,1,2,3\n')
    row = read_raw(spark, str(path), "b1").first()
    assert (row["item_code_raw"], row["quantity_raw"], row["unit_price_raw"]) == ("", "", "")


def test_ingest_batches(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    first, second = transactions_file(tmp_path, 30, "a.csv"), transactions_file(tmp_path, 12, "b.csv")
    assert ingest.run_stage(spark, store, first, "b1")["gold_rows"] == 6
    ingest.run_stage(spark, store, second, "b2")
    ingest.run_stage(spark, store, second, "b2")
    counts = {r["batch_id"]: r["count"] for r in store.read("silver").groupBy("batch_id").count().collect()}
    assert counts == {"b1": 30, "b2": 12}
    assert store.gold().agg(F.sum("transaction_count")).first()[0] == 12  # gold holds the last batch only
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(RAW_COLUMNS) + '\nbad,1,A,1,"1,0",1,"1,0",1\n')
    with pytest.raises(quality.QualityError):
        ingest.run_stage(spark, store, str(bad), "b3")
    assert store.gold().agg(F.sum("transaction_count")).first()[0] == 12


def test_staged_ingest_and_foundation(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    path = transactions_file(tmp_path, 30)
    for stage in ("validate", "raw", "bronze", "silver", "gold", "quality"):
        report = ingest.run_stage(spark, store, path, "b1", stage)
    assert report["silver_rows"] == 30
    with pytest.raises(ValueError):
        ingest.run_stage(spark, store, path, "b1", "unknown")
    assert ingest.build_foundation(spark, store, path).count() == 21
