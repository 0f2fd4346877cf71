"""Keys, slices, headers and empty inputs that must not pass silently."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.config import RAW_COLUMNS
from shelfcast.contract.transactions import _item
from shelfcast.plans.daily_model import run_batch_forecast
from shelfcast.sources.raw_csv import read_raw
from shelfcast.sources.runs import RunStore
from shelfcast.sources.tables import TableStore
from tests.helpers import forecast_gold


def test_part_keys_of_six_digits_stay_apart(spark):
    keys = spark.createDataFrame([(7,), (19999,), (199990,), (199991,), (1999900,)], "l_partkey long")
    items = [r[0] for r in keys.select(_item("part")).collect()]
    assert items == ["SKU-00007", "SKU-19999", "SKU-199990", "SKU-199991", "SKU-1999900"]


def test_a_replaced_slice_keeps_nothing_old(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda batch, n: spark.createDataFrame([(batch, i) for i in range(n)], "batch_id string, x int")
    store.replace_slice("raw", rows("b1", 2), "b1")
    store.replace_slice("raw", rows("b2", 3), "b2")
    store.replace_slice("raw", rows("b1", 1).limit(0), "b1")
    assert [store.batch("raw", b).count() for b in ("b1", "b2")] == [0, 3]
    store.replace_slice("raw", rows("b2", 1), "b2")
    assert store.read("raw").count() == 1
    with pytest.raises(Exception, match="another batch_id"):
        store.replace_slice("raw", rows("b2", 1), "b1")
    with pytest.raises(ValueError):
        store.replace_slice("raw", rows("b2", 1), "../b1")


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    numbers = lambda *values: spark.createDataFrame([(v,) for v in values], "x int").repartition(3)
    with pytest.raises(ValueError, match="no such rows"):
        store.gold()
    store.replace_all("gold", numbers(1, 2, 3))
    before = store.gold()
    broken = numbers(*range(50)).withColumn("x", F.when(F.col("x") == 49, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        store.replace_all("gold", broken)
    assert sorted(r["x"] for r in store.gold().collect()) == [1, 2, 3]
    # A table may be replaced by rows read from itself, and readers that began earlier still find theirs.
    store.replace_all("gold", store.gold().withColumn("x", F.col("x") * 10))
    assert sorted(r["x"] for r in store.gold().collect()) == [10, 20, 30]
    assert sorted(r["x"] for r in before.collect()) == [1, 2, 3]
    for n in range(4):
        store.replace_all("gold", numbers(n))
    assert [r["x"] for r in store.gold().collect()] == [3]
    assert len(list((tmp_path / "gold").glob("_version=*"))) == 3  # newest, the one before, and the broken one


def test_text_is_numbered_without_a_shuffle(spark, tmp_path):
    header = ",".join(RAW_COLUMNS)
    for name in ("a.csv", "b.csv"):
        lines = [f"2025-01-01,{i},SKU-{i}, 1,1,1,1,1" for i in range(200)]
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")
    rows = read_raw(spark, str(tmp_path), "b1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    got = sorted((r["source_file"], r["source_row_number"], r["stt_raw"]) for r in rows.collect())
    assert got == [(f, i + 1, str(i)) for f in ("a.csv", "b.csv") for i in range(200)]


def test_every_header_of_a_folder_is_checked(spark, tmp_path):
    good, bad = ",".join(RAW_COLUMNS), ",".join([RAW_COLUMNS[1], RAW_COLUMNS[0], *RAW_COLUMNS[2:]])
    for name, header in (("a.csv", good), ("b.csv", bad)):
        (tmp_path / name).write_text(f"{header}\n2025-01-01,1,SKU-01,1,1,1,1,1\n")
    with pytest.raises(Exception, match="(?i)header|Unexpected raw columns"):
        read_raw(spark, str(tmp_path), "b1").collect()


def test_an_empty_window_is_no_forecast(spark, tmp_path):
    store, runs = TableStore(spark, str(tmp_path / "t")), RunStore(spark, str(tmp_path / "s"))
    store.replace_all("gold", forecast_gold(spark, ["SKU-A"]))
    features = spark.createDataFrame([("v1", "SKU-A", dt.date(2025, 1, 1))], "feature_version string, item_code string, as_of_date date")
    store.replace_slice("features", features, "v1")
    with pytest.raises(ValueError, match="empty"):
        run_batch_forecast(store, runs, None, "gbt", "1", "v1", "2030-01-01", "run-1")
    assert runs.runs().filter(F.col("run_id") == "run-1").first()["status"] == "failed"


def test_clusters_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
