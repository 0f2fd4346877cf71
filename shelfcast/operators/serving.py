"""Queries on published forecasts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.dates import as_date
from shelfcast.functions.text import ITEM_CODE_PATTERN

RUN_COLUMNS = [
    "run_id",
    "forecast_date",
    "model_name",
    "model_version",
    "status",
    "row_count",
    "started_at",
    "finished_at",
    "error_message",
]


def current_runs(events: DataFrame) -> DataFrame:
    """W12. The latest event of each run; a run has few events, so its group is small."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("event_time"), F.desc("event_number"))
    return events.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") == 1).drop("_age")


def latest_run(runs: DataFrame, forecast_date: str | dt.date | None = None) -> DataFrame:
    """Q1, T4. The newest successful run, optionally of one forecast date; no row when there is none."""
    rows = runs.filter(F.col("status") == "success")
    if forecast_date is not None:
        rows = rows.filter(F.col("forecast_date") == as_date(forecast_date))
    return rows.orderBy(F.desc_nulls_last("finished_at"), F.desc("started_at")).limit(1)


def _of_latest_run(runs: DataFrame, forecasts: DataFrame, forecast_date=None) -> DataFrame:
    """Rows of the newest run; the run id is a scalar subquery, so it also prunes run partitions."""
    run_id = latest_run(runs, forecast_date).select("run_id").scalar()
    rows = forecasts.filter(F.col("run_id") == run_id)
    if "attempt" in forecasts.columns and "attempt" in runs.columns:
        rows = rows.filter(F.col("attempt") == latest_run(runs, forecast_date).select("attempt").scalar())
    return rows


def item_forecast(
    runs: DataFrame, forecasts: DataFrame, item_code: str, days: int, forecast_date: str | dt.date | None = None
) -> DataFrame:
    """Q2. The first ``days`` days of one item in the newest run, by horizon."""
    if not re.match(ITEM_CODE_PATTERN, item_code):
        raise ValueError("item_code must be 1 to 64 letters, digits, dots, underscores or dashes")
    if not 1 <= days <= 56:
        raise ValueError("days must be in 1..56")
    return (
        _of_latest_run(runs, forecasts, forecast_date)
        .filter((F.col("item_code") == item_code) & (F.col("horizon") <= days))
        .select("target_date", "horizon", "predicted_quantity")
        .orderBy("horizon")
    )


def top_items(
    runs: DataFrame, forecasts: DataFrame, target_date: str | dt.date, limit: int, offset: int = 0
) -> DataFrame:
    """Q3, T3. Items with the largest forecast on a day, paged."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be in 1..1000")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    return (
        _of_latest_run(runs, forecasts)
        .filter(F.col("target_date") == as_date(target_date))
        .select("item_code", "target_date", "horizon", "predicted_quantity")
        .orderBy(F.desc("predicted_quantity"), "item_code")
        .offset(offset)
        .limit(limit)
    )


def day_summary(runs: DataFrame, forecasts: DataFrame, target_date: str | dt.date) -> DataFrame:
    """Q4, A11. Count, total, mean and maximum of a day in the newest run; no row when the day is absent."""
    return (
        _of_latest_run(runs, forecasts)
        .filter(F.col("target_date") == as_date(target_date))
        .groupBy("target_date")
        .agg(
            F.count(F.lit(1)).alias("sku_count"),
            F.sum("predicted_quantity").alias("total_predicted_quantity"),
            F.avg("predicted_quantity").alias("avg_predicted_quantity"),
            F.max("predicted_quantity").alias("max_predicted_quantity"),
        )
    )


def choose_model_version(versions: DataFrame, model_name: str) -> DataFrame:
    """T7. Production before Staging, then the highest version; raises when neither exists.

    ``versions`` is the table of ``ModelStore``, whose rows hold the saved model's path.
    """
    stage_rank = F.when(F.col("stage") == "Production", 0).when(F.col("stage") == "Staging", 1)
    chosen = (
        versions.filter((F.col("name") == model_name) & stage_rank.isNotNull())
        .orderBy(stage_rank, F.desc(F.col("version").cast("long")))
        .limit(1)
    )
    if chosen.isEmpty():
        raise ValueError(f"No Production or Staging version for model '{model_name}'")
    return chosen
