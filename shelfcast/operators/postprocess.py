"""Business rules applied to a finished forecast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import KeyItemRule
from shelfcast.functions.dates import as_date
from shelfcast.functions.numbers import positive_part
from shelfcast.operators.panel import fill_gaps
from shelfcast.session import broadcast_if_bounded, scalar

SUNDAY = 6


def zero_sundays(forecast: DataFrame) -> DataFrame:
    """O1. No demand on Sundays."""
    closed = F.weekday("target_date") == SUNDAY
    return forecast.withColumn("yhat", F.when(closed, F.lit(0.0)).otherwise(F.col("yhat")))


def ended_items(daily: DataFrame, since: str | dt.date, until: str | dt.date) -> DataFrame:
    """Items of ``daily`` whose sales from ``since`` to ``until`` sum to zero; none when the range is empty."""
    low, high = as_date(since), as_date(until)
    recent = F.sum(F.when(F.col("date").between(low, high), F.col("sales_qty")))
    return daily.groupBy("item_code").agg(recent.alias("_recent")).filter(
        (F.coalesce("_recent", F.lit(0.0)) == 0) & (low <= high)
    ).select("item_code")


def zero_ended_items(
    forecast: DataFrame, daily: DataFrame, since: str | dt.date | None, until: str | dt.date
) -> DataFrame:
    """O2, U4. Zero items without any sale from ``since`` to ``until``; items unknown to ``daily`` stay."""
    if not since:
        return forecast
    ended = ended_items(daily, since, until).withColumn("_ended", F.lit(True))
    kept = F.when(F.col("_ended"), F.lit(0.0)).otherwise(F.col("yhat"))
    return forecast.join(ended, "item_code", "left").withColumn("yhat", kept).drop("_ended")


def apply_rules(
    forecast: DataFrame,
    daily: DataFrame,
    train_end: str | dt.date,
    sundays: bool = True,
    ended_since: str | None = "2025-01-01",
) -> DataFrame:
    """O3. Sundays first, then ended items, each only when switched on."""
    out = zero_sundays(forecast) if sundays else forecast
    return zero_ended_items(out, daily, ended_since, train_end)


def _rules_table(daily: DataFrame, rules: Sequence[KeyItemRule]) -> DataFrame:
    rows = [(r.item_code, float(r.alpha), r.n, r.stat, r.month_factor, r.trend) for r in rules]
    schema = "item_code string, alpha double, n int, stat string, month_factor boolean, trend boolean"
    return broadcast_if_bounded(daily.sparkSession.createDataFrame(rows, schema), len(rows))


def weekday_reference(
    daily: DataFrame,
    rules: Sequence[KeyItemRule],
    train_end: str | dt.date,
    horizon: int = 56,
    month_since: str | dt.date = "2022-01-01",
) -> DataFrame:
    """O4, W10. Reference forecast of the listed items from their last same-weekday values.

    The mean or median of the last ``n`` same weekdays, times a month factor (non-Sunday days since
    ``month_since``) and a trend factor (last 56 days against the 56 before); Sundays are 0. Only the few
    listed items are densified.
    """
    table = _rules_table(daily, rules)
    cut, day = as_date(train_end), F.col("date")
    first_day = scalar(daily, F.min("date"))
    sales = (
        daily.filter(day <= cut)
        .join(table.select("item_code"), "item_code", "left_semi")
        .groupBy("item_code", "date")
        .agg(F.sum("sales_qty").cast("double").alias("qty"))
    )
    known = daily.join(table.select("item_code"), "item_code", "left_semi").select("item_code").distinct()
    panel = fill_gaps(known.join(sales, "item_code", "left"), first_day, cut, {"qty": 0.0})
    panel = panel.withColumns({"dow": F.weekday(day), "month": F.month(day)}).join(table, "item_code")

    newest = F.row_number().over(Window.partitionBy("item_code", "dow").orderBy(F.desc("date")))
    same_weekday = (
        panel.withColumn("_age", newest)
        .filter(F.col("_age") <= F.col("n"))
        .groupBy("item_code", "dow")
        .agg(F.avg("qty").alias("_mean"), F.percentile("qty", F.lit(0.5)).alias("_median"))
    )
    open_since = (day >= as_date(month_since)) & (F.col("dow") != SUNDAY)
    by_month = panel.filter(open_since).groupBy("item_code", "month").agg(F.avg("qty").alias("_month_mean"))
    last = day > F.date_sub(cut, 56)
    before = ~last & (day > F.date_sub(cut, 112))
    per_item = panel.groupBy("item_code").agg(
        F.avg(F.when(open_since, F.col("qty"))).alias("_open_mean"),
        F.avg(F.when(last, F.col("qty"))).alias("_recent_mean"),
        F.avg(F.when(before, F.col("qty"))).alias("_previous_mean"),
        F.count(F.lit(1)).alias("_days"),
        *[F.first(c).alias(c) for c in ("alpha", "stat", "month_factor", "trend")],
    )
    targets = (
        per_item.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("target_date", F.date_add(cut, F.col("horizon")))
        .withColumns({"dow": F.weekday("target_date"), "month": F.month("target_date")})
        .join(same_weekday, ["item_code", "dow"], "left")
        .join(by_month, ["item_code", "month"], "left")
    )
    base = F.when(F.col("stat") == "mean", F.col("_mean")).otherwise(F.col("_median"))
    factor = F.when(
        F.col("month_factor") & F.col("_month_mean").isNotNull(),
        (F.col("_month_mean") + 1.0) / (F.col("_open_mean") + 1.0),
    ).otherwise(F.lit(1.0))
    previous = F.when(F.col("_days") >= 112, F.col("_previous_mean")).otherwise(F.col("_recent_mean"))
    trend = F.when(F.col("trend"), (F.col("_recent_mean") + 1.0) / (previous + 1.0)).otherwise(F.lit(1.0))
    value = F.when(F.col("dow") == SUNDAY, F.lit(0.0)).otherwise(positive_part(base * factor * trend))
    return targets.select("item_code", "target_date", "horizon", "alpha", value.alias("reference"))


def adjust_key_items(forecast: DataFrame, reference: DataFrame, max_rows: int | None = None) -> DataFrame:
    """O5. Pull the listed items toward their reference: alpha * reference + (1 - alpha) * current, clipped.

    Items with alpha <= 0 and all others are unchanged. ``max_rows`` is the proven size of ``reference``.
    """
    active = reference.filter(F.col("alpha") > 0).select("item_code", "target_date", "alpha", "reference")
    if max_rows is not None:
        active = broadcast_if_bounded(active, max_rows)
    mixed: Column = positive_part(
        F.col("alpha") * F.col("reference") + (1.0 - F.col("alpha")) * F.col("yhat")
    )
    return (
        forecast.join(active, ["item_code", "target_date"], "left")
        .withColumn("yhat", F.when(F.col("alpha").isNotNull(), mixed).otherwise(F.col("yhat")))
        .drop("alpha", "reference")
    )
