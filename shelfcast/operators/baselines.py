"""Baseline forecasters from sparse daily rows.

One statistics row per item and cut day carries everything a baseline needs; zeros are implied by day
counts. Forecast days are then generated next to that row, so any number of models costs one shuffle by item.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import BLEND_WEIGHTS, MAX_HORIZON, NEVER_SOLD_DAYS
from shelfcast.functions.dates import to_day, with_horizons
from shelfcast.functions.numbers import median_with_zeros, positive_part
from shelfcast.session import broadcast_if_bounded, scalar, spread

MODELS = [
    "zero",
    "mean_28",
    "mean_56",
    "median_56",
    "same_weekday_8w",
    "conservative_sparse",
    "blend_mean_weekday",
]


def cut_statistics(
    daily: DataFrame,
    train_ends: Sequence[str | dt.date],
    horizon: int = MAX_HORIZON,
    window: int = 56,
    weeks: int = 8,
) -> DataFrame:
    """One row per item and cut day: window sums, sorted recent sales, activity, recency, squared changes.

    ``recent`` maps the sold days of the last weeks and of the forecast days to quantities; its size is
    bounded by those windows. Rows are shuffled by item once; the cuts multiply them only inside the tasks.
    """
    day, quantity = F.col("date"), F.col("sales_qty")
    look_back = max(window, 7 * weeks)
    cuts = F.array(*[F.lit(to_day(cut)) for cut in train_ends])
    rows = (
        spread(
            daily.select("item_code", "date", F.col("sales_qty").cast("double").alias("sales_qty"), "profit"),
            "item_code",
        )
        .withColumn(
            "_next",
            F.expr(
                "lead(CASE WHEN sales_qty <> 0 THEN struct(date, sales_qty) END) IGNORE NULLS "
                "OVER (PARTITION BY item_code ORDER BY date)"
            ),
        )
        .withColumn("train_end", F.explode(cuts))
    )
    cut = F.col("train_end")
    past, sold = day <= cut, quantity > 0
    sold_past = past & sold
    next_day, next_quantity = F.col("_next.date"), F.col("_next.sales_qty")
    has_next = F.coalesce(next_day <= cut, F.lit(False))
    squared_change = (
        F.when(~has_next, F.when(day < cut, quantity * quantity).otherwise(F.lit(0.0)))
        .when(next_day == F.date_add(day, 1), (next_quantity - quantity) * (next_quantity - quantity))
        .otherwise(quantity * quantity + next_quantity * next_quantity)
    )

    def sum_of_last(n: int) -> Column:
        return F.coalesce(F.sum(F.when(past & (day > F.date_sub(cut, n)), quantity)), F.lit(0.0))

    def kept(condition: Column, value: Column) -> Column:
        return F.collect_list(F.when(condition, value))

    return rows.groupBy("item_code", "train_end").agg(
        sum_of_last(28).alias("sum_28"),
        sum_of_last(window).alias("sum_window"),
        F.sort_array(kept(sold_past & (day > F.date_sub(cut, window)), quantity)).alias("recent_sales"),
        F.map_from_entries(
            kept(
                (quantity != 0) & (day > F.date_sub(cut, look_back)) & (day <= F.date_add(cut, horizon)),
                F.struct(day, quantity),
            )
        ).alias("recent"),
        F.count(F.when(sold_past, F.lit(1))).cast("int").alias("active_days"),
        F.min(F.when(sold_past, day)).alias("first_sale"),
        F.max(F.when(sold_past, day)).alias("last_sale"),
        F.coalesce(F.sum(F.when(sold_past, squared_change)), F.lit(0.0)).alias("squared_changes"),
        F.coalesce(F.sum(F.when(past, F.col("profit"))), F.lit(0.0)).alias("profit"),
    )


def sparsity_factor(active_days: Column, days_since_last_sale: Column) -> Column:
    """B6. How much of the median an item with few or old sales keeps."""
    activity = (
        F.when(active_days <= 2, F.lit(0.15))
        .when(active_days <= 5, F.lit(0.35))
        .when(active_days <= 15, F.lit(0.65))
        .otherwise(F.lit(1.0))
    )
    recency = (
        F.when(days_since_last_sale > 180, F.lit(0.05))
        .when(days_since_last_sale > 90, F.lit(0.35))
        .when(days_since_last_sale > 56, F.lit(0.70))
        .otherwise(F.lit(1.0))
    )
    return activity * recency


def quantity_on(recent: Column, day: Column) -> Column:
    return F.coalesce(F.try_element_at(recent, day), F.lit(0.0))


def same_weekday_mean(recent: Column, target: Column, cut: Column, first_day: Column, weeks: int) -> Column:
    """B4. Mean of the days 7, 14, .. days before ``target`` that lie in the history; 0 without any."""
    totals, counts = F.lit(0.0), F.lit(0)
    for week in range(1, weeks + 1):
        day = F.date_sub(target, 7 * week)
        inside = (day <= cut) & (day >= first_day)
        totals = totals + F.when(inside, quantity_on(recent, day)).otherwise(F.lit(0.0))
        counts = counts + inside.cast("int")
    return F.coalesce(F.try_divide(totals, counts), F.lit(0.0))


def weighted_blend(weights: dict[str, float]) -> Column:
    """B5. Blend of model columns, weights scaled to sum 1, clipped at zero."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("Blend weights must sum to a positive value.")
    terms = [F.col(name) * F.lit(weight / total) for name, weight in weights.items()]
    return positive_part(sum(terms[1:], terms[0]))


def with_baselines(
    statistics: DataFrame, first_day: Column, horizon: int = MAX_HORIZON, window: int = 56, weeks: int = 8
) -> DataFrame:
    """B1-B6. One row per statistics row and horizon with a column per model."""
    cut = F.col("train_end")
    statistics = statistics.withColumn("_first_day", first_day)
    span = F.datediff(cut, "_first_day") + 1
    recency = F.coalesce(F.datediff(cut, "last_sale"), F.lit(NEVER_SOLD_DAYS))
    base = statistics.withColumns(
        {
            "zero": F.lit(0.0),
            "mean_28": F.col("sum_28") / F.least(F.lit(28), span),
            "mean_56": F.col("sum_window") / F.least(F.lit(window), span),
            "median_56": median_with_zeros(F.col("recent_sales"), F.least(F.lit(window), span)),
        }
    ).withColumn(
        "conservative_sparse",
        positive_part(F.col("median_56") * sparsity_factor(F.col("active_days"), recency)),
    )
    rows = with_horizons(base, "train_end", horizon)
    weekday = same_weekday_mean(F.col("recent"), F.col("target_date"), cut, F.col("_first_day"), weeks)
    return (
        rows.withColumn("same_weekday_8w", weekday)
        .withColumn("blend_mean_weekday", weighted_blend(BLEND_WEIGHTS))
        .drop("_first_day")
    )


def baseline_forecasts(
    daily: DataFrame, train_end: str | dt.date, horizon: int = MAX_HORIZON, window: int = 56, weeks: int = 8
) -> DataFrame:
    """All baselines for every item of ``daily`` after ``train_end``, one column per model.

    ``window`` is the length behind ``mean_56`` and ``median_56``, ``weeks`` the depth of the weekday mean.
    """
    first_day = scalar(daily, F.min("date"))
    statistics = cut_statistics(daily, [train_end], horizon, window, weeks)
    rows = with_baselines(statistics, first_day, horizon, window, weeks)
    return rows.select("item_code", "target_date", "horizon", *MODELS)


def baseline_forecast(daily: DataFrame, train_end: str | dt.date, model: str, **options) -> DataFrame:
    """One baseline as (item_code, target_date, horizon, yhat)."""
    if model not in MODELS:
        raise ValueError(f"Unknown baseline: {model}")
    return baseline_forecasts(daily, train_end, **options).select(
        "item_code", "target_date", "horizon", F.col(model).alias("yhat")
    )


def blend_forecasts(forecasts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """B5 on long rows (model, item_code, target_date, yhat); models without a weight count 0."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("Blend weights must sum to a positive value.")
    spark = forecasts.sparkSession
    table = spark.createDataFrame(
        [(name, weight / total) for name, weight in weights.items()], "model string, weight double"
    )
    weighted = forecasts.join(broadcast_if_bounded(table, len(weights)), "model", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
    return weighted.groupBy("item_code", "target_date").agg(
        positive_part(F.sum(F.col("yhat") * F.col("weight"))).alias("yhat")
    )


FRAME_BASELINES = {
    "naive_last_value": "lag_1",
    "seasonal_naive_lag_7": "lag_7",
    "moving_average_28": "rolling_mean_28",
}


def frame_baselines(frame: DataFrame) -> DataFrame:
    """B8. Feature columns read as forecasts, clipped at zero."""
    return frame.withColumns({name: positive_part(F.col(column)) for name, column in FRAME_BASELINES.items()})
