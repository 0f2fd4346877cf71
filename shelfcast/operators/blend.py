"""Model override of a baseline and the blend grid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import MAX_HORIZON
from shelfcast.functions.dates import as_date
from shelfcast.functions.numbers import positive_part
from shelfcast.operators.scoring import rmsse_denominators, weighted_mean

GRID_STEPS = 20


def blend_with_model(baseline: DataFrame, model: DataFrame, alpha: float | Column) -> DataFrame:
    """J10. alpha * model + (1 - alpha) * baseline where the model has a row, else the baseline; clipped."""
    share = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    predicted = model.select("item_code", "target_date", F.col("yhat").alias("_model"))
    mixed = share * F.col("_model") + (1.0 - share) * F.col("yhat")
    return (
        baseline.join(predicted, ["item_code", "target_date"], "left")
        .withColumn("yhat", positive_part(F.when(F.col("_model").isNotNull(), mixed).otherwise(F.col("yhat"))))
        .drop("_model")
    )


def blend_grid(
    daily: DataFrame,
    baseline: DataFrame,
    model: DataFrame,
    weights: DataFrame,
    train_end: str | dt.date,
    horizon: int = MAX_HORIZON,
    post: Column | None = None,
) -> DataFrame:
    """M12. WRMSSE of the blend for alpha = 0, .05, .. 1, one row per alpha.

    The squared error of a blend is quadratic in alpha, so three sums per item answer all 21 alphas: the
    cells are read once, not once per alpha. Both forecasts must be >= 0 (the clip is then void) and rules
    that only zero cells must already be applied to both. ``post`` keeps extra cells (default: all).
    """
    cut = as_date(train_end)
    inside = (F.col("date") > cut) & (F.col("date") <= F.date_add(cut, horizon))

    def cells(frame: DataFrame, day: str, value: str, name: str) -> DataFrame:
        empty = {n: F.lit(None).cast("double") for n in ("_a", "_b", "_m")}
        empty[name] = F.col(value).cast("double")
        return frame.withColumnRenamed(day, "date").filter(inside).select(
            "item_code", "date", *[c.alias(n) for n, c in empty.items()]
        )

    stacked = (
        cells(daily, "date", "sales_qty", "_a")
        .unionByName(cells(baseline, "target_date", "yhat", "_b"))
        .unionByName(cells(model, "target_date", "yhat", "_m"))
        .repartition("item_code")
    )
    merged = stacked.groupBy("item_code", "date").agg(*[F.sum(n).alias(n) for n in ("_a", "_b", "_m")])
    actual, base = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    shift = F.when(F.col("_m").isNotNull(), F.col("_m") - base).otherwise(F.lit(0.0))
    if post is not None:
        merged = merged.filter(post)
    sums = merged.groupBy("item_code").agg(
        F.sum((base - actual) * (base - actual)).alias("_s0"),
        F.sum((base - actual) * shift).alias("_s1"),
        F.sum(shift * shift).alias("_s2"),
    )
    items = (
        rmsse_denominators(daily, train_end)
        .join(weights.select("item_code", "profit_weight"), "item_code", "left")
        .join(sums, "item_code", "left")
        .fillna(0.0, ["profit_weight", "_s0", "_s1", "_s2"])
    )
    steps = F.sequence(F.lit(0), F.lit(GRID_STEPS))
    rows = items.withColumn("alpha", F.explode(F.transform(steps, lambda i: i / F.lit(float(GRID_STEPS)))))
    alpha = F.col("alpha")
    mse = (
        F.greatest(F.col("_s0") + 2.0 * alpha * F.col("_s1") + alpha * alpha * F.col("_s2"), F.lit(0.0)) / horizon
    )
    error = F.sqrt(mse / F.col("rmsse_denom"))
    return rows.groupBy("alpha").agg(weighted_mean(F.col("profit_weight"), error).alias("wrmsse_56"))


def share_grid(
    daily: DataFrame,
    forecasts: DataFrame,
    alphas: list[float],
    weights: DataFrame,
    train_end: str | dt.date,
    horizon: int = MAX_HORIZON,
) -> DataFrame:
    """M15. WRMSSE of every share's own forecast (alpha, item_code, target_date, yhat), all shares in one job.

    For forecasts that are no blend of two fixed ones, as the recursive ones: the share is a group key, and only the
    actual days of the horizon are repeated per share.
    """
    cut = as_date(train_end)
    inside = (F.col("date") > cut) & (F.col("date") <= F.date_add(cut, horizon))
    shares = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    actual = daily.select("item_code", "date", F.col("sales_qty").cast("double").alias("_e")).filter(inside).withColumn("alpha", shares)
    predicted = forecasts.select("alpha", "item_code", F.col("target_date").alias("date"), (-F.col("yhat")).alias("_e")).filter(inside)
    cells = actual.select("alpha", "item_code", "date", "_e").unionByName(predicted).repartition("alpha", "item_code")
    cells = cells.groupBy("alpha", "item_code", "date").agg(F.sum("_e").alias("_e"))
    errors = cells.groupBy("alpha", "item_code").agg((F.sum(F.col("_e") * F.col("_e")) / horizon).alias("mse"))
    items = rmsse_denominators(daily, train_end).join(weights.select("item_code", "profit_weight"), "item_code", "left")
    scored = items.withColumn("alpha", shares).join(errors, ["alpha", "item_code"], "left").fillna(0.0, ["profit_weight", "mse"])
    error = F.sqrt(F.col("mse") / F.col("rmsse_denom"))
    return scored.groupBy("alpha").agg(weighted_mean(F.col("profit_weight"), error).alias("wrmsse_56"))


def best_alpha(grid: DataFrame, baseline_score: float) -> float:
    """M12. The smallest alpha with the best score, 0 unless strictly better than the baseline alone."""
    best = grid.filter(F.col("wrmsse_56") < baseline_score).orderBy("wrmsse_56", "alpha").first()
    return float(best["alpha"]) if best else 0.0
