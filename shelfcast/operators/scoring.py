"""Error metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import HALF_HORIZON, MAX_HORIZON
from shelfcast.functions.dates import as_date, to_day
from shelfcast.functions.ranking import with_global_row_number
from shelfcast.operators.baselines import MODELS, cut_statistics, quantity_on, with_baselines
from shelfcast.session import scalar

EPSILON = 1e-9


# -- plain error metrics ------------------------------------------------------------------------------


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """A7. MAE, RMSE, WAPE over the sum of absolute actuals, and the row mean of SMAPE (0 when both are 0)."""
    error = F.abs(actual - predicted)
    scale = F.abs(actual) + F.abs(predicted)
    smape = F.when(scale > 0, F.try_divide(2.0 * error, scale)).otherwise(F.lit(0.0))
    return {
        "mae": F.avg(error),
        "rmse": F.sqrt(F.avg(error * error)),
        "wape": F.sum(error) / F.greatest(F.sum(F.abs(actual)), F.lit(EPSILON)),
        "smape": F.avg(smape),
    }


def metrics_table(
    frame: DataFrame, models: Sequence[str], by: Sequence[str] = (), actual: str = "target_quantity"
) -> DataFrame:
    """A7, A8. Metrics per model, optionally per group: (group columns.., model, mae, rmse, wape, smape).

    All models are aggregated in one pass and only the small result is turned into rows.
    """
    aggregates = []
    for model in models:
        metrics = error_metrics(F.col(actual), F.col(model))
        aggregates.append(F.struct(*[m.alias(name) for name, m in metrics.items()]).alias(model))
    wide = frame.groupBy(*by).agg(*aggregates)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in models]))
    return wide.select(*by, rows.alias("_r")).select(*by, "_r.model", "_r.value.*")


def with_speed_group(frame: DataFrame) -> DataFrame:
    """A9, W11. Split rows (not items) into a slow and a fast half by ``sku_avg_sales``.

    The order is total, so the split is exact; with an odd count the middle row is slow. Row numbers come from
    range partitions, not from one global window.
    """
    order = [F.col(c) for c in ("sku_avg_sales", "target_date", "item_code", "horizon", "as_of_date")]
    numbered = with_global_row_number(frame, order, "_row")
    slow_rows = F.floor((scalar(numbered, F.count(F.lit(1))) + 1) / F.lit(2.0))
    group = F.when(F.col("_row") <= slow_rows, F.lit("slow_moving")).otherwise(F.lit("fast_moving"))
    return numbered.withColumn("sku_group", group).drop("_row")


def evaluation_report(validation: DataFrame, models: Sequence[str]) -> DataFrame:
    """The evaluation as long rows (scope, group, model, metric, value): overall, by horizon, by speed group."""

    def long(table: DataFrame, scope: str, group: Column) -> DataFrame:
        return table.select(
            F.lit(scope).alias("scope"), group.cast("string").alias("group"), "model", "mae", "rmse", "wape", "smape"
        ).unpivot(["scope", "group", "model"], ["mae", "rmse", "wape", "smape"], "metric", "value")

    overall = long(metrics_table(validation, models), "overall", F.lit("all"))
    by_horizon = long(metrics_table(validation, models, ["horizon"]), "horizon", F.col("horizon"))
    grouped = metrics_table(with_speed_group(validation), models, ["sku_group"])
    return overall.unionByName(by_horizon).unionByName(long(grouped, "sku_group", F.col("sku_group")))


def passes_registration_rule(report: DataFrame, model: str, baselines: Sequence[str]) -> DataFrame:
    """M14. One row: the model may be registered when its WAPE is at most 1.05 times the best baseline's."""
    wape = report.filter((F.col("scope") == "overall") & (F.col("metric") == "wape"))
    return wape.agg(
        F.max(F.when(F.col("model") == model, F.col("value"))).alias("model_wape"),
        F.min(F.when(F.col("model").isin(list(baselines)), F.col("value"))).alias("best_baseline_wape"),
    ).withColumn("passed", F.col("model_wape") <= F.col("best_baseline_wape") * 1.05)


# -- weighted scaled errors ---------------------------------------------------------------------------


def scale_of(squared_changes: Column, first_sale: Column, cut: Column, floor: float = 1.0) -> Column:
    """A13. Mean squared day-to-day change after the first sale; ``floor`` when there is none."""
    mean = F.try_divide(squared_changes, F.datediff(cut, first_sale))
    return F.greatest(F.when(mean > 0, mean).otherwise(F.lit(floor)), F.lit(EPSILON))


def rmsse_denominators(daily: DataFrame, train_end: str | dt.date, floor: float = 1.0) -> DataFrame:
    """A13 per item of ``daily`` from sparse rows: empty days are bridged by looking at the next sale."""
    statistics = cut_statistics(daily, [train_end], horizon=1, window=1, weeks=0)
    scale = scale_of(F.col("squared_changes"), F.col("first_sale"), F.col("train_end"), floor)
    return statistics.select("item_code", scale.alias("rmsse_denom"))


def wrmsse_by_item(
    daily: DataFrame,
    forecast: DataFrame,
    weights: DataFrame,
    train_end: str | dt.date,
    horizon: int = MAX_HORIZON,
    denom_floor: float = 1.0,
    only_items: DataFrame | None = None,
) -> DataFrame:
    """A14, J7, J8. Weight, scale, squared error and weighted RMSSE of every item of ``daily``.

    Missing forecast or actual cells count 0, an existing NaN stays. Actual and forecast rows are stacked and
    reduced within an item partition instead of being outer-joined; ``only_items`` restricts the evaluated
    items, whose weights are then scaled to sum 1 again.
    """
    cut = as_date(train_end)
    inside = (F.col("date") > cut) & (F.col("date") <= F.date_add(cut, horizon))
    actual = daily.filter(inside).select(
        "item_code", "date", F.col("sales_qty").cast("double").alias("_a"), F.lit(0.0).alias("_f")
    )
    predicted = forecast.select(
        "item_code", F.col("target_date").alias("date"), F.lit(0.0).alias("_a"), F.col("yhat").alias("_f")
    ).filter(inside)
    cells = actual.unionByName(predicted).repartition("item_code")
    errors = (
        cells.groupBy("item_code", "date")
        .agg(F.sum("_a").alias("_a"), F.sum("_f").alias("_f"))
        .groupBy("item_code")
        .agg((F.sum((F.col("_f") - F.col("_a")) * (F.col("_f") - F.col("_a"))) / horizon).alias("mse"))
    )
    scales = rmsse_denominators(daily, train_end, denom_floor)
    if only_items is not None:
        scales = scales.join(only_items.select("item_code"), "item_code", "left_semi")
    joined = (
        scales.withColumnRenamed("rmsse_denom", "denom")
        .join(weights.select("item_code", F.col("profit_weight").alias("_w")), "item_code", "left")
        .join(errors, "item_code", "left")
        .withColumns({"_w": F.coalesce("_w", F.lit(0.0)), "mse": F.coalesce("mse", F.lit(0.0))})
    )
    weight_sum = scalar(joined, F.sum("_w"))
    scored = joined.select(
        "item_code",
        F.when(weight_sum > 0, F.try_divide(F.col("_w"), weight_sum)).otherwise(F.col("_w")).alias("weight"),
        "denom",
        "mse",
        F.sqrt(F.col("mse") / F.col("denom")).alias("rmsse"),
    )
    return scored.withColumn("weighted_rmsse", F.col("weight") * F.col("rmsse"))


def wrmsse(scores: DataFrame) -> DataFrame:
    """A14. The total of a per-item score table, one row."""
    return scores.agg(F.coalesce(F.sum("weighted_rmsse"), F.lit(0.0)).alias("wrmsse"))


def weighted_mean(weight: Column, value: Column) -> Column:
    """Sum of ``value`` with weights scaled to sum 1, in one aggregate; 0 when all weights are 0."""
    return F.coalesce(F.try_divide(F.sum(weight * value), F.sum(weight)), F.lit(0.0))


def fold_ends(last_date: dt.date, n_folds: int = 3, horizon: int = MAX_HORIZON, step: int = 28) -> list[dt.date]:
    """B7. Training ends of the rolling-origin folds, oldest first."""
    return [last_date - dt.timedelta(days=horizon + step * (n_folds - 1 - i)) for i in range(n_folds)]


def backtest_baselines(
    daily: DataFrame,
    last_date: str | dt.date,
    weights: DataFrame | None = None,
    horizon: int = MAX_HORIZON,
    step: int = 28,
    n_folds: int = 3,
) -> DataFrame:
    """B7. WRMSSE of every baseline in every fold, over the first 28 and over all days; one plan for all.

    Weights are the items' positive profit as of each fold's cut, or the given (item_code, profit_weight).
    Weighted scores are linear in the weights, so shares need no second pass. The history must reach
    ``last_date``, the last validated day.
    """
    ends = fold_ends(to_day(last_date), n_folds, horizon, step)
    first_day = scalar(daily, F.min("date"))
    statistics = cut_statistics(daily, ends, horizon)
    if weights is None:
        statistics = statistics.withColumn("_weight", F.greatest(F.col("profit"), F.lit(0.0)))
    else:
        given = weights.select("item_code", F.col("profit_weight").alias("_weight"))
        statistics = statistics.join(given, "item_code", "left").fillna(0.0, ["_weight"])
    rows = with_baselines(statistics, first_day, horizon)
    actual = quantity_on(F.col("recent"), F.col("target_date"))
    early = F.col("horizon") <= HALF_HORIZON

    def squared(model: str) -> Column:
        return (F.col(model) - actual) * (F.col(model) - actual)

    per_item = rows.groupBy("item_code", "train_end").agg(
        F.first("_weight").alias("_weight"),
        F.first(scale_of(F.col("squared_changes"), F.col("first_sale"), F.col("train_end"))).alias("_scale"),
        *[F.avg(F.when(early, squared(m))).alias(f"{m}_28") for m in MODELS],
        *[F.avg(squared(m)).alias(f"{m}_56") for m in MODELS],
    )

    def score(column: str) -> Column:
        return weighted_mean(F.col("_weight"), F.sqrt(F.col(column) / F.col("_scale")))

    per_fold = per_item.groupBy("train_end").agg(
        *[
            F.struct(score(f"{m}_28").alias("wrmsse_28"), score(f"{m}_56").alias("wrmsse_56")).alias(m)
            for m in MODELS
        ]
    )
    rows_of = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in MODELS]))
    fold_number = sum((F.when(F.col("train_end") >= F.lit(e), 1).otherwise(0) for e in ends), F.lit(0))
    return per_fold.select("train_end", rows_of.alias("_r")).select(
        fold_number.alias("fold"),
        "train_end",
        F.date_add("train_end", 1).alias("valid_start"),
        F.date_add("train_end", horizon).alias("valid_end"),
        "_r.model",
        "_r.s.wrmsse_28",
        "_r.s.wrmsse_56",
    )


def summarize_backtest(scores: DataFrame) -> DataFrame:
    """A10. Mean scores per model, best first."""
    return (
        scores.groupBy("model")
        .agg(F.avg("wrmsse_28").alias("wrmsse_28"), F.avg("wrmsse_56").alias("wrmsse_56"))
        .orderBy("wrmsse_56", "model")
    )
