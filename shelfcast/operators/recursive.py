"""Recursive day-by-day forecast.

Each item carries its last 364 days as one array. A step reads features from the array, scores, blends,
applies the rules and appends the day: no step shuffles anything. Lineage is cut by a reliable checkpoint
every few days, with a model every day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import NEVER_SOLD_DAYS, ORIGIN_LAGS, ORIGIN_WINDOWS, STATIC_COLUMNS, DirectConfig
from shelfcast.functions.dates import as_date, to_day
from shelfcast.functions.numbers import positive_part
from shelfcast.operators.direct import with_item_ids
from shelfcast.operators.postprocess import SUNDAY
from shelfcast.session import broadcast_if_bounded, reliable_checkpoint, scalar

HISTORY_DAYS = max(ORIGIN_LAGS)
CHECKPOINT_EVERY = 7  # days without a model


def _history_state(daily: DataFrame, items: DataFrame, train_end: dt.date, cfg: DirectConfig) -> DataFrame:
    """One row per item: the last 364 days as an array (zeros filled), last sale, sales since the end-of-selling day."""
    cut = as_date(train_end)
    day, quantity = F.col("date"), F.col("sales_qty").cast("double")
    recent = day.between(F.date_sub(cut, HISTORY_DAYS - 1), cut)
    since = as_date(cfg.end_of_selling_since) if cfg.end_of_selling_since else F.lit(None).cast("date")
    state = daily.groupBy("item_code").agg(
        F.map_from_entries(
            F.collect_list(F.when(recent & (quantity != 0), F.struct(F.datediff(day, cut), quantity)))
        ).alias("_sold"),
        F.max(F.when((day <= cut) & (quantity > 0), day)).alias("last_sale"),
        F.coalesce(F.sum(F.when((day <= cut) & (day >= since), quantity)), F.lit(0.0)).alias("sold_since"),
    )
    offsets = F.sequence(F.lit(1 - HISTORY_DAYS), F.lit(0))
    history = F.transform(offsets, lambda k: F.coalesce(F.try_element_at(F.col("_sold"), k), F.lit(0.0)))
    static = with_item_ids(items).select("item_code", "item_id", *STATIC_COLUMNS)
    return (
        state.withColumn("hist", history)
        .drop("_sold")
        .join(broadcast_if_bounded(static, cfg.top_n), "item_code", "left")
        .withColumn("span", F.datediff(cut, scalar(daily, F.min("date"))) + 1)
        .withColumn("day", F.date_add(cut, 1))
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _step_columns() -> dict[str, Column]:
    """W8 at the origin ``day`` read from the array; windows are clipped at the history start."""
    hist, target = F.col("hist"), F.col("day")
    columns: dict[str, Column] = {f"lag_{k}": F.element_at(hist, -k) for k in ORIGIN_LAGS}
    for n in ORIGIN_WINDOWS:
        window = F.slice(hist, -n, n)
        columns[f"mean_{n}"] = _sum(window) / F.least(F.lit(n), F.col("span"))
        columns[f"max_{n}"] = F.array_max(window)
        columns[f"active_{n}"] = F.size(F.filter(window, lambda v: v > 0)).cast("double")
    recency = F.datediff(F.date_sub(target, 1), "last_sale")
    columns |= {
        "days_since_last_sale": F.coalesce(recency, F.lit(NEVER_SOLD_DAYS)).cast("double"),
        "origin_dow": F.weekday(target),
        "origin_month": F.month(target),
        "horizon": F.lit(1),
        "target_dow": F.weekday(target),
        "target_day": F.dayofmonth(target),
        "target_month": F.month(target),
        "target_week": F.weekofyear(target),
    }
    return columns


def _median_56(hist: Column, span: Column) -> Column:
    """Median of the last 56 days, or of all days so far in a shorter history."""
    n = F.least(F.lit(56), span)
    ordered = F.sort_array(F.slice(hist, -n, n))
    low = F.floor((n + 1) / F.lit(2.0)).cast("int")
    high = F.floor((n + 2) / F.lit(2.0)).cast("int")
    return (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2.0


def _roll(state: DataFrame, model, cfg: DirectConfig) -> DataFrame:
    """Append ``cfg.horizon`` days to every item's history; without a model the value is the median alone.

    The day to forecast and the model's share ``alpha`` are columns, so all steps and shares have their expressions and
    one generated program in common.
    """
    carried, target = state.columns, F.col("day")
    median = _median_56(F.col("hist"), F.col("span"))
    value = median if model is None else F.col("alpha") * F.col("yhat") + (1.0 - F.col("alpha")) * median
    value = positive_part(value)
    if cfg.zero_sundays:
        value = F.when(F.weekday(target) == SUNDAY, F.lit(0.0)).otherwise(value)
    added = F.col("_value")
    if cfg.end_of_selling_since:
        since = as_date(cfg.end_of_selling_since)
        ended = (since < target) & (F.col("sold_since") == 0)
        value = F.when(ended, F.lit(0.0)).otherwise(value)
        added = F.when(since <= target, added).otherwise(F.lit(0.0))
    moved = {
        "hist": F.concat(F.slice("hist", 2, HISTORY_DAYS - 1), F.array("_value")),
        "last_sale": F.when(F.col("_value") > 0, target).otherwise(F.col("last_sale")),
        "sold_since": F.col("sold_since") + added,
        "span": F.col("span") + 1,
        "day": F.date_add(target, 1),
    }
    features = _step_columns()
    next_state = [moved.get(c, F.col(c)).alias(c) for c in carried]
    # A model's input repeats the history some forty times; a second step in the same plan would repeat all of the first.
    every = CHECKPOINT_EVERY if model is None else 1
    for step in range(1, cfg.horizon + 1):
        rows = state if model is None else model.predict(state.withColumns(features))
        state = rows.withColumn("_value", value).select(*next_state)
        if step % every == 0 or step == cfg.horizon:
            state = reliable_checkpoint(state)
    kept = [c for c in ("item_code", "alpha") if c in carried]
    return state.select(*kept, F.posexplode(F.slice("hist", -cfg.horizon, cfg.horizon)).alias("_place", "yhat"))


def recursive_forecasts(
    daily: DataFrame,
    items: DataFrame,
    model,
    train_end: str | dt.date,
    cfg: DirectConfig,
    alphas: list[float],
) -> DataFrame:
    """M17 for several shares of the model at once: (alpha, item_code, target_date, horizon, yhat).

    The state is built once. Items without a model do not depend on alpha, so they are rolled once, whatever the
    number of shares; only the selected items are rolled per share.
    """
    start = to_day(train_end)
    shares = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    state = reliable_checkpoint(_history_state(daily, items, start, cfg))
    rolled = _roll(state.filter(F.col("item_id").isNull()), None, cfg).withColumn("alpha", shares)
    if model is not None:
        chosen = state.filter(F.col("item_id").isNotNull()).withColumn("alpha", shares)
        rolled = rolled.unionByName(_roll(chosen, model, cfg))
    return rolled.select(
        "alpha",
        "item_code",
        F.date_add(as_date(start), F.col("_place") + 1).alias("target_date"),
        (F.col("_place") + 1).alias("horizon"),
        "yhat",
    )


def recursive_forecast(
    daily: DataFrame,
    items: DataFrame,
    model,
    train_end: str | dt.date,
    cfg: DirectConfig,
    alpha: float,
) -> DataFrame:
    """M17. Forecast one day at a time; the blended, rule-checked value becomes history for the next day.

    Selected items blend the model with the 56-day median, all others take the median and never meet the
    model. Without a model ``items`` must be empty. Any positive forecast counts as a sale for recency and
    activity. Returns (item_code, target_date, horizon, yhat).
    """
    return recursive_forecasts(daily, items, model, train_end, cfg, [alpha]).drop("alpha")
