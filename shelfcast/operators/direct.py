"""Direct multi-horizon training rows.

The origin day is the first forecast day: features end the day before it and horizon h targets
origin + h - 1. This differs from the daily model on purpose.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DIRECT_COLUMNS, NEVER_SOLD_DAYS, ORIGIN_LAGS, ORIGIN_WINDOWS, STATIC_COLUMNS, DirectConfig
from shelfcast.functions.dates import as_date, to_day
from shelfcast.operators.panel import demand_panel
from shelfcast.operators.scoring import rmsse_denominators
from shelfcast.operators.selection import keep_items
from shelfcast.session import broadcast_if_bounded, scalar

FIRST_ORIGIN = 364  # origins need the longest lag


def by_day():
    return Window.partitionBy("item_code").orderBy("date")


def origin_features(panel: DataFrame) -> DataFrame:
    """W8. Features of every panel day as an origin, in one window pass over the item partitioning.

    Windows cover the days strictly before the origin, clipped at the history start. ``pos`` counts days.
    """
    quantity = F.col("qty")
    columns: dict[str, Column] = {
        "pos": F.row_number().over(by_day()) - 1,
        **{f"lag_{k}": F.lag(quantity, k, 0.0).over(by_day()) for k in ORIGIN_LAGS},
    }
    for n in ORIGIN_WINDOWS:
        before = by_day().rowsBetween(-n, -1)
        columns[f"mean_{n}"] = F.coalesce(F.avg(quantity).over(before), F.lit(0.0))
        columns[f"max_{n}"] = F.coalesce(F.max(quantity).over(before), F.lit(0.0))
        columns[f"active_{n}"] = F.count(F.when(quantity > 0, F.lit(1))).over(before).cast("double")
    earlier = by_day().rowsBetween(Window.unboundedPreceding, -1)
    columns["_last_sale"] = F.max(F.when(quantity > 0, F.col("date"))).over(earlier)
    day_before = F.date_sub("date", 1)
    return panel.withColumns(columns).withColumns(
        {
            "days_since_last_sale": F.coalesce(
                F.datediff(day_before, "_last_sale"), F.lit(NEVER_SOLD_DAYS)
            ).cast("double"),
            "origin_dow": F.weekday("date"),
            "origin_month": F.month("date"),
        }
    )


def with_item_ids(items: DataFrame) -> DataFrame:
    """Position of each selected item, most profitable first; the list is a top-n, so its size is bounded."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("profit_weight"), F.asc("item_code"))
    return items.withColumn("item_id", F.row_number().over(order) - 1)


def sample_weights(daily: DataFrame, items: DataFrame, train_end: str | dt.date) -> DataFrame:
    """M7. Profit weight over scale, divided by the mean of the positive ones, clipped at zero."""
    raw = (
        items.select("item_code", "profit_weight")
        .join(rmsse_denominators(daily, train_end), "item_code")
        .withColumn("_raw", F.col("profit_weight") / F.col("rmsse_denom"))
    )
    typical = scalar(raw, F.avg(F.when(F.col("_raw") > 0, F.col("_raw"))))
    weight = F.greatest(F.try_divide(F.col("_raw"), typical), F.lit(0.0))
    return raw.select("item_code", weight.alias("sample_weight"))


def _with_target_calendar(rows: DataFrame) -> DataFrame:
    target = F.col("target_date")
    return rows.withColumns(
        {
            "target_dow": F.weekday(target),
            "target_day": F.dayofmonth(target),
            "target_month": F.month(target),
            "target_week": F.weekofyear(target),
        }
    )


def direct_dataset(
    daily: DataFrame,
    items: DataFrame,
    train_end: str | dt.date,
    cfg: DirectConfig,
    origins_end_offset: int = 0,
) -> DataFrame:
    """M6, F7, F8, J9. Rows (origin x horizon x item) with features, target and sample weight.

    ``items`` is the selected profile (with the static columns), at most ``cfg.top_n`` rows. Origins run from
    day max(364, train_end - lookback) to train_end - offset in steps of the stride. Targets are read ahead
    inside the item's window, so the panel is shuffled once and never joined with itself.
    """
    cut = as_date(train_end)
    first_day = scalar(daily, F.min("date"))
    panel = demand_panel(daily, items, first_day, cut, max_items=cfg.top_n)
    ahead = F.array(*[F.lead("qty", h).over(by_day()) for h in range(cfg.horizon)])
    start = F.greatest(
        F.lit(FIRST_ORIGIN), F.datediff(F.date_sub(cut, cfg.origin_lookback_days), first_day)
    )
    pos = F.col("pos")
    last = F.datediff(F.date_sub(cut, origins_end_offset), first_day)
    origins = (
        origin_features(panel)
        .withColumn("_ahead", ahead)
        .filter((pos >= start) & (pos <= last) & ((pos - start) % cfg.origin_stride == 0))
    )
    if cfg.filter_inactive:
        origins = origins.filter(F.col("_last_sale").isNotNull())
    rows = (
        origins.withColumnRenamed("date", "origin_date")
        .select("*", F.posexplode("_ahead").alias("_place", "target"))
        .filter(F.col("target").isNotNull())
        .withColumn("horizon", F.col("_place") + 1)
        .withColumn("target_date", F.date_add("origin_date", F.col("_place")))
    )
    static = with_item_ids(items).select("item_code", "item_id", *STATIC_COLUMNS)
    weights = sample_weights(daily, items, train_end)
    joined = (
        _with_target_calendar(rows)
        .join(broadcast_if_bounded(static, cfg.top_n), "item_code")
        .join(broadcast_if_bounded(weights, cfg.top_n), "item_code")
    )
    return joined.select(
        "item_code", "origin_date", "target_date", *DIRECT_COLUMNS, "target", "sample_weight"
    )


def origin_as_of(daily: DataFrame, items: DataFrame, origin: Column, first_day: Column, max_items: int) -> DataFrame:
    """W8 at the single day ``origin`` from the sales rows alone, for items with and without rows.

    Empty days are never created: a window of n days divides by the days so far if these are fewer, and its largest
    value is at least the zero of any empty day.
    """
    rows = keep_items(daily.filter(F.col("date") < origin), items, max_items)
    rows = rows.groupBy("item_code", "date").agg(F.sum("sales_qty").cast("double").alias("qty"))
    day, quantity = F.col("date"), F.col("qty")
    span = F.datediff(origin, first_day)
    recent = lambda n: day >= F.date_sub(origin, n)
    total = lambda condition: F.coalesce(F.sum(F.when(condition, quantity)), F.lit(0.0))
    sums = {f"lag_{k}": total(day == F.date_sub(origin, k)) for k in ORIGIN_LAGS}
    for n in ORIGIN_WINDOWS:
        sums[f"mean_{n}"] = total(recent(n))
        sums[f"max_{n}"] = F.max(F.when(recent(n), quantity))
        sums[f"_seen_{n}"] = F.count(F.when(recent(n), F.lit(1)))
        sums[f"active_{n}"] = F.count(F.when(recent(n) & (quantity > 0), F.lit(1))).cast("double")
    sums["_last_sale"] = F.max(F.when(quantity > 0, day))
    found = items.select("item_code").distinct().join(rows.groupBy("item_code").agg(*[c.alias(n) for n, c in sums.items()]), "item_code", "left")
    columns = {f"lag_{k}": F.coalesce(f"lag_{k}", F.lit(0.0)) for k in ORIGIN_LAGS}
    for n in ORIGIN_WINDOWS:
        length = F.least(F.lit(n), span)
        whole = F.col(f"_seen_{n}") >= length
        columns[f"mean_{n}"] = F.coalesce(F.try_divide(F.col(f"mean_{n}"), length), F.lit(0.0))
        columns[f"max_{n}"] = F.when(whole, F.col(f"max_{n}")).otherwise(F.greatest(f"max_{n}", F.lit(0.0)))
        columns[f"active_{n}"] = F.coalesce(f"active_{n}", F.lit(0.0))
    recency = F.datediff(F.date_sub(origin, 1), "_last_sale")
    columns |= {
        "days_since_last_sale": F.coalesce(recency, F.lit(NEVER_SOLD_DAYS)).cast("double"),
        "origin_dow": F.weekday(origin),
        "origin_month": F.month(origin),
        "origin_date": origin,
    }
    return found.select("item_code", *[c.alias(n) for n, c in columns.items()])


def forecast_features(daily: DataFrame, items: DataFrame, train_end: str | dt.date, cfg: DirectConfig) -> DataFrame:
    """M8. The rows to predict: one origin, the day after ``train_end``, all horizons."""
    origin = F.date_add(as_date(train_end), 1)
    origins = origin_as_of(daily, items, origin, scalar(daily, F.min("date")), cfg.top_n)
    rows = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon)))).withColumn(
        "target_date", F.date_add("origin_date", F.col("horizon") - 1)
    )
    static = with_item_ids(items).select("item_code", "item_id", *STATIC_COLUMNS)
    joined = _with_target_calendar(rows).join(broadcast_if_bounded(static, cfg.top_n), "item_code")
    return joined.select("item_code", "origin_date", "target_date", *DIRECT_COLUMNS)


def newest_rows(dataset: DataFrame, cfg: DirectConfig) -> DataFrame:
    """T5. The last min(rows, top_n * horizon * 8) rows in (origin, horizon, item) order.

    Whole origins are kept by the row counts of the newer ones, and only the single origin where the quota
    ends is cut inside, by the position that follows from its own counts; there are few origins, and a
    group (origin, horizon) never exceeds ``top_n`` rows.
    """
    quota = cfg.top_n * cfg.horizon * 8
    blocks = dataset.groupBy("origin_date", "horizon").agg(F.count(F.lit(1)).alias("_rows"))
    newest_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("origin_date"), F.desc("horizon"))
    newer = F.coalesce(
        F.sum("_rows").over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    kept_blocks = blocks.withColumn("_newer", newer).filter(F.col("_newer") < quota).drop("_rows")
    place = F.row_number().over(Window.partitionBy("origin_date", "horizon").orderBy(F.desc("item_id")))
    return (
        dataset.join(kept_blocks, ["origin_date", "horizon"])
        .withColumn("_place", place)
        .filter(F.col("_newer") + F.col("_place") <= quota)
        .drop("_newer", "_place")
    )


def fit_end(train_end: str | dt.date, horizon: int) -> dt.date:
    """The end of the fitting history of an evaluation run: one horizon before ``train_end``."""
    return to_day(train_end) - dt.timedelta(days=horizon)
