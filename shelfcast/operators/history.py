"""Leakage-safe history features (W1-W7): strictly before the as-of day.

Two forms give the same numbers. :func:`history_features` runs windows over a dense panel and yields every
day. :func:`history_as_of` answers one day for any number of items from sparse rows alone, with one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import LAG_DAYS
from shelfcast.functions.numbers import median_with_zeros, safe_ratio, sample_std
from shelfcast.session import scalar


def by_day():
    return Window.partitionBy("item_code").orderBy("date")


def last_rows(n: int):
    return by_day().rowsBetween(-(n - 1), 0)


def so_far():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def strictly_before():
    return by_day().rowsBetween(Window.unboundedPreceding, -1)


def with_shifted_series(panel: DataFrame) -> DataFrame:
    """First window pass: the series shifted by one day, whose first value is a real zero, and plain lags."""
    quantity, returns, price = F.col("quantity_sold"), F.col("return_quantity"), F.col("avg_unit_price")
    return panel.withColumns(
        {
            "_h": F.lag(quantity, 1, 0.0).over(by_day()),
            "_rh": F.lag(returns, 1, 0.0).over(by_day()),
            "_known": F.last(price, ignorenulls=True).over(so_far()),
            "sku_first_sale_date": F.min(F.when(quantity > 0, F.col("date"))).over(strictly_before()),
            **{f"lag_{k}": F.lag(quantity, k, 0.0).over(by_day()) for k in LAG_DAYS},
        }
    )


def rolling_columns(h: Column) -> dict[str, Column]:
    """W2. Trailing statistics of the shifted series; its artificial first zero counts."""
    columns: dict[str, Column] = {f"rolling_mean_{n}": F.avg(h).over(last_rows(n)) for n in (7, 14, 28, 56)}
    for n in (7, 28):
        columns[f"rolling_std_{n}"] = F.coalesce(F.stddev_samp(h).over(last_rows(n)), F.lit(0.0))
        columns[f"rolling_sum_{n}"] = F.sum(h).over(last_rows(n))
    columns["rolling_min_28"] = F.min(h).over(last_rows(28))
    columns["rolling_max_28"] = F.max(h).over(last_rows(28))
    return columns


def expanding_columns(h: Column, rh: Column) -> dict[str, Column]:
    """W3, W5. Statistics of the shifted series from its start."""
    sold, returned = F.sum(h).over(so_far()), F.sum(rh).over(so_far())
    return {
        "sku_avg_sales": F.avg(h).over(so_far()),
        "sku_sales_std": F.coalesce(F.stddev_samp(h).over(so_far()), F.lit(0.0)),
        "sku_total_sales": sold,
        "sku_nonzero_sales_ratio": F.avg((h > 0).cast("double")).over(so_far()),
        "sku_return_rate": safe_ratio(returned, sold + returned),
    }


def price_columns() -> dict[str, Column]:
    """W7, first half: the price known the day before, and the day before that."""
    return {
        "avg_unit_price": F.lag("_known", 1).over(by_day()),
        "lag_price_1": F.lag("_known", 2).over(by_day()),
    }


def _change(value: Column, base: Column) -> Column:
    return F.coalesce(F.try_divide(value, base) - 1.0, F.lit(0.0))


def sorted_sales(rows: DataFrame) -> DataFrame:
    """(item_code, _sales): positive quantities of each item with their days, by quantity; at most one per day."""
    sale = F.when(F.col("quantity_sold") > 0, F.struct(F.col("quantity_sold").cast("double").alias("q"), F.col("date").alias("d")))
    return rows.groupBy("item_code").agg(F.sort_array(F.collect_list(sale)).alias("_sales"))


def with_expanding_median(days: DataFrame, rows: DataFrame, first_day: Column) -> DataFrame:
    """W4. The exact median of the shifted series up to each of ``days``, from the item's sales alone.

    Sales are sorted by quantity once per item; those before a day keep that order, and all other days up to it are
    zeros. So a day costs one pass over the item's sales, and only the days that are asked for are answered.
    """
    met = days.join(sorted_sales(rows), "item_code", "left")
    known = F.filter(F.coalesce("_sales", F.array().cast("array<struct<q:double,d:date>>")), lambda s: s["d"] < F.col("date"))
    span = F.datediff("date", first_day) + 1
    return met.withColumn("sku_median_sales", median_with_zeros(F.transform(known, lambda s: s["q"]), span)).drop("_sales")


def history_features(panel: DataFrame) -> DataFrame:
    """M1. All history features for every row of a panel that starts on one day; the median from ``panel``'s sales."""
    first_day = scalar(panel, F.min("date"))
    return with_expanding_median(windowed_features(panel), panel, first_day)


def windowed_features(panel: DataFrame) -> DataFrame:
    """M1 without the median: three window passes over one item partitioning."""
    h, rh = F.col("_h"), F.col("_rh")
    first = with_shifted_series(panel)
    second = first.withColumns(
        {
            **rolling_columns(h),
            **expanding_columns(h, rh),
            **price_columns(),
            "sku_lifecycle_days": F.coalesce(F.datediff("date", "sku_first_sale_date"), F.lit(0)),
        }
    )
    prior = F.col("avg_unit_price")
    third = second.withColumns(
        {f"rolling_price_mean_{n}": F.avg(prior).over(last_rows(n)) for n in (7, 28)}
    )
    return third.withColumns(
        {
            "price_change_rate": _change(prior, F.col("lag_price_1")),
            "discount_proxy": _change(prior, F.col("rolling_price_mean_28")),
        }
    ).drop("_h", "_rh", "_known")


def history_as_of(rows: DataFrame, as_of: Column, first_day: Column) -> DataFrame:
    """W1-W7 at the single day ``as_of`` from sparse rows of a panel that starts on ``first_day``.

    ``rows`` holds (item_code, date, quantity_sold, return_quantity, avg_unit_price); a null date stands for
    an item without rows. Empty days are never created: a window of n days divides by min(n, days so far),
    the median counts implied zeros, and a price holds until the next priced day.
    """
    priced = "CASE WHEN avg_unit_price IS NOT NULL THEN date END"
    held = rows.withColumn(
        "_next_priced",
        F.expr(f"lead({priced}) IGNORE NULLS OVER (PARTITION BY item_code ORDER BY date)"),
    )
    day, quantity, returns, price = (
        F.col("date"),
        F.col("quantity_sold"),
        F.col("return_quantity"),
        F.col("avg_unit_price"),
    )
    past = day < as_of
    positive = past & (quantity > 0)
    span = F.col("_span")  # length of the shifted series, its first zero included

    def recent(n: int) -> Column:
        return past & (day >= F.date_sub(as_of, n))

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))

    def price_known(days_back: int) -> Column:
        usable = price.isNotNull() & (day <= F.date_sub(as_of, days_back))
        return F.max_by(F.when(usable, price), F.when(usable, day))

    def held_days(n: int) -> Column:
        until = F.least(F.coalesce(F.col("_next_priced"), as_of), as_of)
        since = F.greatest(day, F.date_sub(as_of, n))
        return F.when(past & price.isNotNull(), F.greatest(F.datediff(until, since), F.lit(0)))

    def price_mean(n: int) -> Column:
        return F.try_divide(F.sum(price * held_days(n)), F.sum(held_days(n)))

    aggregates = {f"lag_{k}": total(day == F.date_sub(as_of, k), quantity) for k in LAG_DAYS}
    for n in (7, 14, 28, 56):
        aggregates[f"_sum_{n}"] = total(recent(n), quantity)
    for n in (7, 28):
        aggregates[f"_squares_{n}"] = total(recent(n), quantity * quantity)
    aggregates |= {
        "_seen_28": F.count(F.when(recent(28), F.lit(1))),
        "_min_28": F.min(F.when(recent(28), quantity)),
        "_max_28": F.max(F.when(recent(28), quantity)),
        "sku_total_sales": total(past, quantity),
        "_squares": total(past, quantity * quantity),
        "_returned": total(past, returns),
        "_positives": F.sort_array(F.collect_list(F.when(positive, quantity))),
        "sku_first_sale_date": F.min(F.when(positive, day)),
        "avg_unit_price": price_known(1),
        "lag_price_1": price_known(2),
        "rolling_price_mean_7": price_mean(7),
        "rolling_price_mean_28": price_mean(28),
    }
    sums = (
        held.groupBy("item_code")
        .agg(*[column.alias(name) for name, column in aggregates.items()])
        .withColumn("_span", F.datediff(as_of, first_day) + 1)
    )

    def length(n: int) -> Column:
        return F.least(F.lit(n), span)

    sold = F.col("sku_total_sales")
    whole = F.col("_seen_28") >= length(28)
    out = {
        **{f"lag_{k}": F.col(f"lag_{k}") for k in LAG_DAYS},
        **{f"rolling_mean_{n}": F.col(f"_sum_{n}") / length(n) for n in (7, 14, 28, 56)},
        **{
            f"rolling_std_{n}": sample_std(F.col(f"_sum_{n}"), F.col(f"_squares_{n}"), length(n))
            for n in (7, 28)
        },
        "rolling_min_28": F.when(whole, F.col("_min_28")).otherwise(F.least(F.col("_min_28"), F.lit(0.0))),
        "rolling_max_28": F.greatest(F.col("_max_28"), F.lit(0.0)),
        **{f"rolling_sum_{n}": F.col(f"_sum_{n}") for n in (7, 28)},
        "sku_avg_sales": sold / span,
        "sku_median_sales": median_with_zeros(F.col("_positives"), span),
        "sku_sales_std": sample_std(sold, F.col("_squares"), span),
        "sku_total_sales": sold,
        "sku_nonzero_sales_ratio": F.size("_positives") / span,
        "sku_return_rate": safe_ratio(F.col("_returned"), sold + F.col("_returned")),
        "sku_lifecycle_days": F.coalesce(F.datediff(as_of, "sku_first_sale_date"), F.lit(0)),
        "avg_unit_price": F.col("avg_unit_price"),
        "lag_price_1": F.col("lag_price_1"),
        "rolling_price_mean_7": F.col("rolling_price_mean_7"),
        "rolling_price_mean_28": F.col("rolling_price_mean_28"),
        "price_change_rate": _change(F.col("avg_unit_price"), F.col("lag_price_1")),
        "discount_proxy": _change(F.col("avg_unit_price"), F.col("rolling_price_mean_28")),
        "sku_first_sale_date": F.col("sku_first_sale_date"),
    }
    return sums.select("item_code", *[column.alias(name) for name, column in out.items()])
