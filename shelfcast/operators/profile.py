"""Item profile as of a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import NEVER_SOLD_DAYS
from shelfcast.functions.dates import as_date
from shelfcast.functions.numbers import safe_ratio
from shelfcast.session import scalar


def item_profile(daily: DataFrame, as_of: str | dt.date | None = None) -> DataFrame:
    """A3, F3. Twelve statistics per item from sparse daily rows, zeros implied by the day count.

    Every item of ``daily`` gets a row, also one first sold after ``as_of``. One shuffle by item; the global
    profit sum is a scalar subquery.
    """
    last_day = scalar(daily, F.max("date"))
    cut = F.least(as_date(as_of), last_day) if as_of is not None else last_day
    day_count = F.datediff(cut, scalar(daily, F.min("date"))) + 1
    kept = F.col("date") <= cut
    sold = kept & (F.col("sales_qty") > 0)

    def total(name: str):
        return F.coalesce(F.sum(F.when(kept, F.col(name))), F.lit(0.0))

    sums = daily.groupBy("item_code").agg(
        total("sales_qty").alias("total_sales_qty"),
        F.count(F.when(sold, F.lit(1))).cast("int").alias("active_days"),
        total("profit").alias("total_profit"),
        total("return_qty").alias("return_qty"),
        F.max(F.when(sold, F.col("date"))).alias("last_sale_date"),
    )
    positive = F.greatest(F.col("total_profit"), F.lit(0.0))
    return sums.select(
        "item_code",
        "total_sales_qty",
        "active_days",
        (1.0 - F.col("active_days") / day_count).alias("zero_ratio"),
        (F.col("total_sales_qty") / day_count).alias("avg_daily_qty"),
        safe_ratio(F.col("total_sales_qty"), F.col("active_days")).alias("avg_qty_when_active"),
        "total_profit",
        positive.alias("positive_profit"),
        safe_ratio(positive, scalar(sums, F.sum(positive))).alias("profit_weight"),
        "return_qty",
        safe_ratio(F.col("return_qty"), F.col("total_sales_qty")).alias("return_ratio"),
        "last_sale_date",
        F.coalesce(F.datediff(cut, F.col("last_sale_date")), F.lit(NEVER_SOLD_DAYS)).alias(
            "days_since_last_sale"
        ),
    )
