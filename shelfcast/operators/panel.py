"""Dense item x day panels.

The panel is not a join of items with a calendar. Each observed row knows the next observed day of its item
and emits the empty days up to it, so densifying costs one shuffle by item, and every window over
``item_code`` that follows reuses that partitioning. A group never exceeds the number of calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.dates import as_date
from shelfcast.operators.selection import keep_items
from shelfcast.session import scalar, spread

GOLD_MEASURES = {"quantity_sold": 0.0, "return_quantity": 0.0, "avg_unit_price": None}


def fill_gaps(sparse: DataFrame, first_day: Column, last_day: Column, measures: dict[str, float | None]) -> DataFrame:
    """One row per item and day from ``first_day`` to ``last_day``; gaps get the measure's default.

    ``sparse`` has at most one row per item and day within the range. An item whose only row has a null date
    gets all its days filled.
    """
    by_day = Window.partitionBy("item_code").orderBy("date")
    seen = sparse.select(
        "item_code",
        F.col("date").alias("_seen"),
        *measures,
        F.lag("date").over(by_day).alias("_previous"),
        F.lead("date").over(by_day).alias("_next"),
    )
    begin = F.when(F.col("_previous").isNull(), first_day).otherwise(F.col("_seen"))
    end = F.when(F.col("_next").isNull(), last_day).otherwise(F.date_sub(F.col("_next"), 1))
    daily = seen.withColumn("date", F.explode(F.sequence(begin, end)))
    observed = F.col("date") == F.col("_seen")
    return daily.select(
        "item_code",
        "date",
        *[F.when(observed, F.col(name)).otherwise(F.lit(empty)).alias(name) for name, empty in measures.items()],
    )


def _typed_gold(gold: DataFrame) -> DataFrame:
    return gold.select("item_code", "date", *[F.col(name).cast("double").alias(name) for name in GOLD_MEASURES])


def panel_of(kept: DataFrame) -> DataFrame:
    """Panel of all items of ``kept`` over the days ``kept`` spans."""
    first, last = scalar(kept, F.min("date")), scalar(kept, F.max("date"))
    return fill_gaps(spread(_typed_gold(kept), "item_code"), first, last, GOLD_MEASURES)


def training_panel(gold: DataFrame, items: DataFrame, max_items: int | None = None) -> DataFrame:
    """M3. Panel of the listed items over the days their own gold rows span."""
    return panel_of(keep_items(gold, items, max_items))


def listed_gold(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Gold rows of every listed item; an item without rows keeps one row with a null date."""
    listed = spread(items.select("item_code").distinct(), "item_code")
    return listed.join(spread(_typed_gold(gold), "item_code"), "item_code", "left")


def inference_panel(gold: DataFrame, items: DataFrame, forecast_date) -> DataFrame:
    """M4. Panel of all listed items, also those without gold rows, from their first gold day to the forecast day."""
    last = as_date(forecast_date)
    rows = listed_gold(gold.filter(F.col("date") <= last), items)
    first = scalar(rows, F.min("date"))
    return fill_gaps(rows, first, last, GOLD_MEASURES)


def demand_panel(
    daily: DataFrame,
    items: DataFrame | None = None,
    first_day: Column | None = None,
    last_day: Column | None = None,
    target: str = "sales_qty",
    max_items: int | None = None,
) -> DataFrame:
    """R1. Long demand matrix (item_code, date, qty) of ``daily``; ``target`` picks the measure.

    The days default to those of the whole ``daily``. Listed items without any row get zeros.
    """
    first = first_day if first_day is not None else scalar(daily, F.min("date"))
    last = last_day if last_day is not None else scalar(daily, F.max("date"))
    rows = daily.filter(F.col("date").between(first, last))
    universe = items if items is not None else daily
    if items is not None and max_items is not None:
        rows = keep_items(rows, items, max_items)
    rows = rows.groupBy("item_code", "date").agg(F.sum(target).cast("double").alias("qty"))
    listed = spread(universe.select("item_code").distinct(), "item_code")
    rows = listed.join(spread(rows, "item_code"), "item_code", "left")
    return fill_gaps(rows, first, last, {"qty": 0.0})
