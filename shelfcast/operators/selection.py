"""Choice of the items to model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import broadcast_if_bounded, scalar

STRATEGIES = ("top_profit", "active_recent_top_profit", "active_top_profit", "recent_top_profit")


def select_items(
    profile: DataFrame,
    strategy: str = "top_profit",
    top_n: int = 300,
    min_active_days: int = 50,
    max_days_since_last_sale: int = 56,
) -> DataFrame:
    """T2. The ``top_n`` items by profit weight after the strategy's filter; ties go by item code."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown item selection strategy: {strategy}")
    kept = profile
    if strategy in ("active_recent_top_profit", "active_top_profit"):
        kept = kept.filter(F.col("active_days") >= min_active_days)
    if strategy in ("active_recent_top_profit", "recent_top_profit"):
        kept = kept.filter(F.col("days_since_last_sale") <= max_days_since_last_sale)
    return kept.orderBy(F.desc("profit_weight"), F.asc("item_code")).limit(top_n)


def top_volume_items(gold: DataFrame, max_items: int = 100) -> DataFrame:
    """T1. The items with the largest total quantity sold; ties go by item code."""
    return (
        gold.groupBy("item_code")
        .agg(F.sum("quantity_sold").alias("total_quantity"))
        .orderBy(F.desc("total_quantity"), F.asc("item_code"))
        .limit(max_items)
    )


def keep_items(frame: DataFrame, items: DataFrame, max_items: int | None = None) -> DataFrame:
    """F2, J4. Rows of the listed items; the list is broadcast only when ``max_items`` bounds it."""
    keys = items.select("item_code")
    if max_items is not None:
        keys = broadcast_if_bounded(keys, max_items)
    return frame.join(keys, "item_code", "left_semi")


def active_items(gold: DataFrame, lookback_days: int | None = 730) -> DataFrame:
    """S8, J6. Items with a gold row in the last ``lookback_days`` days; null or <= 0 means all items.

    The window ends at gold's own last day, not at the forecast date.
    """
    rows = gold
    if lookback_days is not None and lookback_days > 0:
        last_day = scalar(gold, F.max("date"))
        rows = gold.filter(F.col("date") >= F.date_sub(last_day, lookback_days - 1))
    return rows.select("item_code").distinct()


def training_items(features: DataFrame, feature_version: str) -> DataFrame:
    """S9. Items a feature version was built for."""
    return features.filter(F.col("feature_version") == feature_version).select("item_code").distinct()


def gold_window(gold: DataFrame, forecast_date, lookback_days: int = 730) -> DataFrame:
    """S7. Gold rows of the ``lookback_days`` days that end at ``forecast_date``, five columns."""
    from shelfcast.functions.dates import as_date

    last = as_date(forecast_date)
    return gold.filter(F.col("date").between(F.date_sub(last, lookback_days - 1), last)).select(
        "date", "item_code", "quantity_sold", "return_quantity", "avg_unit_price"
    )
