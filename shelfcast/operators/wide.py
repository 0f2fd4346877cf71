"""Wide forecast files: 28 value columns, two rows per item."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import HALF_HORIZON, MAX_HORIZON
from shelfcast.functions.dates import as_date
from shelfcast.functions.text import wide_horizon, wide_id_item

# F1..F28.
VALUE_COLUMNS = [f"F{k}" for k in range(1, HALF_HORIZON + 1)]


def to_wide(forecast: DataFrame) -> DataFrame:
    """R2. Horizons 1..28 become the item's ``_validation`` row, 29..56 its ``_evaluation`` row."""
    early = F.col("horizon") <= HALF_HORIZON
    suffix = F.when(early, F.lit("_validation")).otherwise(F.lit("_evaluation"))
    place = F.when(early, F.col("horizon")).otherwise(F.col("horizon") - HALF_HORIZON)
    rows = forecast.select(F.concat("item_code", suffix).alias("id"), place.alias("_place"), "yhat")
    cells = [
        F.first(F.when(F.col("_place") == k, F.col("yhat")), ignorenulls=True).alias(name)
        for k, name in enumerate(VALUE_COLUMNS, start=1)
    ]
    return rows.groupBy("id").agg(*cells)


def in_file_order(wide: DataFrame) -> DataFrame:
    """All validation rows first, then all evaluation rows, each by item; for output only."""
    return wide.orderBy(F.col("id").endswith("_evaluation"), "id")


def check_wide(wide: DataFrame) -> DataFrame:
    """R3. One row of counters that must be zero, from one pass over the wide rows.

    Checked per item: exactly one row in each half, which is 56 distinct horizons without a repeat.
    """
    nulls = F.greatest(*[(F.col(c).isNull() | F.isnan(F.col(c))).cast("int") for c in VALUE_COLUMNS])
    negative = F.greatest(*[F.coalesce((F.col(c) < 0).cast("int"), F.lit(0)) for c in VALUE_COLUMNS])
    item = wide_id_item(F.col("id"))
    first_half = F.col("id").endswith("_validation")
    per_item = wide.groupBy(item.alias("item_code")).agg(
        F.sum(nulls).alias("_nulls"),
        F.sum(negative).alias("_negative"),
        F.count(F.when(first_half, F.lit(1))).alias("_first"),
        F.count(F.when(~first_half, F.lit(1))).alias("_second"),
    )
    named = F.col("item_code").isNotNull()
    gap = named & ((F.col("_first") == 0) | (F.col("_second") == 0))
    repeat = named & ((F.col("_first") > 1) | (F.col("_second") > 1))
    return per_item.agg(
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_rows"),
        F.count(F.when(gap, F.lit(1))).alias("items_without_56_horizons"),
        F.count(F.when(repeat, F.lit(1))).alias("items_with_duplicates"),
        F.count(F.when(named, F.lit(1))).alias("items"),
    )


def require_valid_wide(wide: DataFrame) -> None:
    """R3. Raise on a wrong header, missing or negative values, gaps, repeats or an empty file."""
    if wide.columns != ["id", *VALUE_COLUMNS]:
        raise ValueError("Wide forecast columns must be id followed by F1..F28")
    counts = check_wide(wide).first().asDict()
    if counts["null_rows"]:
        raise ValueError("Wide forecast contains missing predictions")
    if counts["negative_rows"]:
        raise ValueError("Wide forecast contains negative predictions")
    if counts["items"] == 0 or counts["items_without_56_horizons"]:
        raise ValueError("Each item must have exactly 56 forecast horizons")
    if counts["items_with_duplicates"]:
        raise ValueError("Wide forecast contains duplicate item/horizon records")


def to_long(wide: DataFrame, forecast_date: str | dt.date) -> DataFrame:
    """R3. Long rows (forecast_date, item_code, target_date, horizon, predicted_quantity).

    Ids with neither suffix are ignored. Unpivot is a map step: nothing is shuffled.
    """
    start = as_date(forecast_date)
    rows = wide.unpivot("id", VALUE_COLUMNS, "period", "predicted_quantity")
    horizon = wide_horizon(F.col("id"), F.col("period"))
    return rows.filter(wide_id_item(F.col("id")).isNotNull()).select(
        start.alias("forecast_date"),
        wide_id_item(F.col("id")).alias("item_code"),
        F.date_add(start, horizon).alias("target_date"),
        horizon.alias("horizon"),
        F.col("predicted_quantity").cast("double").alias("predicted_quantity"),
    )


def cover_ids(ids: DataFrame, wide: DataFrame) -> DataFrame:
    """J11. The wide rows of the listed ids, values clipped at zero; raises when a value is missing."""
    joined = ids.select("id").join(wide, "id", "left")
    missing = joined.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in VALUE_COLUMNS]) == 1)
    if not missing.isEmpty():
        raise ValueError("forecast has missing ids")
    return joined.select("id", *[F.greatest(F.col(c), F.lit(0.0)).alias(c) for c in VALUE_COLUMNS])


def replace_items(wide: DataFrame, replacement: DataFrame) -> DataFrame:
    """R4. Replace the 56 values of the items in long ``replacement`` (item_code, horizon, yhat).

    Every replaced item must have exactly one row in each half and exactly 56 new values.
    """
    new_items = replacement.groupBy("item_code").agg(
        F.count(F.lit(1)).alias("_values"), F.count_distinct("horizon").alias("_horizons")
    )
    if not new_items.filter((F.col("_values") != MAX_HORIZON) | (F.col("_horizons") != MAX_HORIZON)).isEmpty():
        raise ValueError("Expected 56 forecast values")
    named = wide.withColumn("item_code", wide_id_item(F.col("id")))
    halves = named.groupBy("item_code").agg(
        F.count(F.when(F.col("id").endswith("_validation"), F.lit(1))).alias("_first"),
        F.count(F.when(F.col("id").endswith("_evaluation"), F.lit(1))).alias("_second"),
    )
    found = new_items.join(halves, "item_code", "left")
    if not found.filter(
        (F.coalesce("_first", F.lit(0)) != 1) | (F.coalesce("_second", F.lit(0)) != 1)
    ).isEmpty():
        raise ValueError("Missing or duplicate row for a replaced item")
    renamed = to_wide(replacement).withColumnsRenamed({c: f"_{c}" for c in VALUE_COLUMNS})
    return wide.join(renamed, "id", "left").select(
        "id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in VALUE_COLUMNS]
    )
