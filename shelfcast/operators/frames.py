"""Training and inference frames of the daily model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import CALENDAR_COLUMNS, FEATURE_COLUMNS, HISTORY_COLUMNS, KEY_COLUMNS, MAX_HORIZON
from shelfcast.functions.dates import as_date, with_calendar, with_horizons
from shelfcast.operators.history import history_as_of, windowed_features, with_expanding_median
from shelfcast.operators.panel import listed_gold, panel_of
from shelfcast.operators.selection import keep_items, top_volume_items
from shelfcast.session import scalar, spread


def _check_horizon(max_horizon: int) -> None:
    if not 1 <= max_horizon <= MAX_HORIZON:
        raise ValueError("max_horizon must be in 1..56")


def training_frame(
    gold: DataFrame,
    feature_version: str,
    max_items: int = 100,
    as_of_days: int = 60,
    max_horizon: int = MAX_HORIZON,
) -> DataFrame:
    """M2. Features at the last usable as-of days x horizons, with the quantity sold on the target day.

    The target of horizon h is read ahead within the item's own window, so no join and no further shuffle
    follow the panel. Check the result for emptiness with :func:`require_rows`.
    """
    _check_horizon(max_horizon)
    kept = keep_items(gold, top_volume_items(gold, max_items), max_items)
    panel = panel_of(kept)
    last_day = scalar(kept, F.max("date"))
    by_day = Window.partitionBy("item_code").orderBy("date")
    ahead = F.array(*[F.lead("quantity_sold", h, 0.0).over(by_day) for h in range(1, max_horizon + 1)])
    cutoff = F.date_sub(last_day, max_horizon)
    anchors = (
        windowed_features(panel)
        .withColumn("_ahead", ahead)
        .filter(F.col("date").between(F.date_sub(cutoff, as_of_days - 1), cutoff))
    )
    # Co-partitioned with the panel: the median is answered for the anchors only.
    anchors = with_expanding_median(anchors, spread(kept, "item_code"), scalar(kept, F.min("date")))
    rows = (
        anchors.withColumnRenamed("date", "as_of_date")
        .select("*", F.posexplode("_ahead").alias("_place", "target_quantity"))
        .withColumn("horizon", F.col("_place") + 1)
        .withColumn("target_date", F.date_add("as_of_date", F.col("horizon")))
        .withColumn("feature_version", F.lit(feature_version))
    )
    return with_calendar(rows).select(*KEY_COLUMNS, *FEATURE_COLUMNS)


def inference_frame(
    gold: DataFrame, items: DataFrame, forecast_date, max_horizon: int = MAX_HORIZON
) -> DataFrame:
    """M5. Features of all listed items at ``forecast_date`` x horizons, without densifying.

    Expanding statistics see only the days in ``gold`` (the lookback window), while training saw all history.
    """
    _check_horizon(max_horizon)
    as_of = as_date(forecast_date)
    rows = listed_gold(gold.filter(F.col("date") <= as_of), items)
    anchors = history_as_of(rows, as_of, scalar(rows, F.min("date"))).withColumn("as_of_date", as_of)
    frame = with_calendar(with_horizons(anchors, "as_of_date", max_horizon))
    return frame.select(
        F.col("as_of_date").alias("forecast_date"),
        "item_code",
        "as_of_date",
        "target_date",
        "horizon",
        *CALENDAR_COLUMNS,
        *HISTORY_COLUMNS,
    )


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    """F4, F5. Raise when ``frame`` has no row; else return it."""
    if frame.isEmpty():
        raise ValueError(message)
    return frame


def time_split(frame: DataFrame, validation_days: int = 28) -> tuple[DataFrame, DataFrame]:
    """F5. Rows before and from the first validation day, which counts back from the last target day."""
    start = F.date_sub(scalar(frame, F.max("target_date")), validation_days - 1)
    return frame.filter(F.col("target_date") < start), frame.filter(F.col("target_date") >= start)


def feature_registry(spark) -> DataFrame:
    """The registered features and their leakage policy as rows."""
    described = {
        "lag_7": "Quantity sold seven days before the as-of day.",
        "rolling_mean_28": "Mean quantity sold in the 28 days before the as-of day.",
        "sku_return_rate": "Share of returned quantity known at the as-of day.",
        "rolling_price_mean_28": "Mean known price in the 28 days before the as-of day.",
    }
    rows = [
        (name, "calendar" if name in CALENDAR_COLUMNS else "history", described.get(name),
         "target_date_only" if name in CALENDAR_COLUMNS else "strictly_before_as_of_date")
        for name in FEATURE_COLUMNS
    ]
    return spark.createDataFrame(rows, "name string, kind string, description string, leakage_policy string")
