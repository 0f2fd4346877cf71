"""Quality gates run before a table is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import HISTORY_COLUMNS, KEY_COLUMNS, MAX_HORIZON


class QualityError(ValueError):
    """A gating counter is not zero."""


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side as scalar subqueries of the first."""
    first, *others = frames
    return first.select("*", *[other.select(c).scalar().alias(c) for other in others for c in other.columns])


def _key_counts(frame: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Rows and surplus rows per key, pre-aggregated; ``extra`` are further per-key aggregates."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *extra)


def gold_quality(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """A4. Row counts and six gating counters of silver and gold, one row."""
    silver_side = silver.agg(
        F.count(F.lit(1)).alias("silver_rows"),
        _count_if(F.col("is_valid")).alias("valid_silver_rows"),
        _count_if(~F.col("is_valid")).alias("invalid_silver_rows"),
    )
    per_key = _key_counts(
        gold,
        ["date", "item_code"],
        [
            _count_if(F.col("return_quantity") < 0).alias("_negative"),
            _count_if(F.col("transaction_count") < 1).alias("_uncounted"),
        ],
    )
    gold_side = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("gold_rows"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("_rows"))), F.lit(0)).alias("null_gold_dates"),
        F.coalesce(F.sum(F.when(F.col("item_code").isNull(), F.col("_rows"))), F.lit(0)).alias(
            "null_gold_item_codes"
        ),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_gold_keys"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_return_quantity"),
        F.coalesce(F.sum("_uncounted"), F.lit(0)).alias("invalid_transaction_count"),
    )
    return _one_row(gold_side, silver_side)


GOLD_GATES = [
    "invalid_silver_rows",
    "null_gold_dates",
    "null_gold_item_codes",
    "duplicate_gold_keys",
    "negative_return_quantity",
    "invalid_transaction_count",
]


def feature_quality(features: DataFrame) -> DataFrame:
    """A5. Sizes and six gating counters of a training frame, one row.

    The frame is first reduced per key, so the distinct counts run on keys alone.
    """
    infinite = sum(
        (F.when(F.abs(F.col(c)) == float("inf"), F.lit(1)).otherwise(F.lit(0)) for c in HISTORY_COLUMNS),
        F.lit(0),
    )
    null_key = F.greatest(*[F.col(c).isNull().cast("int") for c in KEY_COLUMNS])
    per_key = _key_counts(
        features,
        ["feature_version", "as_of_date", "item_code", "horizon"],
        [
            F.sum(null_key).alias("_null_keys"),
            _count_if(F.col("target_quantity") < 0).alias("_negative"),
            _count_if(F.col("target_date") <= F.col("as_of_date")).alias("_not_future"),
            F.sum(infinite).alias("_infinite"),
        ],
    )
    sizes = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_null_keys"), F.lit(0)).alias("null_keys"),
        F.coalesce(
            F.sum(F.when(~F.coalesce(F.col("horizon").between(1, MAX_HORIZON), F.lit(False)), F.col("_rows"))),
            F.lit(0),
        ).alias("invalid_horizons"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_targets"),
        F.coalesce(F.sum("_not_future"), F.lit(0)).alias("target_not_future"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("_infinite"), F.lit(0)).alias("infinite_features"),
        F.count_distinct("item_code").alias("skus"),
        F.count_distinct("as_of_date").alias("as_of_dates"),
        F.count_distinct("horizon").alias("horizons"),
    )
    return sizes.select("rows", "skus", "as_of_dates", "horizons", *FEATURE_GATES)


FEATURE_GATES = [
    "null_keys",
    "invalid_horizons",
    "negative_targets",
    "target_not_future",
    "duplicate_keys",
    "infinite_features",
]


def forecast_quality(forecast: DataFrame, expected: DataFrame, max_horizon: int = MAX_HORIZON) -> DataFrame:
    """A6, J5, U3. Sizes and six gating counters of a forecast against the expected items, one row."""
    quantity = F.col("predicted_quantity")
    missing_value = quantity.isNull() | F.isnan(quantity)
    per_key = _key_counts(
        forecast,
        ["item_code", "target_date"],
        [
            F.sum((~F.coalesce(F.col("horizon").between(1, max_horizon), F.lit(False))).cast("int")).alias(
                "_horizon"
            ),
            _count_if((quantity < 0) & ~missing_value).alias("_negative"),
            _count_if(missing_value).alias("_null"),
            _count_if(
                F.coalesce(F.datediff("target_date", "forecast_date") != F.col("horizon"), F.lit(True))
            ).alias("_wrong"),
        ],
    )
    totals = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count_distinct("item_code").alias("skus"),
        F.coalesce(F.sum("_horizon"), F.lit(0)).alias("invalid_horizons"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_predictions"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_predictions"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("_wrong"), F.lit(0)).alias("wrong_target_date"),
    )
    horizons = forecast.agg(F.count_distinct("horizon").alias("horizons"))
    listed = expected.select("item_code").distinct()
    missing = listed.join(forecast.select("item_code"), "item_code", "left_anti")
    return _one_row(
        totals,
        horizons,
        listed.agg(F.count(F.lit(1)).alias("expected_skus")),
        missing.agg(F.count(F.lit(1)).alias("missing_skus")),
    ).select("rows", "skus", "expected_skus", "horizons", *FORECAST_GATES)


FORECAST_GATES = [
    "missing_skus",
    "invalid_horizons",
    "negative_predictions",
    "null_predictions",
    "duplicate_keys",
    "wrong_target_date",
]


def require_clean(report: DataFrame, gates: list[str], what: str) -> dict[str, int]:
    """Raise when a gating counter is not zero; else return the report as a dict. One row is fetched."""
    counts = report.first().asDict()
    failed = {name: counts[name] for name in gates if counts[name]}
    if failed:
        raise QualityError(f"{what} quality checks failed: {failed}")
    return counts
