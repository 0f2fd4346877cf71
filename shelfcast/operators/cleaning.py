"""Bronze and silver projections of the loose-return pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import ERROR_LABELS
from shelfcast.functions.numbers import loose_return, positive_part
from shelfcast.functions.text import integer_number, iso_date, item_code, vn_decimal
from shelfcast.session import computed_once


def to_bronze(raw: DataFrame) -> DataFrame:
    """P9. Parse line number, quantity and both amounts; date, item and unit values stay text."""
    return raw.select(
        "batch_id",
        "source_file",
        "source_row_number",
        integer_number(F.col("stt_raw")).alias("stt"),
        "date_raw",
        "item_code_raw",
        vn_decimal(F.col("quantity_raw")).alias("quantity"),
        "unit_price_raw",
        vn_decimal(F.col("sales_amount_raw")).alias("sales_amount"),
        "unit_cost_raw",
        vn_decimal(F.col("cost_amount_raw")).alias("cost_amount"),
        "ingested_at",
        F.current_timestamp().alias("transformed_at"),
    )


def error_reason(*checked: Column) -> Column:
    """P11. Labels of the null columns joined by ``;`` in fixed order; null when all are present."""
    labels = [F.when(column.isNull(), F.lit(label)) for column, label in zip(checked, ERROR_LABELS)]
    return F.nullif(F.concat_ws(";", *labels), F.lit(""))


def to_silver(bronze: DataFrame) -> DataFrame:
    """P10. Typed rows with sales and returns split; bad rows are flagged, never dropped.

    Every field is parsed once, also when valid or invalid rows are filtered afterwards.
    """
    typed = bronze.select(
        "batch_id",
        "source_row_number",
        iso_date(F.col("date_raw")).alias("date"),
        item_code(F.col("item_code_raw")).alias("item_code"),
        "quantity",
        positive_part(F.col("quantity")).alias("sales_quantity"),
        positive_part(-F.col("quantity")).alias("return_quantity"),
        vn_decimal(F.col("unit_price_raw")).alias("unit_price"),
        "sales_amount",
        vn_decimal(F.col("unit_cost_raw")).alias("unit_cost"),
        "cost_amount",
        loose_return(F.col("quantity")).alias("is_return"),
    )
    checked = ["date", "item_code", "quantity", "unit_price", "sales_amount", "unit_cost", "cost_amount"]
    reason = computed_once(error_reason(*[F.col(c) for c in checked]))
    return typed.select("*", reason.alias("error_reason")).select(
        *typed.columns,
        F.col("error_reason").isNull().alias("is_valid"),
        "error_reason",
        F.current_timestamp().alias("transformed_at"),
    )


def explode_errors(silver: DataFrame) -> DataFrame:
    """One row per (silver row, error label)."""
    return silver.filter(~F.col("is_valid")).withColumn(
        "reason", F.explode(F.split(F.col("error_reason"), ";"))
    )
