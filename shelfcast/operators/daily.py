"""Typed transactions and the two daily aggregates (S3, A1, A2).

Both aggregates combine on the map side, so a day or item holding most of the lines costs one partial row
per task, and every later step sees at most one row per item and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numbers import strict_return
from shelfcast.functions.text import iso_date, plain_number, vn_decimal


def type_transactions(text: DataFrame, amounts: str = "infer") -> DataFrame:
    """S3, P6-P8. Type the eight text columns; unreadable quantities and amounts count as 0."""
    amount_columns = ["SalesAmount", "Cost Amount"]
    if amounts not in {"vn", "plain", "infer"}:
        raise ValueError("amounts must be vn, plain or infer")
    readers = {name: vn_decimal if amounts == "vn" else plain_number for name in amount_columns}
    if amounts == "infer":
        checks = [
            F.bool_and(
                F.col(f"`{name}`").isNull()
                | (F.col(f"`{name}`") == "")
                | plain_number(F.col(f"`{name}`")).isNotNull()
            ).alias(name)
            for name in amount_columns
        ]
        found = text.agg(*checks).first()
        readers = {n: vn_decimal if found[n] is False else plain_number for n in amount_columns}
    quantity = F.coalesce(plain_number(F.col("Quantity")).try_cast("bigint"), F.lit(0))
    typed = text.select(
        iso_date(F.col("Date")).alias("date"),
        plain_number(F.col("Stt")).try_cast("bigint").alias("stt"),
        F.nullif(F.col("ItemCode"), F.lit("")).alias("item_code"),
        quantity.alias("quantity"),
        vn_decimal(F.col("UnitPrice")).alias("unit_price"),
        F.coalesce(readers["SalesAmount"](F.col("SalesAmount")), F.lit(0.0)).alias("sales_amount"),
        vn_decimal(F.col("`Unit Cost`")).alias("unit_cost"),
        F.coalesce(readers["Cost Amount"](F.col("`Cost Amount`")), F.lit(0.0)).alias("cost_amount"),
    )
    return with_strict_measures(typed)


def with_strict_measures(typed: DataFrame) -> DataFrame:
    """P4, P6, P7 of the strict-return definition on typed columns."""
    quantity = F.col("quantity")
    is_return = strict_return(quantity, F.col("sales_amount"), F.col("cost_amount"))
    return typed.withColumns(
        {
            "is_return": is_return,
            "sales_qty": F.greatest(quantity, F.lit(0)).cast("double"),
            "return_qty": F.when(is_return, -quantity).otherwise(F.lit(0)).cast("double"),
            "net_qty": quantity.cast("double"),
            "profit": F.col("sales_amount") - F.col("cost_amount"),
        }
    )


def strict_daily_sales(transactions: DataFrame) -> DataFrame:
    """A1. Sums per date and item; rows without date or item form no group."""
    measures = ["sales_qty", "return_qty", "net_qty", "sales_amount", "cost_amount", "profit"]
    return (
        transactions.filter(F.col("date").isNotNull() & F.col("item_code").isNotNull())
        .groupBy("date", "item_code")
        .agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("line_count"))
    )


def gold_daily_sales(silver: DataFrame) -> DataFrame:
    """A2, F1. Sums per date and item over valid rows; unit price and cost are unweighted line means."""
    return (
        silver.filter("is_valid")
        .groupBy("date", "item_code")
        .agg(
            F.sum("sales_quantity").alias("quantity_sold"),
            F.sum("return_quantity").alias("return_quantity"),
            F.sum("quantity").alias("net_quantity"),
            F.sum("sales_amount").alias("sales_amount"),
            F.sum("cost_amount").alias("cost_amount"),
            F.avg("unit_price").alias("avg_unit_price"),
            F.avg("unit_cost").alias("avg_unit_cost"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
    )
