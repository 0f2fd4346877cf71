"""Sale transactions derived from the lineitem and part tables.

A line is a sale on its ship day, or a return when its return flag is R. The item is the part's brand
(25 dense items) or the part itself (many intermittent items). Money is rounded to cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import RAW_COLUMNS, RAW_FIELD_NAMES
from shelfcast.functions.numbers import loose_return, positive_part
from shelfcast.operators.cleaning import to_bronze, to_silver
from shelfcast.operators.daily import gold_daily_sales, strict_daily_sales, with_strict_measures
from shelfcast.session import compile_wide_projections


def _cents(amount: Column) -> Column:
    # Half up on plain doubles: the same value in every engine, and no big-decimal rounding per row.
    return F.floor(F.abs(amount) * 100 + 0.5)


def _item(grain: str) -> Column:
    if grain == "brand":
        return F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))
    # lpad cuts what is longer than its width; keys of six digits and more must stay whole.
    return F.concat(F.lit("SKU-"), F.expr("lpad(string(l_partkey), greatest(5, length(string(l_partkey))), '0')"))


def typed(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Transactions with typed columns; the part side is broadcast only if Spark measures it as small."""
    compile_wide_projections(spark)
    used = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_shipdate"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*used)
    lines = lines.repartition("l_orderkey", "l_partkey")  # the test tables are one file each
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")

    def money(amount: Column) -> Column:
        return _cents(amount) / F.lit(100.0)

    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_orderkey").alias("stt"),
        _item(grain).alias("item_code"),
        (sign * quantity.cast("bigint")).alias("quantity"),
        money(price / quantity).alias("unit_price"),
        (sign * money(price * (1 - F.col("l_discount")))).alias("sales_amount"),
        money(F.col("p_retailprice")).alias("unit_cost"),
        (sign * money(quantity * F.col("p_retailprice"))).alias("cost_amount"),
        F.col("l_linenumber"),
        F.col("l_tax"),
        F.col("l_discount"),
    )


def _vn_text(amount: Column) -> Column:
    """``1.234,56``: dots every three digits, comma before the cents."""
    cents = _cents(amount)
    units = F.floor(cents / F.lit(100.0))
    # format_number is slow; only amounts of a million and more need it.
    thousands = F.concat(F.floor(units / 1000).cast("string"), F.lit("."), F.lpad((units % 1000).cast("string"), 3, "0"))
    whole = (
        F.when(units < 1000, units.cast("string"))
        .when(units < 1_000_000, thousands)
        .otherwise(F.translate(F.format_number(units, 0), ",", "."))
    )
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def as_text(transactions: DataFrame, faults: bool = True) -> DataFrame:
    """The eight file columns as text. With ``faults`` some lines get a bad date, no item or no price."""
    day = F.date_format("date", "yyyy-MM-dd")
    bad_day = F.date_format("date", "dd/MM/yyyy")
    spaced_item = F.concat(F.lit(" "), F.lower("item_code"), F.lit(" "))
    price = _vn_text(F.col("unit_price"))
    if faults:
        day = F.when(F.col("l_linenumber") == 7, bad_day).otherwise(day)
        spaced_item = F.when(F.col("l_tax") > 0.075, F.lit("  ")).otherwise(spaced_item)
        price = F.when(F.col("l_discount") > 0.095, F.lit("n/a")).otherwise(price)
    columns = [
        day,
        F.col("stt").cast("string"),
        spaced_item,
        F.col("quantity").cast("string"),
        price,
        _vn_text(F.col("sales_amount")),
        _vn_text(F.col("unit_cost")),
        _vn_text(F.col("cost_amount")),
    ]
    return transactions.select(*[c.alias(n) for c, n in zip(columns, RAW_COLUMNS)])


def raw(spark: SparkSession, sf_dir: str, grain: str = "brand", faults: bool = True) -> DataFrame:
    """The raw table of one batch; the line id stands in for the row number."""
    text = as_text(typed(spark, sf_dir, grain), faults)
    return text.select(
        F.lit("batch-1").alias("batch_id"),
        F.lit("transactions.csv").alias("source_file"),
        F.col("Stt").cast("bigint").alias("source_row_number"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(RAW_COLUMNS, RAW_FIELD_NAMES)],
        F.current_timestamp().alias("ingested_at"),
    )


def silver_from_text(spark: SparkSession, sf_dir: str, grain: str = "brand", faults: bool = True) -> DataFrame:
    return to_silver(to_bronze(raw(spark, sf_dir, grain, faults)))


def gold(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Gold from typed transactions, all of them valid."""
    quantity = F.col("quantity").cast("double")
    silver = typed(spark, sf_dir, grain).select(
        "date",
        "item_code",
        quantity.alias("quantity"),
        positive_part(quantity).alias("sales_quantity"),
        positive_part(-quantity).alias("return_quantity"),
        "unit_price",
        "sales_amount",
        "unit_cost",
        "cost_amount",
        loose_return(quantity).alias("is_return"),
        F.lit(True).alias("is_valid"),
    )
    return gold_daily_sales(silver)


def strict_daily(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    return strict_daily_sales(with_strict_measures(typed(spark, sf_dir, grain)))
