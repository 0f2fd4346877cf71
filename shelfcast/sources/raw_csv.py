"""Transaction and forecast CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import RAW_COLUMNS, RAW_FIELD_NAMES
from shelfcast.operators.daily import type_transactions
from shelfcast.session import written_table

MAX_SPLIT_BYTES = 64 << 20  # of split offsets that every task may hold


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def check_header(spark: SparkSession, path: str) -> list[str]:
    """S1. The header must equal the contract, in order; a missing file raises as well."""
    first_lines = spark.read.option("header", False).csv(path).limit(1).collect()
    columns = [value or "" for value in first_lines[0]] if first_lines else []
    if columns != RAW_COLUMNS:
        raise ValueError(f"Unexpected raw columns: {columns}")
    return columns


def read_raw(spark: SparkSession, path: str, batch_id: str, multi_line: bool = False) -> DataFrame:
    """S2. All fields as text plus lineage; ``source_row_number`` is 1..n in file order.

    Rows are numbered without a global sort: each file split knows its start offset, so the number is the
    place in the split plus the row counts of the earlier splits of the same file. The counts, one row per split, come
    from a scan of their own and are broadcast if they measure less than ``MAX_SPLIT_BYTES``, so the text is not shuffled.
    Empty fields are "". The header of the first file is checked at once, that of every other file when it is read.
    """
    check_header(spark, path)
    rows = (
        spark.read.schema(_text_schema(RAW_COLUMNS))
        .options(header=True, enforceSchema=False, multiLine=multi_line, quote='"', escape='"', nullValue=None)
        .csv(path)
        .select(
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
            *[
                F.coalesce(F.col(f"`{column}`"), F.lit("")).alias(name)
                for column, name in zip(RAW_COLUMNS, RAW_FIELD_NAMES)
            ],
        )
    )
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy("_path", "_start")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
        .select(
            "_path",
            "_start",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        )
    )
    splits = written_table(splits)
    n_bytes = splits.agg(F.coalesce(F.sum(F.length("_path") + 24), F.lit(0))).first()[0]
    if n_bytes <= MAX_SPLIT_BYTES:
        splits = F.broadcast(splits)
    return rows.join(splits, ["_path", "_start"]).select(
        F.lit(batch_id).alias("batch_id"),
        "source_file",
        (F.col("_id") + F.col("_shift")).alias("source_row_number"),
        *RAW_FIELD_NAMES,
        F.current_timestamp().alias("ingested_at"),
    )


def read_transactions(spark: SparkSession, path: str, amounts: str = "infer") -> DataFrame:
    """S3. Typed transactions of the strict-return definition.

    ``amounts`` says how SalesAmount and Cost Amount are written: ``vn`` (comma decimals), ``plain`` (dot
    decimals) or ``infer``, which looks at every value of each column once, as a typed CSV read would.
    """
    check_header(spark, path)
    text = spark.read.schema(_text_schema(RAW_COLUMNS)).options(header=True, enforceSchema=False, quote='"', escape='"').csv(path)
    return type_transactions(text, amounts)


def read_wide_forecast(spark: SparkSession, path: str) -> DataFrame:
    """S11. A wide forecast file: ``id`` and F1..F28, header checked."""
    from shelfcast.operators.wide import VALUE_COLUMNS

    header = spark.read.option("header", False).csv(path).limit(1).collect()
    if not header or list(header[0]) != ["id", *VALUE_COLUMNS]:
        raise ValueError("Wide forecast columns must be id followed by F1..F28")
    schema = T.StructType(
        [T.StructField("id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in VALUE_COLUMNS]
    )
    return spark.read.schema(schema).options(header=True, enforceSchema=False).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """S11. The ids a wide forecast must cover."""
    return spark.read.option("header", True).csv(path).select("id")
