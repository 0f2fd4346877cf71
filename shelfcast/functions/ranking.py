"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import broadcast_if_bounded, reliable_checkpoint

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the low 33 bits


def with_global_row_number(frame: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in a total order, spread over all tasks.

    Rows are range-partitioned on the full order, so even one value held by a third of the rows is split by
    the later keys (give a unique order). The layout is fixed by a checkpoint; the number is the row's place
    in its partition plus the row counts of the partitions before it. Only those counts, one row per
    partition, go through one task.
    """
    ranged = reliable_checkpoint(frame.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    offsets = broadcast_if_bounded(offsets, max_rows=int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_offset")
    )
