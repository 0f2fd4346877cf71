"""Spark session and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows a side may have to be broadcast by a hint. Sides without a known row bound are
# never hinted: Spark decides from their measured size.
MAX_BROADCAST_ROWS = 100_000
HUGE_METHOD_BYTES = 8000  # the JVM does not compile methods above; wide projections run faster split up


def build_session(app_name: str = "shelfcast", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with the settings the jobs rely on.

    Shuffle partitions are left to the cluster; adaptive execution coalesces or splits them at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD_BYTES))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting: a new local folder is used then. On a cluster each
    executor would write to its own disk, so the lack of a shared folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="shelfcast-checkpoint-"))
    return context.getCheckpointDir()


def reliable_checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage of ``frame`` with a checkpoint that survives the loss of executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def broadcast_if_bounded(frame: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the caller can prove ``frame`` has at most ``max_rows`` rows."""
    return F.broadcast(frame) if max_rows <= MAX_BROADCAST_ROWS else frame


def scalar(frame: DataFrame, expression: Column) -> Column:
    """One global aggregate of ``frame`` as a scalar subquery, usable in any expression."""
    return frame.select(expression).scalar()


def computed_once(value: Column) -> Column:
    """``value`` unchanged, in a projection that later filters stay above.

    A filter is otherwise moved below the projections that its columns come from and repeats all they compute. The row
    id is never negative, and as it is bound to the row's place, Spark leaves the projection where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def compile_wide_projections(spark: SparkSession) -> None:
    """Have projections whose code the JVM would interpret split up, also in sessions not from :func:`build_session`."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > HUGE_METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_BYTES)


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables a job writes and reads back, next to the checkpoints (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder a job wrote for itself and will not read again, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written_table(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as Parquet to the shared work folder and read it back.

    Cuts the lineage like a checkpoint, and later reads still prune columns and push filters down. For results
    that several branches of a job use.
    """
    path = f"{work_folder(frame.sparkSession)}/table"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly ``spark.sql.shuffle.partitions`` parts.

    For steps that multiply rows after the shuffle (gap filling, forecast days): adaptive execution would
    size the parts by the small input and leave the multiplied work to few tasks.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
