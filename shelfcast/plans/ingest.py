"""From a transaction file to published gold, and the strict-return foundation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.cleaning import to_bronze, to_silver
from shelfcast.operators.daily import gold_daily_sales, strict_daily_sales
from shelfcast.operators.profile import item_profile
from shelfcast.operators.quality import GOLD_GATES, gold_quality, require_clean
from shelfcast.operators.scoring import backtest_baselines
from shelfcast.sources.raw_csv import check_header, read_raw, read_transactions
from shelfcast.sources.tables import TableStore

STAGES = ("validate", "raw", "bronze", "silver", "gold", "quality", "all")


def run_stage(spark: SparkSession, store: TableStore, source: str, batch_id: str, stage: str = "all") -> dict:
    """Run one ingest stage, or all of them; returns row counts.

    Each layer is written in parallel and read back as a pruned batch. With ``all`` the gate runs before gold
    is replaced, so a failed batch leaves the published gold untouched.
    """
    if stage not in STAGES:
        raise ValueError(f"Unknown stage: {stage}")
    if stage == "validate":
        check_header(spark, source)
        return {"validated": 1}
    counts: dict[str, int] = {}
    if stage in ("raw", "all"):
        store.replace_slice("raw", read_raw(spark, source, batch_id), batch_id)
        counts["raw_rows"] = store.batch("raw", batch_id).count()
    if stage in ("bronze", "all"):
        store.replace_slice("bronze", to_bronze(store.batch("raw", batch_id)), batch_id)
        counts["bronze_rows"] = store.batch("bronze", batch_id).count()
    if stage in ("silver", "all"):
        store.replace_slice("silver", to_silver(store.batch("bronze", batch_id)), batch_id)
        counts["silver_rows"] = store.batch("silver", batch_id).count()
    if stage in ("gold", "all"):
        gold = gold_daily_sales(store.batch("silver", batch_id)).withColumn("created_at", F.current_timestamp())
        if stage == "all":
            gold = gold.persist()
            try:
                counts |= require_clean(gold_quality(store.batch("silver", batch_id), gold), GOLD_GATES, "Data")
                store.replace_all("gold", gold)
            finally:
                gold.unpersist()
        else:
            store.replace_all("gold", gold)
        counts["gold_rows"] = store.gold().count()
    if stage == "quality":
        return require_clean(gold_quality(store.batch("silver", batch_id), store.gold()), GOLD_GATES, "Data")
    return counts


def build_foundation(spark: SparkSession, store: TableStore, source: str, amounts: str = "infer") -> DataFrame:
    """Strict daily sales, item profile and baseline scores of a file, saved as artifacts; returns the scores."""
    store.save_artifact("daily_sales", strict_daily_sales(read_transactions(spark, source, amounts)))
    daily = spark.read.parquet(store.path("artifacts/daily_sales"))
    store.save_artifact("item_profile", item_profile(daily))
    last_date = daily.agg(F.max("date")).first()[0]
    store.save_artifact("baseline_scores", backtest_baselines(daily, last_date))
    return spark.read.parquet(store.path("artifacts/baseline_scores"))
