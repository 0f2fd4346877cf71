"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DIRECT_COLUMNS, HISTORY_COLUMNS, MODEL_COLUMNS, RAW_FIELD_NAMES, DirectConfig, KeyItemRule
from shelfcast.contract import transactions as tx
from shelfcast.functions.text import vn_decimal
from shelfcast.operators import baselines, blend, boosting, direct, frames, history, models, monitoring, panel, postprocess, quality
from shelfcast.operators import recursive, scoring, selection, serving, wide
from shelfcast.operators.cleaning import explode_errors
from shelfcast.operators.daily import gold_daily_sales, strict_daily_sales, type_transactions
from shelfcast.operators.profile import item_profile
from shelfcast.plans import daily_model, direct_models
from shelfcast.session import work_folder, written_table
from shelfcast.sources.raw_csv import read_ids, read_raw, read_transactions, read_wide_forecast
from shelfcast.sources.runs import FORECAST_COLUMNS, RunStore
from shelfcast.sources.tables import TableStore, in_training_order

Query = Callable[[SparkSession, str], DataFrame]

TRAIN_END = "2001-08-31"
EARLIER_END = "2001-07-31"
LAST_DATE = "2001-10-31"
ENDED_SINCE = "2001-01-01"
TOP = 20
DIGITS = 6
# Added before rounding: exact halves (41/640 at six digits) then round the same way in every engine.
TIE_SHIFT = "3e-9"

RULES = [
    KeyItemRule("BRAND-1", 0.25, 26, "median", True, True),
    KeyItemRule("BRAND-2", 0.15, 26, "mean", True, True),
    KeyItemRule("BRAND-3", 0.0, 8, "mean", False, False),
]
DIRECT = DirectConfig(end_of_selling_since=ENDED_SINCE)


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six digits, with one zero, so that results compare by value across engines."""
    return frame.select(
        *[
            (F.round(F.col(f.name) + F.lit(float(TIE_SHIFT)), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


def _daily(spark, sf, grain: str = "brand") -> DataFrame:
    """Strict daily sales as a table: most queries read it several times, the transactions only once."""
    return written_table(tx.strict_daily(spark, sf, grain))


def _gold(spark, sf, grain: str = "brand") -> DataFrame:
    return written_table(tx.gold(spark, sf, grain))


# -- cleaning and daily tables ------------------------------------------------------------------------


def clean_transactions(spark, sf):
    silver = tx.silver_from_text(spark, sf)
    return silver.drop("batch_id", "transformed_at")


def bronze_transactions(spark, sf):
    from shelfcast.operators.cleaning import to_bronze

    return to_bronze(tx.raw(spark, sf)).drop("ingested_at", "transformed_at")


def vn_decimal_roundtrip(spark, sf):
    text = tx.as_text(tx.typed(spark, sf), faults=True)
    amount = F.col("SalesAmount")
    return text.select(
        F.col("Stt").cast("bigint").alias("stt"),
        amount.alias("amount_text"),
        vn_decimal(amount).alias("amount"),
        vn_decimal(F.col("UnitPrice")).alias("unit_price"),
    )


def silver_errors_by_reason(spark, sf):
    errors = explode_errors(tx.silver_from_text(spark, sf))
    return errors.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_return"), F.lit(1))).alias("return_rows")
    )


def gold_daily(spark, sf):
    return tx.gold(spark, sf)


def gold_of_valid_rows(spark, sf):
    return gold_daily_sales(tx.silver_from_text(spark, sf))


def strict_transactions(spark, sf):
    return type_transactions(tx.as_text(tx.typed(spark, sf), faults=False), amounts="vn")


def strict_daily(spark, sf):
    return tx.strict_daily(spark, sf)


def gold_quality_report(spark, sf):
    silver = written_table(tx.silver_from_text(spark, sf).drop("transformed_at"))
    return quality.gold_quality(silver, gold_daily_sales(silver))


def csv_ingest(spark, sf):
    """Writes the text transactions as CSV, reads them back with row numbers, stores and reads the batch."""
    folder = work_folder(spark)
    text = tx.as_text(tx.typed(spark, sf), faults=True)
    kept = dict(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    text.write.options(**kept).csv(f"{folder}/incoming")
    store = TableStore(spark, folder)
    store.replace_slice("raw", read_raw(spark, f"{folder}/incoming", "batch-1"), "batch-1")
    rows = store.batch("raw", "batch-1")
    # Distinct numbers are counted in bitmaps of a stretch of numbers each, so rows are counted where they lie.
    number = F.col("source_row_number")
    stretches = rows.groupBy("source_file", F.bitmap_bucket_number(number).alias("_stretch")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(number))).alias("_numbers"),
        F.min(number).alias("_first"),
        F.max(number).alias("_last"),
    )
    per_file = stretches.groupBy("source_file").agg(
        F.sum("_rows").alias("_rows"), F.sum("_numbers").alias("_numbers"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    contiguous = (F.col("_rows") == F.col("_numbers")) & (F.col("_first") == 1) & (F.col("_last") == F.col("_rows"))
    # Written, so that Spark knows how few files there are and does not shuffle all rows by file.
    per_file = written_table(per_file.select("source_file", contiguous.alias("row_numbers_contiguous")))
    return rows.join(per_file, "source_file").select(*RAW_FIELD_NAMES, "row_numbers_contiguous")


def typed_csv_load(spark, sf):
    """Writes the text transactions as CSV and loads them with the typed reader."""
    folder = f"{work_folder(spark)}/incoming"
    tx.as_text(tx.typed(spark, sf), faults=False).write.option("header", True).csv(folder)
    loaded = read_transactions(spark, folder)
    cleaned = loaded.withColumn("item_code", F.upper(F.trim("item_code")))
    return rounded(strict_daily_sales(cleaned))


# -- profile and selection ----------------------------------------------------------------------------


def sku_profile_asof(spark, sf):
    return rounded(item_profile(_daily(spark, sf), TRAIN_END))


def sku_profile_asof_part(spark, sf):
    return rounded(item_profile(_daily(spark, sf, "part"), TRAIN_END))


def _selected(strategy: str) -> Query:
    def query(spark, sf):
        profile = item_profile(_daily(spark, sf, "part"), TRAIN_END)
        chosen = selection.select_items(profile, strategy, TOP, min_active_days=15, max_days_since_last_sale=180)
        return rounded(chosen.select("item_code", "total_profit", "active_days", "days_since_last_sale"))

    return query


def top_volume_skus(spark, sf):
    return selection.top_volume_items(_gold(spark, sf, "part"), TOP)


def active_skus(spark, sf):
    return selection.active_items(_gold(spark, sf, "part"), 56)


def gold_window(spark, sf):
    return rounded(selection.gold_window(_gold(spark, sf), TRAIN_END, 200))


# -- panels and features ------------------------------------------------------------------------------


def _panel(spark, sf) -> DataFrame:
    gold = _gold(spark, sf)
    return panel.training_panel(gold, selection.top_volume_items(gold, TOP), TOP)


def dense_panel_top20(spark, sf):
    return rounded(_panel(spark, sf))


def demand_matrix(spark, sf):
    return panel.demand_panel(_daily(spark, sf))


def _features(*columns: str) -> Query:
    def query(spark, sf):
        return rounded(history.history_features(_panel(spark, sf)).select("item_code", "date", *columns))

    return query


def _training_frame(spark, sf) -> DataFrame:
    return frames.training_frame(_gold(spark, sf), "v1", TOP, 60, 56)


def training_frame(spark, sf):
    return rounded(_training_frame(spark, sf))


def feature_quality_report(spark, sf):
    return quality.feature_quality(_training_frame(spark, sf))


def inference_frame(spark, sf):
    """All parts active in the last 200 days, features from sparse rows."""
    gold = _gold(spark, sf, "part")
    items = selection.active_items(gold, 200)
    window = selection.gold_window(gold, TRAIN_END, 200)
    return rounded(frames.inference_frame(window, items, TRAIN_END, 56))


def inference_frame_brand(spark, sf):
    gold = _gold(spark, sf)
    items = selection.active_items(gold, 730)
    return rounded(frames.inference_frame(selection.gold_window(gold, TRAIN_END, 730), items, TRAIN_END, 56))


def time_split_counts(spark, sf):
    return daily_model.training_split_sizes(written_table(_training_frame(spark, sf)), 28)


def training_skus(spark, sf):
    """Writes two feature versions, then lists the items of one."""
    store = TableStore(spark, work_folder(spark))
    gold = _gold(spark, sf)
    for version, size in (("v1", TOP), ("v2", 5)):
        store.replace_slice("features", frames.training_frame(gold, version, size, 60, 56), version)
    return selection.training_items(store.read("features"), "v2")


def _stored_gold(spark, sf) -> TableStore:
    """Gold replaced twice, first by a batch that ends early."""
    store, gold = TableStore(spark, work_folder(spark)), _gold(spark, sf)
    store.replace_all("gold", gold.filter(F.col("date") <= EARLIER_END))
    store.replace_all("gold", gold)
    return store


def replaced_gold(spark, sf):
    return rounded(_stored_gold(spark, sf).gold())


def gold_for_features(spark, sf):
    return rounded(_stored_gold(spark, sf).gold_for_features())


def features_in_training_order(spark, sf):
    """Two stored versions; the keys of one of them with their place in the output order."""
    store, gold = _stored_gold(spark, sf), _gold(spark, sf)
    store.replace_slice("features", frames.training_frame(gold, "v0", 5), "v0")
    store.replace_slice("features", frames.training_frame(gold, "v1", TOP), "v1")
    # The sorted rows of a bounded frame (items x days x horizons) in one output partition, as a single file would be.
    ordered = in_training_order(store.features("v1")).coalesce(1)
    place = F.monotonically_increasing_id() + 1
    return ordered.select(place.alias("place"), "target_date", "item_code", "horizon", "as_of_date")


def model_matrix(spark, sf):
    """Model columns of the inference frame; items outside the training lists get the id -1."""
    gold = _gold(spark, sf)
    listed = [selection.top_volume_items(gold, n).select("item_code") for n in (TOP, 5)]
    ids = models.item_ids(listed[0].union(listed[1]))
    window = selection.gold_window(gold, TRAIN_END, 730)
    frame = frames.inference_frame(window, selection.active_items(gold, 730), TRAIN_END, 56)
    return rounded(models.model_matrix(frame, ids, TOP).select("item_code", "horizon", *MODEL_COLUMNS))


# -- baselines and scores -----------------------------------------------------------------------------


def _baseline(model: str) -> Query:
    def query(spark, sf):
        return rounded(baselines.baseline_forecast(_daily(spark, sf), TRAIN_END, model))

    return query


def rmsse_denominator(spark, sf):
    return rounded(scoring.rmsse_denominators(_daily(spark, sf, "part"), TRAIN_END))


def _scores(spark, sf) -> DataFrame:
    daily = _daily(spark, sf)
    forecast = baselines.baseline_forecast(daily, TRAIN_END, "mean_28")
    return scoring.wrmsse_by_item(daily, forecast, item_profile(daily, TRAIN_END), TRAIN_END)


def wrmsse_by_sku(spark, sf):
    return rounded(_scores(spark, sf))


def wrmsse_total(spark, sf):
    return rounded(scoring.wrmsse(_scores(spark, sf)))


def baseline_cv(spark, sf):
    return rounded(scoring.backtest_baselines(_daily(spark, sf), LAST_DATE))


def baseline_cv_part(spark, sf):
    return rounded(scoring.backtest_baselines(_daily(spark, sf, "part"), LAST_DATE))


def baseline_cv_summary(spark, sf):
    return rounded(scoring.summarize_backtest(scoring.backtest_baselines(_daily(spark, sf), LAST_DATE)))


def _validation(spark, sf) -> DataFrame:
    _, validation = frames.time_split(written_table(_training_frame(spark, sf)), 28)
    return baselines.frame_baselines(validation)


def feature_baseline_metrics(spark, sf):
    return rounded(scoring.metrics_table(_validation(spark, sf), list(baselines.FRAME_BASELINES)))


def metrics_by_horizon(spark, sf):
    return rounded(scoring.metrics_table(_validation(spark, sf), list(baselines.FRAME_BASELINES), ["horizon"]))


def metrics_by_speed_group(spark, sf):
    grouped = scoring.with_speed_group(_validation(spark, sf))
    return rounded(scoring.metrics_table(grouped, list(baselines.FRAME_BASELINES), ["sku_group"]))


def late_actuals_metrics(spark, sf):
    """D4. Each model is a run. Actuals come in three deliveries: corrections first, then what they correct, then the rest."""
    rows = written_table(_validation(spark, sf))
    forecasts = rows.select(
        F.concat_ws("/", "as_of_date", "item_code").alias("key"), "horizon", "target_date", *baselines.FRAME_BASELINES
    ).unpivot(["key", "horizon", "target_date"], list(baselines.FRAME_BASELINES), "run_id", "yhat")
    # Several anchors forecast one day: each anchor's item is an item of its own, so that every row has its actual.
    forecasts = forecasts.withColumnsRenamed({"key": "item_code", "target_date": "date"})
    actuals = rows.select(
        F.concat_ws("/", "as_of_date", "item_code").alias("item_code"), F.col("target_date").alias("date"), F.col("target_quantity").alias("quantity")
    ).distinct()
    kind = F.pmod(F.xxhash64("item_code", "date"), F.lit(3))
    corrected, late = actuals.filter(kind == 0), actuals.filter(kind > 0)
    wrong = corrected.withColumn("quantity", F.col("quantity") * 2 + 1)
    log = monitoring.ActualsLog(spark, f"{work_folder(spark)}/actuals")
    log.record("corrections", corrected.withColumn("revision", F.lit(2)), forecasts)
    log.record("first values", wrong.unionByName(late.filter(kind == 1).withColumn("quantity", F.lit(7.0))).withColumn("revision", F.lit(1)), forecasts)
    log.record("rest", late.withColumn("revision", F.lit(2)), forecasts)
    metrics = monitoring.state_metrics(log.state(), "run_id", "horizon").withColumnRenamed("run_id", "model")
    return rounded(metrics.drop("n"))


def registration_rule(spark, sf):
    """The moving average takes the model's place."""
    report = scoring.evaluation_report(_validation(spark, sf), list(baselines.FRAME_BASELINES))
    return rounded(
        scoring.passes_registration_rule(
            report, "moving_average_28", ["naive_last_value", "seasonal_naive_lag_7"]
        )
    )


# -- post-processing and wide form --------------------------------------------------------------------


def sunday_zero(spark, sf):
    forecast = baselines.baseline_forecast(_daily(spark, sf), TRAIN_END, "mean_28")
    return rounded(postprocess.zero_sundays(forecast))


def end_of_selling_zero(spark, sf):
    daily = _daily(spark, sf, "part")
    forecast = baselines.baseline_forecast(daily, "2000-12-31", "mean_56")
    ruled = postprocess.zero_ended_items(forecast, daily, ENDED_SINCE, TRAIN_END)
    return rounded(
        ruled.groupBy("item_code").agg(F.sum("yhat").alias("total"), F.count(F.lit(1)).alias("days"))
    )


def weekday_reference(spark, sf):
    daily = _daily(spark, sf)
    return rounded(postprocess.weekday_reference(daily, RULES, TRAIN_END, month_since="1998-01-01"))


def key_sku_adjust(spark, sf):
    daily = _daily(spark, sf)
    forecast = postprocess.apply_rules(
        baselines.baseline_forecast(daily, TRAIN_END, "mean_56"), daily, TRAIN_END, True, ENDED_SINCE
    )
    reference = postprocess.weekday_reference(daily, RULES, TRAIN_END, month_since="1998-01-01")
    return rounded(postprocess.adjust_key_items(forecast, reference, max_rows=56 * len(RULES)))


def _weekday_forecast(daily: DataFrame) -> DataFrame:
    return baselines.baseline_forecast(daily, TRAIN_END, "same_weekday_8w")


def forecast_wide(spark, sf):
    return rounded(wide.to_wide(_weekday_forecast(_daily(spark, sf))))


def forecast_long(spark, sf):
    return rounded(wide.to_long(wide.to_wide(_weekday_forecast(_daily(spark, sf))), TRAIN_END))


def wide_file_check(spark, sf):
    """Exports the wide forecast as CSV, reads it back and counts what must be zero."""
    folder = work_folder(spark)
    store = TableStore(spark, folder)
    store.save_csv("wide", wide.in_file_order(wide.to_wide(_weekday_forecast(_daily(spark, sf)))))
    path = store.path("exports/wide")
    covered = wide.cover_ids(read_ids(spark, path), read_wide_forecast(spark, path))
    wide.require_valid_wide(covered)
    return wide.check_wide(covered)


def blend_of_models(spark, sf):
    rows = baselines.baseline_forecasts(_daily(spark, sf), TRAIN_END)
    long = rows.unpivot(["item_code", "target_date"], ["mean_28", "median_56", "zero"], "model", "yhat")
    return rounded(baselines.blend_forecasts(long, {"mean_28": 3.0, "median_56": 1.0}))


# -- hybrid forecasts, gates, serving -----------------------------------------------------------------


def _hybrid(gold: DataFrame, forecast_date: str, lookback: int = 730, modelled: int = 10) -> DataFrame:
    """Hybrid scoring with the 28-day mean in the model's place for the items sold most."""
    known = selection.top_volume_items(gold, modelled)
    items = selection.active_items(gold, lookback)
    window = selection.gold_window(gold, forecast_date, lookback)
    stand_in = SQLTransformer(statement="SELECT *, rolling_mean_28 AS _raw_prediction FROM __THIS__")
    return daily_model.forecast_rows(window, items, stand_in, models.item_ids(known), forecast_date)


def hybrid_forecast(spark, sf):
    return rounded(_hybrid(_gold(spark, sf), TRAIN_END))


def hybrid_forecast_part(spark, sf):
    """56 days for every part sold in the last 200 days, 100 of them modelled."""
    return rounded(_hybrid(_gold(spark, sf, "part"), TRAIN_END, 200, 100))


def batch_forecast_run(spark, sf):
    """The whole batch job with a stand-in model: stored gold and features, gates, published run."""
    store, runs = _stored_gold(spark, sf), RunStore(spark, work_folder(spark))
    daily_model.build_features(store, "v1", 10)
    stand_in = SQLTransformer(statement="SELECT *, rolling_mean_28 AS _raw_prediction FROM __THIS__")
    daily_model.run_batch_forecast(store, runs, stand_in, "stand_in", "1", "v1", TRAIN_END, "run-1")
    return rounded(runs.forecasts().select("run_id", *FORECAST_COLUMNS))


def loaded_wide_forecast(spark, sf):
    """An approved wide file, one of its items replaced, loaded as a run."""
    store, runs, daily = TableStore(spark, work_folder(spark)), RunStore(spark, work_folder(spark)), _daily(spark, sf)
    store.save_csv("wide", wide.to_wide(_weekday_forecast(daily)))
    file = written_table(read_wide_forecast(spark, store.path("exports/wide")))
    other = baselines.baseline_forecast(daily, TRAIN_END, "mean_28").filter("item_code = 'BRAND-7'")
    daily_model.load_wide_forecast(runs, written_table(wide.replace_items(file, other)), TRAIN_END, "run-1", "approved", "1")
    return rounded(runs.forecasts().select("run_id", "forecast_date", "item_code", "target_date", "horizon", "predicted_quantity"))


def chosen_model_version(spark, sf):
    """Parts stand for versions of their brand's model."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    stage = F.element_at(F.array(F.lit("None"), F.lit("Staging"), F.lit("Production")), (F.col("p_size") % 3 + 1).cast("int"))
    versions = parts.select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"), stage.alias("stage"))
    return serving.choose_model_version(versions, "Brand#7")


def source_counts(spark, sf):
    return models.source_counts(_hybrid(_gold(spark, sf), TRAIN_END))


def forecast_quality_report(spark, sf):
    gold = _gold(spark, sf)
    forecast = written_table(_hybrid(gold, TRAIN_END))
    return quality.forecast_quality(forecast, selection.active_items(gold, 730))


def _runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Three runs: two successful, of which the later counts, and a failed one with the newest times."""

    daily = _daily(spark, sf)

    def forecast(day: str) -> DataFrame:
        rows = baselines.baseline_forecast(daily, day, "same_weekday_8w")
        return rows.select(
            F.concat(F.lit("run-"), F.lit(day)).alias("run_id"),
            F.lit(dt.date.fromisoformat(day)).alias("forecast_date"),
            "item_code",
            "target_date",
            "horizon",
            F.col("yhat").alias("predicted_quantity"),
        )

    forecasts = forecast(EARLIER_END).unionByName(forecast(TRAIN_END))
    done = forecasts.groupBy("run_id", "forecast_date").agg(F.count(F.lit(1)).alias("row_count"))
    begun = F.col("forecast_date").cast("timestamp")
    successful = done.select(
        "run_id",
        "forecast_date",
        F.lit("same_weekday").alias("model_name"),
        F.lit("1").alias("model_version"),
        F.lit("success").alias("status"),
        "row_count",
        begun.alias("started_at"),
        (begun + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"),
    )
    failed = successful.filter(F.col("forecast_date") == dt.date.fromisoformat(TRAIN_END)).withColumns(
        {
            "run_id": F.lit("run-failed"),
            "status": F.lit("failed"),
            "row_count": F.lit(None).cast("bigint"),
            "finished_at": F.col("finished_at") + F.expr("INTERVAL 1 DAY"),
            "error_message": F.lit("stopped"),
        }
    )
    return successful.unionByName(failed), forecasts


def latest_run(spark, sf):
    runs, _ = _runs(spark, sf)
    return serving.latest_run(runs).select("run_id", "forecast_date", "model_name", "status", "row_count")


def sku_forecast(spark, sf):
    return rounded(serving.item_forecast(*_runs(spark, sf), "BRAND-7", 28))


def top_skus(spark, sf):
    return rounded(serving.top_items(*_runs(spark, sf), "2001-09-03", 10, 5))


def day_summary(spark, sf):
    return rounded(serving.day_summary(*_runs(spark, sf), "2001-09-03"))


def published_forecast(spark, sf):
    """Publishes two runs, one of them twice, and a failed one; then reads the newest run back."""
    store = RunStore(spark, work_folder(spark))
    daily = _daily(spark, sf)
    for run, day in (("run-a", EARLIER_END), ("run-b", TRAIN_END), ("run-b", TRAIN_END)):
        rows = baselines.baseline_forecast(daily, day, "mean_28").select(
            F.lit(dt.date.fromisoformat(day)).alias("forecast_date"),
            "item_code",
            "target_date",
            "horizon",
            F.col("yhat").alias("predicted_quantity"),
        )
        store.publish(run, day, "mean_28", "1", rows)
    store.record_failure("run-c", TRAIN_END, "mean_28", "1", "stopped")
    newest = serving.latest_run(store.runs()).select("run_id").scalar()
    return rounded(
        store.forecasts()
        .filter(F.col("run_id") == newest)
        .select("run_id", "item_code", "target_date", "horizon", "predicted_quantity")
    )


# -- direct models ------------------------------------------------------------------------------------


def _chosen(daily: DataFrame) -> DataFrame:
    return direct_models.choose(item_profile(daily, TRAIN_END), DIRECT)


def origin_features(spark, sf):
    daily = _daily(spark, sf)
    rows = direct.direct_dataset(daily, _chosen(daily), TRAIN_END, DIRECT).filter(F.col("horizon") == 1)
    columns = [c for c in rows.columns if c.startswith(("lag_", "mean_", "max_", "active_")) and c != "active_days"]
    return rounded(
        rows.select("item_code", "origin_date", *columns, "days_since_last_sale", "origin_dow", "origin_month")
    )


def direct_dataset(spark, sf):
    daily = _daily(spark, sf)
    return rounded(direct.direct_dataset(daily, _chosen(daily), TRAIN_END, DIRECT))


def direct_rows_of_active(spark, sf):
    """Rows per part and origin; parts without a sale before an origin are dropped there."""
    daily = _daily(spark, sf, "part")
    cfg = replace(DIRECT, filter_inactive=True)
    rows = direct.direct_dataset(daily, direct_models.choose(item_profile(daily, TRAIN_END), cfg), TRAIN_END, cfg)
    return rounded(rows.groupBy("item_code", "origin_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("target")))


def direct_newest_rows(spark, sf):
    """The eight newest origins' worth of validation rows, counted per origin."""
    daily = _daily(spark, sf)
    rows = direct.direct_dataset(daily, _chosen(daily), TRAIN_END, DIRECT, origins_end_offset=56)
    return direct.newest_rows(rows, DIRECT).groupBy("origin_date").agg(F.count(F.lit(1)).alias("rows"))


def direct_forecast_features(spark, sf):
    daily = _daily(spark, sf)
    rows = direct.forecast_features(daily, _chosen(daily), TRAIN_END, DIRECT)
    return rounded(rows)


def sample_weights(spark, sf):
    daily = _daily(spark, sf)
    return rounded(direct.sample_weights(daily, _chosen(daily), TRAIN_END))


def alpha_grid(spark, sf):
    daily = _daily(spark, sf)
    profile = item_profile(daily, TRAIN_END)
    base = baselines.baseline_forecast(daily, TRAIN_END, "median_56")
    model = selection.keep_items(_weekday_forecast(daily), direct_models.choose(profile, DIRECT), DIRECT.top_n)
    return rounded(blend.blend_grid(daily, base, model, profile, TRAIN_END))


def chosen_alpha(spark, sf):
    grid = written_table(alpha_grid(spark, sf))
    alone = grid.filter("alpha = 0").first()["wrmsse_56"]
    return spark.createDataFrame([(blend.best_alpha(grid, alone),)], "best_alpha double")


def blended_forecast(spark, sf):
    daily = _daily(spark, sf)
    base = baselines.baseline_forecast(daily, TRAIN_END, "median_56")
    model = selection.keep_items(_weekday_forecast(daily), _chosen(daily), DIRECT.top_n)
    return rounded(blend.blend_with_model(base, model, 0.6))


def poisson_root_split(spark, sf):
    """The first split of the quantity model: all rows with a sale, all features, all bin borders."""
    daily = _daily(spark, sf)
    rows = written_table(direct.direct_dataset(daily, _chosen(daily), TRAIN_END, DIRECT).filter("target > 0"))
    trees = models.direct_trees("poisson", DIRECT, 50, DIRECT.seed)
    return rounded(boosting.root_split(rows, DIRECT_COLUMNS, "target", trees, "sample_weight"))


# -- fitted models: rows only -------------------------------------------------------------------------


def l1_gbt_forecast(spark, sf):
    gold = _gold(spark, sf)
    frame = written_table(frames.training_frame(gold, "v1"))
    train, validation = frames.time_split(frame, 28)
    ids = models.item_ids(frame)
    model = models.fit_daily_model(models.model_matrix(train, ids), models.model_matrix(validation, ids))
    items = selection.active_items(gold, 730)
    window = selection.gold_window(gold, TRAIN_END, 730)
    return daily_model.forecast_rows(window, items, model, ids, TRAIN_END)


def two_stage_forecast(spark, sf):
    daily = _daily(spark, sf)
    return direct_models.forecast_future(daily, TRAIN_END, DIRECT, [0.6])[0.6]


def tweedie_forecast(spark, sf):
    daily = _daily(spark, sf)
    profile = item_profile(daily, TRAIN_END)
    items = written_table(direct_models.choose(profile, DIRECT))
    model = direct_models.fit_for(daily, items, profile, TRAIN_END, TRAIN_END, DIRECT, "tweedie")
    rows = model.predict(direct.forecast_features(daily, items, TRAIN_END, DIRECT))
    return rows.select("item_code", "target_date", "horizon", "yhat")


def two_stage_evaluation(spark, sf):
    daily = _daily(spark, sf)
    return direct_models.evaluate(daily, TRAIN_END, DIRECT).scores


def recursive_forecast(spark, sf):
    daily = _daily(spark, sf)
    profile = item_profile(daily, TRAIN_END)
    items = written_table(direct_models.choose(profile, DIRECT))
    model = direct_models.fit_for(daily, items, profile, TRAIN_END, TRAIN_END, DIRECT, "two_stage")
    return recursive.recursive_forecast(daily, items, model, TRAIN_END, DIRECT, 0.6)


def recursive_median(spark, sf):
    """The recursion with alpha 0: every item follows its own 56-day median."""
    daily = _daily(spark, sf)
    nobody = item_profile(daily, TRAIN_END).limit(0)
    return rounded(recursive.recursive_forecast(daily, nobody, None, TRAIN_END, DIRECT, 0.0))


def mean_forecast_of_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: cleaned text transactions to profile, selection and a Sunday-free 56-day mean forecast."""
    silver = tx.silver_from_text(spark, sf, faults=False).filter("is_valid")
    daily = written_table(strict_daily_sales(
        silver.select(
            "date",
            "item_code",
            "quantity",
            "sales_amount",
            "cost_amount",
            F.col("sales_quantity").alias("sales_qty"),
            F.col("return_quantity").alias("return_qty"),
            F.col("quantity").alias("net_qty"),
            (F.col("sales_amount") - F.col("cost_amount")).alias("profit"),
        )
    ))
    chosen = selection.select_items(item_profile(daily, TRAIN_END), "active_recent_top_profit", TOP)
    forecast = baselines.baseline_forecast(daily, TRAIN_END, "mean_56")
    return rounded(postprocess.zero_sundays(selection.keep_items(forecast, chosen, TOP)))


ROLLING = [c for c in HISTORY_COLUMNS if c.startswith("rolling_") and "price" not in c]
EXPANDING = ["sku_avg_sales", "sku_sales_std", "sku_total_sales", "sku_nonzero_sales_ratio", "sku_return_rate"]
PRICES = [
    "avg_unit_price",
    "lag_price_1",
    "rolling_price_mean_7",
    "rolling_price_mean_28",
    "price_change_rate",
    "discount_proxy",
]
LAGS = [c for c in HISTORY_COLUMNS if c.startswith("lag_") and c != "lag_price_1"]

QUERIES: dict[str, Query] = {
    "mean_forecast_of_selected": mean_forecast_of_selected,
    "bronze_transactions": bronze_transactions,
    "clean_transactions": clean_transactions,
    "vn_decimal_roundtrip": vn_decimal_roundtrip,
    "silver_errors_by_reason": silver_errors_by_reason,
    "csv_ingest": csv_ingest,
    "typed_csv_load": typed_csv_load,
    "gold_daily_sales": lambda spark, sf: rounded(gold_daily(spark, sf)),
    "gold_of_valid_rows": lambda spark, sf: rounded(gold_of_valid_rows(spark, sf)),
    "strict_transactions": lambda spark, sf: rounded(strict_transactions(spark, sf)),
    "strict_daily_sales": lambda spark, sf: rounded(strict_daily(spark, sf)),
    "gold_quality_report": gold_quality_report,
    "sku_profile_asof": sku_profile_asof,
    "sku_profile_asof_part": sku_profile_asof_part,
    "select_top_profit": _selected("top_profit"),
    "select_active": _selected("active_top_profit"),
    "select_recent": _selected("recent_top_profit"),
    "select_active_recent": _selected("active_recent_top_profit"),
    "top_volume_skus": top_volume_skus,
    "active_skus": active_skus,
    "gold_window": gold_window,
    "training_skus": training_skus,
    "dense_panel_top20": dense_panel_top20,
    "demand_matrix": demand_matrix,
    "lag_features": _features(*LAGS),
    "rolling_features": _features(*ROLLING),
    "expanding_features": _features(*EXPANDING),
    "expanding_median": _features("sku_median_sales"),
    "lifecycle_features": _features("sku_first_sale_date", "sku_lifecycle_days"),
    "price_features": _features(*PRICES),
    "training_frame": training_frame,
    "feature_quality_report": feature_quality_report,
    "inference_frame": inference_frame,
    "inference_frame_brand": inference_frame_brand,
    "time_split_counts": time_split_counts,
    "baseline_zero": _baseline("zero"),
    "baseline_mean28": _baseline("mean_28"),
    "baseline_median56": _baseline("median_56"),
    "baseline_weekday8": _baseline("same_weekday_8w"),
    "baseline_sparse": _baseline("conservative_sparse"),
    "baseline_blend": _baseline("blend_mean_weekday"),
    "blend_of_models": blend_of_models,
    "rmsse_denominator": rmsse_denominator,
    "wrmsse_by_sku": wrmsse_by_sku,
    "wrmsse_total": wrmsse_total,
    "baseline_cv": baseline_cv,
    "baseline_cv_part": baseline_cv_part,
    "baseline_cv_summary": baseline_cv_summary,
    "feature_baseline_metrics": feature_baseline_metrics,
    "metrics_by_horizon": metrics_by_horizon,
    "metrics_by_speed_group": metrics_by_speed_group,
    "late_actuals_metrics": late_actuals_metrics,
    "registration_rule": registration_rule,
    "sunday_zero": sunday_zero,
    "end_of_selling_zero": end_of_selling_zero,
    "weekday_reference": weekday_reference,
    "key_sku_adjust": key_sku_adjust,
    "forecast_wide": forecast_wide,
    "forecast_long": forecast_long,
    "wide_file_check": wide_file_check,
    "hybrid_forecast": hybrid_forecast,
    "hybrid_forecast_part": hybrid_forecast_part,
    "source_counts": source_counts,
    "forecast_quality_report": forecast_quality_report,
    "latest_run": latest_run,
    "sku_forecast": sku_forecast,
    "top_skus": top_skus,
    "day_summary": day_summary,
    "published_forecast": published_forecast,
    "origin_features": origin_features,
    "direct_dataset": direct_dataset,
    "direct_newest_rows": direct_newest_rows,
    "direct_forecast_features": direct_forecast_features,
    "sample_weights": sample_weights,
    "poisson_root_split": poisson_root_split,
    "chosen_alpha": chosen_alpha,
    "direct_rows_of_active": direct_rows_of_active,
    "replaced_gold": replaced_gold,
    "gold_for_features": gold_for_features,
    "features_in_training_order": features_in_training_order,
    "model_matrix": model_matrix,
    "batch_forecast_run": batch_forecast_run,
    "loaded_wide_forecast": loaded_wide_forecast,
    "chosen_model_version": chosen_model_version,
    "alpha_grid": alpha_grid,
    "blended_forecast": blended_forecast,
    "recursive_median": recursive_median,
    "l1_gbt_forecast": l1_gbt_forecast,
    "two_stage_forecast": two_stage_forecast,
    "tweedie_forecast": tweedie_forecast,
    "two_stage_evaluation": two_stage_evaluation,
    "recursive_forecast": recursive_forecast,
}
