"""Features, training, evaluation and batch forecasts of the daily model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DEFAULT_LOOKBACK_DAYS, MAX_HORIZON
from shelfcast.operators.baselines import FRAME_BASELINES, frame_baselines
from shelfcast.operators.boosting import BoostedTrees
from shelfcast.operators.frames import inference_frame, require_rows, time_split, training_frame
from shelfcast.operators.models import (
    DailyModelSettings,
    fit_daily_model,
    item_ids,
    model_matrix,
    predict_daily,
    predict_with_fallback,
    source_counts,
)
from shelfcast.operators.quality import FEATURE_GATES, FORECAST_GATES, feature_quality, forecast_quality, require_clean
from shelfcast.operators.scoring import evaluation_report, passes_registration_rule
from shelfcast.operators.selection import active_items, gold_window, training_items
from shelfcast.session import written_table
from shelfcast.sources.runs import FORECAST_COLUMNS, RunStore
from shelfcast.sources.tables import TableStore


def build_features(
    store: TableStore, feature_version: str, max_items: int = 100, as_of_days: int = 60, max_horizon: int = MAX_HORIZON
) -> dict:
    """Build, check and save one feature version; returns the quality report."""
    frame = training_frame(store.gold_for_features(), feature_version, max_items, as_of_days, max_horizon).persist()
    try:
        require_rows(frame, "Not enough gold history for the requested training frame")
        report = require_clean(feature_quality(frame), FEATURE_GATES, "Feature")
        store.replace_slice("features", frame, feature_version)
    finally:
        frame.unpersist()
    return report


@dataclass(frozen=True)
class TrainingResult:
    model: BoostedTrees
    report: DataFrame
    passed: bool


def train_and_evaluate(
    store: TableStore,
    feature_version: str,
    validation_days: int = 28,
    settings: DailyModelSettings = DailyModelSettings(),
) -> TrainingResult:
    """Fit on the early target days, evaluate on the last ones, save the report, apply the registration rule."""
    frame = store.features(feature_version)
    train, validation = time_split(frame, validation_days)
    for part in (train, validation):
        require_rows(part, "Time split produced an empty train or validation set")
    ids = item_ids(frame)
    train_matrix, validation_matrix = model_matrix(train, ids), model_matrix(validation, ids)
    model = fit_daily_model(train_matrix, validation_matrix, settings)
    scored = frame_baselines(predict_daily(model, validation_matrix).withColumnRenamed("predicted", "gbt"))
    report = written_table(evaluation_report(scored, ["gbt", *FRAME_BASELINES]))
    store.save_report(f"evaluation_{feature_version}", report)
    passed = passes_registration_rule(report, "gbt", list(FRAME_BASELINES)).first()["passed"]
    return TrainingResult(model, report, bool(passed))


def forecast_rows(
    gold: DataFrame,
    items: DataFrame,
    model: BoostedTrees | Transformer,
    ids: DataFrame,
    forecast_date: str | dt.date,
    max_horizon: int = MAX_HORIZON,
) -> DataFrame:
    """Inference frame, hybrid scoring, output columns."""
    frame = inference_frame(gold, items, forecast_date, max_horizon)
    return predict_with_fallback(frame, model, ids).select(*FORECAST_COLUMNS)


def run_batch_forecast(
    store: TableStore,
    runs: RunStore,
    model: BoostedTrees | Transformer,
    model_name: str,
    model_version: str,
    feature_version: str,
    forecast_date: str | dt.date,
    run_id: str,
    max_horizon: int = MAX_HORIZON,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    item_lookback_days: int | None = None,
) -> dict:
    """M18. Forecast all active items, check, publish; every failure is recorded with the run."""
    window = item_lookback_days if item_lookback_days is not None else lookback_days
    try:
        known = training_items(store.read("features"), feature_version)
        items = require_rows(active_items(store.gold(), window), "No active items to forecast")
        gold = gold_window(store.gold(), forecast_date, lookback_days)
        require_rows(gold, "The gold window before the forecast date is empty")
        forecast = forecast_rows(gold, items, model, item_ids(known), forecast_date, max_horizon).persist()
        try:
            validation = require_clean(
                forecast_quality(forecast, items, max_horizon), FORECAST_GATES, "Forecast"
            )
            counts = {r["prediction_source"]: r["rows"] for r in source_counts(forecast).collect()}
        except Exception:
            forecast.unpersist()
            raise
    except Exception as error:
        runs.record_failure(run_id, forecast_date, model_name, model_version, repr(error))
        raise
    try:
        written = runs.publish(run_id, forecast_date, model_name, model_version, forecast)
    finally:
        forecast.unpersist()
    return {
        "run_id": run_id,
        "forecast_date": str(forecast_date),
        "feature_version": feature_version,
        "active_items": validation["expected_skus"],
        "rows_written": written,
        "validation": validation,
        "prediction_source_counts": counts,
    }


def load_wide_forecast(
    runs: RunStore, wide: DataFrame, forecast_date: str | dt.date, run_id: str, model_name: str, model_version: str
) -> int:
    """Q5. Check an approved wide forecast and publish it as a run; failures are recorded."""
    from shelfcast.operators.wide import require_valid_wide, to_long

    try:
        require_valid_wide(wide)
    except Exception as error:
        runs.record_failure(run_id, forecast_date, model_name, model_version, str(error))
        raise
    return runs.publish(run_id, forecast_date, model_name, model_version, to_long(wide, forecast_date))


def training_split_sizes(features: DataFrame, validation_days: int = 28) -> DataFrame:
    """Row counts and target day ranges of the two parts of the split."""
    train, validation = time_split(features, validation_days)

    def sizes(part: DataFrame, name: str) -> DataFrame:
        return part.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("rows"),
            F.min("target_date").alias("first_target_date"),
            F.max("target_date").alias("last_target_date"),
        )

    return sizes(train, "train").unionByName(sizes(validation, "validation"))
