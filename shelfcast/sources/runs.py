"""Publishing forecast runs on Parquet (K4, K5, K6).

Parquet has no transactions. Rows of a run go to their own ``run_id=/attempt=`` folder, and a run's state is
the latest event of an append-only log. The success event names the attempt, so readers never see a
half-written or superseded attempt; a re-run replaces the visible rows of its run and no other run.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import to_day
from shelfcast.operators.serving import RUN_COLUMNS, current_runs

MAX_ERROR_CHARS = 2000

_EVENT_SCHEMA = (
    "run_id string, attempt string, event_number int, event_time timestamp, forecast_date date, "
    "model_name string, model_version string, status string, row_count bigint, started_at timestamp, "
    "finished_at timestamp, error_message string"
)
_ROW_SCHEMA = (
    "forecast_date date, item_code string, target_date date, horizon int, predicted_quantity double, "
    "prediction_source string, model_name string, model_version string, created_at timestamp, "
    "run_id string, attempt string"
)
FORECAST_COLUMNS = [
    "forecast_date",
    "item_code",
    "target_date",
    "horizon",
    "predicted_quantity",
    "prediction_source",
]


class RunStore:
    """Run events and forecast rows under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.events_path = f"{root.rstrip('/')}/run_events"
        self.rows_path = f"{root.rstrip('/')}/forecasts"

    def _append(self, **event) -> None:
        row = self.spark.createDataFrame([event], _EVENT_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.events_path)

    def runs(self) -> DataFrame:
        """Current state of every run, one row each."""
        events = self.spark.read.schema(_EVENT_SCHEMA).parquet(self.events_path)
        return current_runs(events).select(*RUN_COLUMNS, "attempt")

    def forecasts(self) -> DataFrame:
        """Rows of the successful attempt of every run.

        There are far fewer runs than rows; the join key is the partition folder, so with a filter on
        ``run_id`` only that run is read.
        """
        rows = self._all_rows()
        visible = self.runs().filter(F.col("status") == "success").select("run_id", "attempt")
        return rows.join(visible, ["run_id", "attempt"], "left_semi")

    def publish(
        self,
        run_id: str,
        forecast_date: str | dt.date,
        model_name: str,
        model_version: str,
        forecast: DataFrame,
    ) -> int:
        """K4-K6. Write one attempt and log running, then success or failed; returns the rows written.

        Every failure is logged, also of a run that never succeeded. The message is cut at 2,000 characters.
        """
        attempt = uuid.uuid4().hex
        started = dt.datetime.now(dt.timezone.utc)
        header = dict(
            run_id=run_id,
            attempt=attempt,
            forecast_date=to_day(forecast_date),
            model_name=model_name,
            model_version=model_version,
            started_at=started,
        )
        self._append(
            **header, event_number=0, event_time=started, status="running", row_count=None, finished_at=None,
            error_message=None,
        )
        try:
            rows = self._write(run_id, attempt, model_name, model_version, forecast)
        except Exception as error:
            self._finish(header, "failed", None, repr(error)[:MAX_ERROR_CHARS])
            raise
        self._finish(header, "success", rows, None)
        return rows

    def record_failure(self, run_id: str, forecast_date, model_name: str, model_version: str, error: str) -> None:
        """K6. Log a run that failed before anything was written."""
        header = dict(
            run_id=run_id,
            attempt=uuid.uuid4().hex,
            forecast_date=to_day(forecast_date),
            model_name=model_name,
            model_version=model_version,
            started_at=dt.datetime.now(dt.timezone.utc),
        )
        self._finish(header, "failed", None, error[:MAX_ERROR_CHARS])

    def _finish(self, header: dict, status: str, rows: int | None, message: str | None) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self._append(
            **header, event_number=1, event_time=now, status=status, row_count=rows, finished_at=now,
            error_message=message,
        )

    def _write(self, run_id: str, attempt: str, model_name: str, model_version: str, forecast: DataFrame) -> int:
        if "prediction_source" not in forecast.columns:
            forecast = forecast.withColumn("prediction_source", F.lit("loaded"))
        rows = forecast.select(
            *FORECAST_COLUMNS,
            F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"),
            F.current_timestamp().alias("created_at"),
        )
        keys = {"run_id": F.lit(run_id), "attempt": F.lit(attempt)}
        # Sorted by item inside each file so that a one-item lookup skips row groups.
        ordered = rows.withColumns(keys).sortWithinPartitions(*keys, "item_code", "horizon")
        ordered.write.mode("append").partitionBy(*keys).parquet(self.rows_path)
        written = (F.col("run_id") == run_id) & (F.col("attempt") == attempt)
        return self._all_rows().filter(written).count()

    def _all_rows(self) -> DataFrame:
        return self.spark.read.schema(_ROW_SCHEMA).parquet(self.rows_path)
