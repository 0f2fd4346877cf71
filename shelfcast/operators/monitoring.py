"""Metrics of published forecasts as actuals arrive, late and corrected.

Per run, horizon and day the state holds a count and error sums; states of different deliveries add up. A delivery
changes the state by the difference between the errors of its new actuals and those of the actuals they replace, so
work and input follow the size of the delivery: forecasts and earlier actuals are read for its days only.

An actual is (item_code, date, quantity, revision). Of several for one item and day the highest revision counts, whatever
the order of arrival; between equal revisions, the larger quantity. Null items, days or quantities are ignored, a null
revision is the lowest. Forecasts without an actual and actuals without a forecast count nowhere.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.scoring import EPSILON

CELL = ["run_id", "horizon", "date"]
SUMS = ["n", "abs_error", "squared_error", "abs_actual", "smape_sum"]
_ACTUAL = "item_code string, date date, quantity double, revision long"
_STATE = "run_id string, horizon int, date date, n long, abs_error double, squared_error double, abs_actual double, smape_sum double"
_DELIVERY = "number long, delivery string, folder string"


def newest_actuals(actuals: DataFrame) -> DataFrame:
    """One row per item and day: the highest revision. Aggregates on the map side, so copies of one key are no hot group."""
    known = actuals.select(
        F.col("item_code").cast("string"), F.col("date").cast("date"), F.col("quantity").cast("double"),
        F.coalesce(F.col("revision").cast("long"), F.lit(-(1 << 63))).alias("revision"),
    ).filter("item_code is not null and date is not null and quantity is not null")
    best = known.groupBy("item_code", "date").agg(F.max(F.struct("revision", "quantity")).alias("best"))
    return best.select("item_code", "date", "best.quantity", "best.revision")


def _terms(actual: Column, predicted: Column) -> dict[str, Column]:
    error, scale = F.abs(actual - predicted), F.abs(actual) + F.abs(predicted)
    terms = {
        "n": F.lit(1).cast("long"),
        "abs_error": error,
        "squared_error": error * error,
        "abs_actual": F.abs(actual),
        "smape_sum": F.when(scale > 0, F.try_divide(2.0 * error, scale)).otherwise(0.0),
    }
    return {name: F.when(actual.isNull(), F.lit(0)).otherwise(term) for name, term in terms.items()}


def state_change(forecasts: DataFrame, earlier: DataFrame, delivery: DataFrame) -> DataFrame:
    """What ``delivery`` adds to the state, given all ``earlier`` actuals: (run_id, horizon, date, sums..)."""
    new = newest_actuals(delivery)
    days = new.select("date").distinct()
    old = newest_actuals(earlier.join(days, "date", "left_semi")).withColumnsRenamed({"quantity": "old", "revision": "old_revision"})
    both = new.join(old, ["item_code", "date"], "left")
    wins = F.col("old").isNull() | (F.struct("revision", "quantity") > F.struct(F.col("old_revision"), F.col("old")))
    changed = both.filter(wins).select("item_code", "date", "quantity", "old")
    rows = forecasts.filter("yhat is not null").select("run_id", "horizon", "date", "item_code", F.col("yhat").cast("double").alias("yhat"))
    rows = rows.join(changed, ["item_code", "date"])
    after, before = (_terms(F.col(c), F.col("yhat")) for c in ("quantity", "old"))
    return rows.groupBy(*CELL).agg(*[F.sum(after[c] - before[c]).alias(c) for c in SUMS])


def merged_states(states: DataFrame) -> DataFrame:
    """Sum of any number of states or changes; cells that no actual is left in go."""
    return states.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n > 0")


def state_metrics(state: DataFrame, *by: str) -> DataFrame:
    """A7 from the sums, by any of the cell's columns: (by.., n, mae, rmse, wape, smape)."""
    total = state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n > 0")
    # Differences of sums may leave a rounding error below zero.
    sums = {c: F.greatest(F.col(c), F.lit(0.0)) for c in SUMS}
    return total.select(
        *by,
        "n",
        (sums["abs_error"] / F.col("n")).alias("mae"),
        F.sqrt(sums["squared_error"] / F.col("n")).alias("rmse"),
        (sums["abs_error"] / F.greatest(sums["abs_actual"], F.lit(EPSILON))).alias("wape"),
        (sums["smape_sum"] / F.col("n")).alias("smape"),
    )


class ActualsLog:
    """Deliveries of actuals and the changes they make, under one folder; one writer at a time.

    A delivery is a new folder that becomes visible by its pointer row, written last. So a recording that fails can be
    repeated, and one that is repeated after it succeeded changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _deliveries(self) -> list:
        """One small row per delivery."""
        try:
            rows = self.spark.read.schema(_DELIVERY).parquet(f"{self.root}/_deliveries").collect()
        except AnalysisException:
            rows = []
        return sorted(rows, key=lambda r: r["number"])

    def _read(self, part: str, schema: str) -> DataFrame:
        folders = [f"{self.root}/{r['folder']}/{part}" for r in self._deliveries()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def actuals(self) -> DataFrame:
        """All recorded actuals, replaced ones included."""
        return self._read("actuals", _ACTUAL)

    def state(self) -> DataFrame:
        return merged_states(self._read("state", _STATE))

    def record(self, name: str, delivery: DataFrame, forecasts: DataFrame) -> bool:
        """Add a delivery to actuals and state; False if one of that name is recorded already."""
        done = self._deliveries()
        if any(r["delivery"] == name for r in done):
            return False
        folder = f"delivery-{uuid.uuid4().hex}"
        newest_actuals(delivery).write.parquet(f"{self.root}/{folder}/actuals")
        own = self.spark.read.schema(_ACTUAL).parquet(f"{self.root}/{folder}/actuals")
        change = state_change(forecasts, self.actuals(), own)
        change.select(F.col("run_id").cast("string"), F.col("horizon").cast("int"), "date", *SUMS).write.parquet(f"{self.root}/{folder}/state")
        pointer = self.spark.createDataFrame([(len(done), name, folder)], _DELIVERY).coalesce(1)
        pointer.write.mode("append").parquet(f"{self.root}/_deliveries")
        return True
