"""Parquet tables of the layers and their replace-style sinks."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import delete_folder

# Partition column of each table; gold has none because it is replaced as a whole.
PARTITION_COLUMNS = {
    "raw": "batch_id",
    "bronze": "batch_id",
    "silver": "batch_id",
    "gold": None,
    "features": "feature_version",
}


_WHOLE = "all"  # slice of a table without a partition column
_VERSION = "_version"
_POINTER = "name string, slice string, version string, number long"


class TableStore:
    """Tables under one root folder; every write is a parallel Parquet write.

    A replacement is a new folder, and visible once its pointer row is written, last. So a write that fails half-way
    leaves the old rows; readers that began before a replacement still find theirs (the version before stays).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _pointers(self, table: str) -> dict[str, list[str]]:
        """Versions of each slice of ``table``, newest first: one row per replacement."""
        try:
            rows = self.spark.read.schema(_POINTER).parquet(self.path("_pointers")).filter(F.col("name") == table).collect()
        except AnalysisException:
            rows = []
        found: dict[str, list[str]] = {}
        for row in sorted(rows, key=lambda r: (-r["number"], r["version"])):
            found.setdefault(row["slice"], []).append(row["version"])
        return found

    def _folder(self, table: str, key: str, version: str) -> str:
        partition = PARTITION_COLUMNS[table]
        inner = f"/{partition}={key}" if partition else ""
        return f"{self.path(table)}{inner}/{_VERSION}={version}"

    def _read(self, table: str, slices: dict[str, list[str]]) -> DataFrame:
        if not slices:
            raise ValueError(f"Table '{table}' has no such rows yet")
        folders = [self._folder(table, key, versions[0]) for key, versions in slices.items()]
        return self.spark.read.option("basePath", self.path(table)).parquet(*folders).drop(_VERSION)

    def read(self, table: str) -> DataFrame:
        """The newest version of every slice."""
        return self._read(table, self._pointers(table))

    def exists(self, table: str) -> bool:
        return bool(self._pointers(table))

    def _replace(self, table: str, key: str, frame: DataFrame) -> None:
        versions = self._pointers(table).get(key, [])
        version = uuid.uuid4().hex
        frame.write.parquet(self._folder(table, key, version))
        pointer = self.spark.createDataFrame([(table, key, version, len(versions))], _POINTER).coalesce(1)
        pointer.write.mode("append").parquet(self.path("_pointers"))
        for old in versions[1:2]:
            delete_folder(self.spark, self._folder(table, key, old))

    def replace_slice(self, table: str, frame: DataFrame, key: str) -> None:
        """K1, K3. Replace one batch or feature version by ``frame``; an empty frame leaves it empty.

        A row of another slice makes the write fail.
        """
        partition = PARTITION_COLUMNS[table]
        if not re.fullmatch(r"[\w.-]+", key):
            raise ValueError(f"Not a slice name: {key!r}")
        foreign = F.raise_error(F.lit(f"a row of another {partition} than {key}")).cast("boolean")
        own = frame.filter(F.when(F.col(partition).eqNullSafe(F.lit(key)), F.lit(True)).otherwise(foreign))
        self._replace(table, key, own.drop(partition))

    def replace_all(self, table: str, frame: DataFrame) -> None:
        """K2. Replace the whole table, so gold holds only the batch processed last."""
        self._replace(table, _WHOLE, frame)

    def slice(self, table: str, key: str) -> DataFrame:
        """The newest version of one slice; no other folder is opened."""
        versions = self._pointers(table)
        return self._read(table, {key: versions[key]} if key in versions else {})

    def batch(self, table: str, batch_id: str) -> DataFrame:
        """S6. One batch."""
        return self.slice(table, batch_id)

    def gold(self) -> DataFrame:
        """S5. All gold columns."""
        return self.read("gold")

    def gold_for_features(self) -> DataFrame:
        """S4. The five gold columns the features need."""
        return self.gold().select("date", "item_code", "quantity_sold", "return_quantity", "avg_unit_price")

    def features(self, feature_version: str) -> DataFrame:
        """S10. One feature version."""
        return self.slice("features", feature_version)

    def save_artifact(self, name: str, frame: DataFrame) -> None:
        """K7. Intermediate results as Parquet."""
        frame.write.mode("overwrite").parquet(self.path(f"artifacts/{name}"))

    def save_report(self, name: str, report: DataFrame) -> None:
        """K8. A metrics report as JSON lines."""
        report.write.mode("overwrite").json(self.path(f"reports/{name}"))

    def save_csv(self, name: str, frame: DataFrame, single_file: bool = False) -> None:
        """K9. A CSV export with header; ``single_file`` only for a consumer that needs one file."""
        out = frame.coalesce(1) if single_file else frame
        out.write.mode("overwrite").option("header", True).csv(self.path(f"exports/{name}"))


def in_feature_order(features: DataFrame) -> DataFrame:
    """T6. (as_of_date, item_code, horizon); for output only."""
    return features.orderBy("as_of_date", "item_code", "horizon")


def in_training_order(features: DataFrame) -> DataFrame:
    """T6. (target_date, item_code, horizon, as_of_date); for output only."""
    return features.orderBy("target_date", "item_code", "horizon", "as_of_date")
