"""Saved models and their versions (K7): training and batch forecasts may be separate jobs."""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.models import Fitted, best_rounds, family_of, load_model, save_model
from shelfcast.operators.serving import choose_model_version

STAGES = ("Production", "Staging", "None")
VERSION_SCHEMA = "name string, version string, stage string, path string, feature_version string, passed boolean, family string, best_rounds string"


class ModelStore:
    """Fitted models under one root folder, each with its training items; a version is written once.

    Models are boosted trees of any family (``family`` names it, ``best_rounds`` the rounds in use) or a pipeline.

    ``versions`` gets its row last, so a model that was written in part is never found.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> DataFrame:
        """(name, version, stage, path, feature_version, passed, family, best_rounds) of every saved version."""
        self._write_versions([])
        return self.spark.read.schema(VERSION_SCHEMA).parquet(f"{self.root}/versions")

    def save(
        self,
        model: Fitted | PipelineModel,
        ids: DataFrame,
        name: str,
        version: str,
        feature_version: str,
        stage: str = "Staging",
        passed: bool = True,
    ) -> str:
        """Save ``model`` and its ``ids`` (item_code, item_code_id); returns the path. A version cannot be replaced."""
        for part in (name, version):
            if not re.fullmatch(r"[\w.-]+", part):
                raise ValueError(f"Not a name or version: {part!r}")
        if stage not in STAGES:
            raise ValueError(f"Not a stage: {stage!r}")
        known = self.versions().filter((F.col("name") == name) & (F.col("version") == version))
        if not known.isEmpty():
            raise ValueError(f"Version {version} of model '{name}' exists")
        path = f"{self.root}/models/{name}/{version}"
        family = family_of(model)
        if family:
            save_model(self.spark, model, f"{path}/{family}")
        else:
            model.write().overwrite().save(f"{path}/pipeline")
        ids.select("item_code", "item_code_id").write.mode("overwrite").parquet(f"{path}/items")
        rounds = json.dumps(best_rounds(model)) if family else None
        self._write_versions([(name, version, stage, path, feature_version, passed, family, rounds)])
        return path

    def load(self, name: str) -> tuple[Fitted | PipelineModel, DataFrame, dict]:
        """T7, K7. (model, ids, version row) of the version to use: Production first, then the newest Staging."""
        row = choose_model_version(self.versions(), name).first().asDict()
        family = row["family"]
        model = load_model(self.spark, family, f"{row['path']}/{family}") if family else PipelineModel.load(f"{row['path']}/pipeline")
        return model, self.spark.read.parquet(f"{row['path']}/items"), row

    def _write_versions(self, rows: list[tuple]) -> None:
        frame = self.spark.createDataFrame(rows, VERSION_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{self.root}/versions")
