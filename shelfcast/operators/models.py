"""Boosted models and hybrid scoring.

The trees of ``boosting`` grow level by level where the reference's grow leaf by leaf, so fitted values differ; losses,
targets, row filters, weights, penalties, shares of rows and columns, clipping, blending and fallback rules are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import (
    CALENDAR_COLUMNS,
    DIRECT_COLUMNS,
    HISTORY_COLUMNS,
    MODEL_COLUMNS,
    SOURCE_FALLBACK,
    SOURCE_MODEL,
    DirectConfig,
)
from shelfcast.functions.numbers import positive_part
from shelfcast.functions.ranking import with_global_row_number
from shelfcast.operators.boosting import BoostedTrees, TreeSettings, feature_array, fit_trees, permutation_importance
from shelfcast.session import broadcast_if_bounded


# -- daily model ----------------------------------------------------------------------------------------


def item_ids(items: DataFrame) -> DataFrame:
    """P15. Dense alphabetical id, from 0, of the distinct items (U2 when fed a union)."""
    distinct = items.select("item_code").distinct()
    numbered = with_global_row_number(distinct, [F.col("item_code")], "_row")
    return numbered.select("item_code", (F.col("_row") - 1).cast("int").alias("item_code_id"))


def model_matrix(frame: DataFrame, ids: DataFrame, max_items: int | None = None) -> DataFrame:
    """P16. Model columns as doubles: flags to 0/1, missing history to 0, unknown items to -1."""
    table = broadcast_if_bounded(ids, max_items) if max_items is not None else ids
    numeric = {c: F.col(c).cast("int").cast("double") for c in CALENDAR_COLUMNS}
    numeric |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HISTORY_COLUMNS}
    joined = frame.join(table, "item_code", "left")
    return joined.withColumns(numeric).withColumn(
        "item_code_id", F.coalesce("item_code_id", F.lit(-1)).cast("double")
    )


@dataclass(frozen=True)
class DailyModelSettings:
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    max_bins: int = 64
    least_rows: int = 20
    row_share: float = 0.9
    column_share: float = 0.85
    patience: int = 30
    seed: int = 2026


def fit_daily_model(
    train: DataFrame, validation: DataFrame, settings: DailyModelSettings = DailyModelSettings()
) -> BoostedTrees:
    """M9. L1 gradient-boosted trees on model matrices; the validation rows choose the round that is kept."""
    rows = train.withColumn("_held_out", F.lit(False)).unionByName(
        validation.withColumn("_held_out", F.lit(True))
    )
    trees = TreeSettings(
        "absolute",
        rounds=settings.max_iter,
        depth=settings.max_depth,
        step=settings.step_size,
        bins=settings.max_bins,
        l2=0.0,
        least_rows=settings.least_rows,
        row_share=settings.row_share,
        column_share=settings.column_share,
        patience=settings.patience,
        seed=settings.seed,
    )
    return fit_trees(rows, MODEL_COLUMNS, "target_quantity", trees, held_out="_held_out")


def predict_daily(model: BoostedTrees | Transformer, matrix: DataFrame) -> DataFrame:
    """P14. ``predicted`` = the model's value, clipped at zero."""
    return (
        model.transform(matrix)
        .withColumn("predicted", positive_part(F.col("_raw_prediction")))
        .drop("_raw_prediction", "_features")
    )


def predict_with_fallback(
    frame: DataFrame,
    model: BoostedTrees | Transformer,
    ids: DataFrame,
    max_items: int | None = None,
) -> DataFrame:
    """M13, J12. Items of the training list get the model's value, all others lag 7; both clipped at zero.

    ``model`` maps a model matrix to ``_raw_prediction``. Adds ``predicted_quantity`` and
    ``prediction_source``.
    """
    matrix = model_matrix(frame, ids, max_items)
    known = F.col("item_code_id") >= 0
    # The model meets its own items only; of all others the plan reads little more than lag 7.
    scored = model.transform(matrix.filter(known)).withColumns(
        {
            "predicted_quantity": positive_part(F.col("_raw_prediction")),
            "prediction_source": F.lit(SOURCE_MODEL),
        }
    )
    others = matrix.filter(~known).withColumns(
        {
            "predicted_quantity": positive_part(F.coalesce("lag_7", F.lit(0.0))),
            "prediction_source": F.lit(SOURCE_FALLBACK),
        }
    )
    return scored.drop("_raw_prediction", "_features").unionByName(others)


def source_counts(forecast: DataFrame) -> DataFrame:
    """A12. Rows per prediction source."""
    return forecast.groupBy("prediction_source").agg(F.count(F.lit(1)).alias("rows"))


# -- direct models --------------------------------------------------------------------------------------


def _with_validation(train: DataFrame, validation: DataFrame | None) -> DataFrame:
    columns = [*DIRECT_COLUMNS, "target", "sample_weight"]
    rows = train.select(*columns).withColumn("_held_out", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.select(*columns).withColumn("_held_out", F.lit(True)))
    return rows.filter(F.col("sample_weight") > 0)


def direct_trees(loss: str, cfg: DirectConfig, least_rows: int, seed: int) -> TreeSettings:
    """Settings of one direct model."""
    return TreeSettings(loss, rounds=cfg.max_iter, depth=cfg.max_depth, step=cfg.step_size, least_rows=least_rows, seed=seed)


@dataclass(frozen=True)
class TwoStageModel:
    """Probability of a sale times the quantity given a sale."""

    classifier: BoostedTrees
    regressor: BoostedTrees

    def value_of(self, features: str):
        """Prediction as a column, from an array column of the direct features."""
        return positive_part(self.classifier.value_of(features) * self.regressor.value_of(features))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``yhat`` = P(sale) * E[quantity | sale], clipped at zero."""
        return rows.withColumn("_x", feature_array(DIRECT_COLUMNS)).withColumn("yhat", self.value_of("_x")).drop("_x")

    def parts(self) -> dict[str, BoostedTrees]:
        return {"classifier": self.classifier, "regressor": self.regressor}


@dataclass(frozen=True)
class TweedieModel:
    regressor: BoostedTrees

    def value_of(self, features: str):
        return positive_part(self.regressor.value_of(features))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``yhat``, clipped at zero."""
        return rows.withColumn("_x", feature_array(DIRECT_COLUMNS)).withColumn("yhat", self.value_of("_x")).drop("_x")

    def parts(self) -> dict[str, BoostedTrees]:
        return {"regressor": self.regressor}


def fit_two_stage(train: DataFrame, validation: DataFrame | None, cfg: DirectConfig) -> TwoStageModel:
    """M10, F6. Weighted sale classifier on all rows and a weighted Poisson model of the quantity on rows with a sale."""
    rows = _with_validation(train, validation).withColumn("_sold", (F.col("target") > 0).cast("double"))
    fit = lambda part, target, settings: fit_trees(part, DIRECT_COLUMNS, target, settings, "sample_weight", "_held_out")
    return TwoStageModel(
        fit(rows, "_sold", direct_trees("logistic", cfg, 80, cfg.seed)),
        fit(rows.filter(F.col("target") > 0), "target", direct_trees("poisson", cfg, 50, cfg.seed + 1)),
    )


def fit_tweedie(train: DataFrame, cfg: DirectConfig, validation: DataFrame | None = None) -> TweedieModel:
    """M11. Single-stage Tweedie trees, variance power 1.2, log link, weighted rows."""
    rows = _with_validation(train, validation)
    return TweedieModel(fit_trees(rows, DIRECT_COLUMNS, "target", direct_trees("tweedie", cfg, 80, cfg.seed), "sample_weight", "_held_out"))


Fitted = BoostedTrees | TwoStageModel | TweedieModel
FAMILIES = {"trees": BoostedTrees, "two_stage": TwoStageModel, "tweedie": TweedieModel}


def family_of(model: Fitted) -> str | None:
    return next((name for name, kind in FAMILIES.items() if isinstance(model, kind)), None)


def save_model(spark: SparkSession, model: Fitted, path: str) -> None:
    """K7. A fitted model of any family, one folder per set of trees."""
    if isinstance(model, BoostedTrees):
        model.save(spark, path)
        return
    for name, part in model.parts().items():
        part.save(spark, f"{path}/{name}")


def load_model(spark: SparkSession, family: str, path: str) -> Fitted:
    if family == "trees":
        return BoostedTrees.load(spark, path)
    names = ("classifier", "regressor") if family == "two_stage" else ("regressor",)
    return FAMILIES[family](*(BoostedTrees.load(spark, f"{path}/{name}") for name in names))


def _quantity_trees(model: Fitted) -> BoostedTrees:
    return model if isinstance(model, BoostedTrees) else model.regressor


def feature_importances(model: Fitted, spark: SparkSession) -> DataFrame:
    """M11. (feature, importance, splits) of the quantity trees of any family: share of all gain, number of splits."""
    rows = _quantity_trees(model).importances()
    total = sum(r[1] for r in rows) or 1.0
    table = spark.createDataFrame([(n, g / total, s) for n, g, s in rows], "feature string, importance double, splits int")
    return table.orderBy(F.desc("importance"), "feature")


def exchange_importances(model: Fitted, rows: DataFrame) -> DataFrame:
    """M11. (feature, loss, importance) of any family by exchanging each feature between rows with a known target."""
    if isinstance(model, BoostedTrees):
        return permutation_importance(rows, model.features, "target_quantity", model.value_of)
    return permutation_importance(rows, DIRECT_COLUMNS, "target", model.value_of, "sample_weight")


def held_out_curves(model: Fitted, spark: SparkSession) -> DataFrame:
    """M9, M10. (part, round, held_out, is_best): the held-out measure after every round of each set of trees."""
    parts = {"trees": model} if isinstance(model, BoostedTrees) else model.parts()
    rows = [(n, i, float(v), i == t.best_round) for n, t in parts.items() for i, v in enumerate(t.curve, 1)]
    return spark.createDataFrame(rows, "part string, round int, held_out double, is_best boolean")


def best_rounds(model: Fitted) -> dict[str, int]:
    parts = {"trees": model} if isinstance(model, BoostedTrees) else model.parts()
    return {name: trees.best_round for name, trees in parts.items()}
