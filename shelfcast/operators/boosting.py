"""Histogram gradient boosting on distributed rows (M9, M10, M11): five losses, held-out curve, importances.

Rows are binned once by quantiles of a bounded sample. A level of a tree is one job: each task adds up its rows'
gradients and hessians per node, feature and bin (in numpy, so that a row is not multiplied by its features), Spark sums
these partial histograms and picks the best split of each node by a grouped maximum; the driver gets one row per node.
Sums are kept in whole multiples of 1 / UNIT, so a fit does not depend on how the rows are dealt. (Only the leaf medians of the
absolute loss come from an approximate percentile.)

Trees grow level by level to ``depth``; a split needs ``least_rows`` rows on both sides. Each round sees its own share of
columns and of rows, drawn by hash. Held-out rows give the loss after every round, a batch of rounds in one pass; the
best round is kept and fitting stops when it is ``patience`` rounds old.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.functions.ranking import with_global_row_number
from shelfcast.session import delete_folder, work_folder

UNIT = float(1 << 20)
SAMPLE_ROWS = 200_000  # rows the bins are taken from, about
BATCH_ROUNDS = 10  # rounds after which scores are written and held-out losses computed
LEAST_HESSIAN = 1e-3
TWEEDIE_POWER = 1.2
LOSSES = ("poisson", "tweedie", "logistic", "absolute", "squared")
_LOG_LINK = ("poisson", "tweedie")


@dataclass(frozen=True)
class TreeSettings:
    loss: str
    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    l2: float = 2.0
    least_rows: int = 50
    row_share: float = 0.85
    column_share: float = 0.85
    patience: int = 30
    seed: int = 2026

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"Not a loss: {self.loss!r}")
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must be 2 to 256")


def gradients(loss: str, score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss by the raw score."""
    if loss == "poisson":
        mean = np.exp(np.clip(score, -30, 30))
        return weight * (mean - target), weight * mean
    if loss == "tweedie":
        low = np.exp(np.clip((1 - TWEEDIE_POWER) * score, -30, 30))
        high = np.exp(np.clip((2 - TWEEDIE_POWER) * score, -30, 30))
        return weight * (high - target * low), weight * ((2 - TWEEDIE_POWER) * high - (1 - TWEEDIE_POWER) * target * low)
    if loss == "logistic":
        chance = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return weight * (chance - target), weight * chance * (1 - chance)
    if loss == "absolute":
        return weight * np.sign(score - target), weight + 0.0
    return weight * (score - target), weight + 0.0


def measure(loss: str, score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What held-out rows are judged by: log loss, absolute error, else squared error of the predicted value."""
    if loss == "logistic":
        return weight * (np.log1p(np.exp(-np.abs(score))) + np.maximum(score, 0) - target * score)
    if loss == "absolute":
        return weight * np.abs(score - target)
    value = np.exp(np.clip(score, -30, 30)) if loss in _LOG_LINK else score
    return weight * (value - target) ** 2


@dataclass
class Tree:
    """Nodes in heap order, the root is 1. feature is -1 at a leaf; a row goes right if its bin is above ``bin``."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size))

    def nodes(self, rows: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node each row ends at; limits are bins for binned rows and thresholds for raw ones."""
        node, line = np.ones(len(rows), np.int64), np.arange(len(rows))
        while True:
            column = self.feature[node]
            inner = column >= 0
            if not inner.any():
                return node
            right = rows[line, np.maximum(column, 0)] > limits[node]
            node = np.where(inner, 2 * node + right, node)


@dataclass
class BoostedTrees:
    """A fitted model; ``transform`` adds the predicted value (a rate for log links, a chance for logistic)."""

    settings: TreeSettings
    features: list[str]
    base: float
    trees: list[Tree]
    curve: list[float] = field(default_factory=list)  # held-out measure after each round
    output: str = "_raw_prediction"

    @property
    def best_round(self) -> int:
        """Rounds that predictions use: up to the smallest held-out measure, all without held-out rows."""
        return int(np.argmin(self.curve)) + 1 if self.curve else len(self.trees)

    def predict(self, rows: np.ndarray, rounds: int | None = None) -> np.ndarray:
        score = np.full(len(rows), self.base)
        for tree in self.trees[: self.best_round if rounds is None else rounds]:
            score += tree.value[tree.nodes(rows, tree.threshold)]
        if self.settings.loss == "logistic":
            return 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return np.exp(np.clip(score, -30, 30)) if self.settings.loss in _LOG_LINK else score

    def value_of(self, features: str | None = None):
        """Prediction as a column, from the feature columns or from an array column of them."""
        model = self

        @F.pandas_udf("double")
        def score(values: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(values.to_numpy())) if len(values) else np.zeros(0))

        return score(F.col(features) if features else feature_array(self.features))

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.output, self.value_of())

    def importances(self) -> list[tuple[str, float, int]]:
        """(feature, sum of gains, number of splits) over the rounds in use, largest gain first."""
        gain, splits = np.zeros(len(self.features)), np.zeros(len(self.features), np.int64)
        for tree in self.trees[: self.best_round]:
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(splits, tree.feature[inner], 1)
        rows = [(name, float(g), int(s)) for name, g, s in zip(self.features, gain, splits)]
        return sorted(rows, key=lambda r: (-r[1], r[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """K7. Nodes and settings as two small tables."""
        rows = [
            (number, node, int(t.feature[node]), int(t.bin[node]), float(t.threshold[node]), float(t.value[node]), float(t.gain[node]))
            for number, t in enumerate(self.trees)
            for node in range(len(t.feature))
        ]
        schema = "tree int, node int, feature int, bin int, threshold double, value double, gain double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        facts = {"settings": asdict(self.settings), "features": self.features, "base": self.base, "curve": self.curve, "output": self.output}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        settings = TreeSettings(**facts.pop("settings"))
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        trees = [
            Tree(*(g[c].to_numpy().copy() for c in ("feature", "bin", "threshold", "value", "gain"))) for _, g in nodes.groupby("tree", sort=True)
        ]
        return cls(settings=settings, trees=trees, **facts)


def feature_array(names: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])


def quantile_cuts(rows: DataFrame, names: list[str], bins: int, n_rows: int) -> list[np.ndarray]:
    """Values at the bin borders of each feature: quantiles of all rows, or of about SAMPLE_ROWS drawn by hash."""
    if n_rows > SAMPLE_ROWS:
        share = F.lit(int(2**31 * SAMPLE_ROWS / n_rows))
        rows = rows.filter(F.pmod(F.xxhash64("_key", F.lit("bins")), F.lit(2**31)) < share)
    shares = [i / bins for i in range(1, bins)]
    # The accuracy exceeds the rows, so the percentiles are exact.
    columns = [F.percentile_approx(F.col("_x")[i], shares, 10_000_000).alias(f"q{i}") for i in range(len(names))]
    found = rows.agg(*columns).first()
    return [np.unique(np.array(q if q is not None else [0.0], np.float64)) for q in found]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


_ROWS = "bins binary, y double, w double, f double, held boolean, key long"


def _binning(cuts: list[np.ndarray], base: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), len(cuts))
            binned = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in binned], pa.binary())
            start = pa.array(np.full(len(batch), base))
            yield pa.RecordBatch.from_arrays(
                [packed, batch.column("_y"), batch.column("_w"), start, batch.column("_held"), batch.column("_key")],
                ["bins", "y", "w", "f", "held", "key"],
            )

    return scan


def _scored(batch: pa.RecordBatch, trees: list[Tree], width: int, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bins, target, weight and score (after ``trees``) of the rows of a batch that ``mask`` keeps."""
    bins = _bins(batch.column("bins"), width)[mask]
    y, w, f = (batch.column(c).to_numpy()[mask] for c in ("y", "w", "f"))
    f = f.copy()
    for tree in trees:
        f += tree.value[tree.nodes(bins, tree.bin)]
    return bins, y, w, f


def _in_round(batch: pa.RecordBatch, settings: TreeSettings, number: int) -> np.ndarray:
    """Training rows of a round: a share drawn by a hash of the row's key and the round."""
    train = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
    if settings.row_share >= 1:
        return train
    key = batch.column("key").to_numpy().astype(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    return train & ((key >> np.uint64(11)).astype(np.float64) / 2**53 < settings.row_share)


HISTOGRAM = "node int, feature int, bin int, g long, h long, n long"


def _histograms(settings: TreeSettings, number: int, trees: list[Tree], tree: Tree, level: int, columns: list[int], width: int):
    """Tasks that add up gradients and hessians of the nodes of a level by feature and bin."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, bins = 2**level, len(columns), settings.bins
        size = first * count * bins
        sums = [np.zeros(size, np.int64) for _ in range(3)]
        for batch in batches:
            x, y, w, f = _scored(batch, trees, width, _in_round(batch, settings, number))
            node = tree.nodes(x, tree.bin)
            here = node >= first
            x, node = x[here], node[here] - first
            g, h = gradients(settings.loss, f[here], y[here], w[here])
            spot = ((node[:, None] * count + np.arange(count)) * bins + x[:, columns]).ravel()
            for total, values in zip(sums, (np.rint(g * UNIT), np.rint(h * UNIT), np.ones(len(g)))):
                total += np.bincount(spot, np.repeat(values, count), size).astype(np.int64)
        used = np.flatnonzero(sums[2])
        node, rest = np.divmod(used, count * bins)
        column, place = np.divmod(rest, bins)
        arrays = [pa.array(node + first, pa.int32()), pa.array(np.array(columns)[column], pa.int32()), pa.array(place, pa.int32())]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(s[used], pa.int64()) for s in sums)], ["node", "feature", "bin", "g", "h", "n"])

    return scan


def best_splits(histograms: DataFrame, settings: TreeSettings) -> DataFrame:
    """Per node its sums and the split of the largest gain: (node, g, h, n, best: gain, feature, bin, left sums).

    Equal gains: the smaller feature number, then the smaller bin. best.gain is null where no split is allowed.
    """
    exact = {c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("g", "h", "n")}
    # Tasks have added up their own rows, so one shuffle by node and feature serves both the sums and the windows.
    total = histograms.repartition("node", "feature").groupBy("node", "feature", "bin").agg(*exact.values())
    upto = Window.partitionBy("node", "feature").orderBy("bin")
    every = Window.partitionBy("node", "feature")
    sums = {f"{c}_left": F.sum(c).over(upto).cast("double") / (1.0 if c == "n" else UNIT) for c in ("g", "h", "n")}
    sums |= {f"{c}_all": F.sum(c).over(every).cast("double") / (1.0 if c == "n" else UNIT) for c in ("g", "h", "n")}
    found = total.select("node", "feature", "bin", *[e.alias(n) for n, e in sums.items()])
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in ("g", "h", "n")}
    score = lambda g, h: g * g / (h + settings.l2)
    gain = score(F.col("g_left"), F.col("h_left")) + score(right["g"], right["h"]) - score(F.col("g_all"), F.col("h_all"))
    allowed = (F.least(F.col("n_left"), right["n"]) >= settings.least_rows) & (F.least(F.col("h_left"), right["h"]) >= LEAST_HESSIAN)
    choice = F.struct(
        F.when(allowed, gain).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "g_left", "h_left", "n_left"
    )
    return found.groupBy("node").agg(
        F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max("n_all").alias("n"), F.max(choice).alias("best")
    )


class _Fit:
    """Rows with their scores, rewritten every ``BATCH_ROUNDS`` rounds; the trees since then."""

    def __init__(self, rows: DataFrame, settings: TreeSettings, cuts: list[np.ndarray], base: float):
        self.spark, self.settings, self.cuts, self.width = rows.sparkSession, settings, cuts, len(cuts)
        self.folder, self.version = work_folder(self.spark), 0
        self.fresh: list[Tree] = []
        self.rows = self._written(rows.mapInArrow(_binning(cuts, base), _ROWS))

    def _written(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/rows-{self.version}"
        rows.write.parquet(path)
        if self.version:
            delete_folder(self.spark, f"{self.folder}/rows-{self.version - 1}")
        self.version += 1
        return self.spark.read.schema(_ROWS).parquet(path)

    def grow(self, number: int) -> Tree:
        """One tree; a job per level, and one more for the medians of the absolute loss."""
        s, tree = self.settings, Tree.empty(self.settings.depth)
        order = np.random.default_rng([s.seed, number]).permutation(self.width)
        columns = sorted(order[: max(1, round(s.column_share * self.width))].tolist())
        leaf = lambda g, h: -s.step * g / (h + s.l2) if h + s.l2 > 0 else 0.0
        for level in range(s.depth):
            scan = _histograms(s, number, self.fresh, tree, level, columns, self.width)
            grown = False
            for row in best_splits(self.rows.mapInArrow(scan, HISTOGRAM), s).collect():
                node, best = row["node"], row["best"]
                if level == 0:
                    tree.value[node] = leaf(row["g"], row["h"])
                if best["gain"] is None or best["gain"] <= 0:
                    continue
                column, place = -best["feature"], -best["bin"]
                tree.feature[node], tree.bin[node], tree.gain[node] = column, place, best["gain"]
                # The last bin has no border; no row lies beyond it, so no split is found there.
                tree.threshold[node] = self.cuts[column][place]
                tree.value[2 * node] = leaf(best["g_left"], best["h_left"])
                tree.value[2 * node + 1] = leaf(row["g"] - best["g_left"], row["h"] - best["h_left"])
                grown = True
            if not grown:
                break
        if s.loss == "absolute":
            self._median_leaves(tree, number)
        return tree

    def _median_leaves(self, tree: Tree, number: int) -> None:
        """Leaves of the absolute loss take the median of what is left of the target."""
        fresh, width, settings = self.fresh, self.width, self.settings

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, _, f = _scored(batch, fresh, width, _in_round(batch, settings, number))
                yield pa.RecordBatch.from_arrays([pa.array(tree.nodes(x, tree.bin), pa.int32()), pa.array(y - f)], ["node", "rest"])

        left = self.rows.mapInArrow(scan, "node int, rest double").groupBy("node").agg(F.percentile_approx("rest", 0.5).alias("rest"))
        for row in left.collect():
            tree.value[row["node"]] = settings.step * row["rest"]

    def held_out(self) -> list[float]:
        """Mean measure of the held-out rows after each fresh tree, in one pass over the prefixes."""
        fresh, width, loss = self.fresh, self.width, self.settings.loss

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, weight = np.zeros(len(fresh)), 0.0
            for batch in batches:
                mask = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                x, y, w, f = _scored(batch, [], width, mask)
                weight += w.sum()
                for i, tree in enumerate(fresh):
                    f += tree.value[tree.nodes(x, tree.bin)]
                    sums[i] += measure(loss, f, y, w).sum()
            place = pa.array(np.arange(len(fresh)), pa.int32())
            yield pa.RecordBatch.from_arrays([place, pa.array(sums), pa.array(np.full(len(fresh), weight))], ["place", "total", "weight"])

        total = self.rows.mapInArrow(scan, "place int, total double, weight double").groupBy("place")
        found = total.agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).orderBy("place").collect()
        means = [r["total"] / r["weight"] if r["weight"] else None for r in found]
        if not means or means[0] is None:
            return []
        return [float(np.sqrt(m)) if loss not in ("logistic", "absolute") else float(m) for m in means]

    def settle(self) -> None:
        """Write the rows with the fresh trees' values in their scores."""
        fresh, width = self.fresh, self.width

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *_, f = _scored(batch, fresh, width, np.ones(len(batch), bool))
                yield batch.set_column(batch.schema.get_field_index("f"), "f", pa.array(f))

        self.rows = self._written(self.rows.mapInArrow(scan, _ROWS))
        self.fresh = []


def _base(rows: DataFrame, loss: str) -> float:
    """The best constant score: log of the mean, log odds, median or mean of the training targets."""
    train = rows.filter(~F.col("_held"))
    if loss == "absolute":
        return float(train.agg(F.percentile_approx("_y", 0.5)).first()[0] or 0.0)
    mean = train.agg(F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).first()[0] or 0.0
    if loss == "logistic":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return float(np.log(mean / (1 - mean)))
    return float(np.log(max(mean, 1e-6))) if loss in _LOG_LINK else float(mean)


def prepared(rows: DataFrame, features: list[str], target: str, weight: str | None, held_out: str | None) -> DataFrame:
    """Features as one array, target, weight, held-out flag and a key by content; rows without weight or target go."""
    plain = rows.select(
        feature_array(features).alias("_x"),
        F.col(target).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        (F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)).alias("_held"),
    ).filter("_w > 0 and _y is not null")
    return plain.withColumn("_key", F.xxhash64("_x", "_y", "_w"))


def fit_trees(
    rows: DataFrame, features: list[str], target: str, settings: TreeSettings, weight: str | None = None, held_out: str | None = None
) -> BoostedTrees:
    """Fit on the rows that are not held out; the held-out ones give the curve and the best round."""
    ready = prepared(rows, features, target, weight, held_out)
    base = _base(ready, settings.loss)
    cuts = quantile_cuts(ready.filter(~F.col("_held")), features, settings.bins, ready.count())
    model = BoostedTrees(settings, list(features), base, [])
    fit = _Fit(ready, settings, cuts, base)
    for number in range(settings.rounds):
        tree = fit.grow(number)
        model.trees.append(tree)
        fit.fresh.append(tree)
        if len(fit.fresh) == BATCH_ROUNDS or number == settings.rounds - 1:
            model.curve += fit.held_out()
            if model.curve and len(model.curve) - model.best_round >= settings.patience:
                break
            if number < settings.rounds - 1:
                fit.settle()
    delete_folder(fit.spark, fit.folder)
    return model


def root_split(rows: DataFrame, features: list[str], target: str, settings: TreeSettings, weight: str | None = None) -> DataFrame:
    """The first split of the first tree over all rows and features: (feature, threshold, gain, rows_left, rows)."""
    whole = TreeSettings(**{**asdict(settings), "row_share": 1.0, "column_share": 1.0})
    ready = prepared(rows, features, target, weight, None)
    cuts = quantile_cuts(ready, features, whole.bins, ready.count())
    fit = _Fit(ready, whole, cuts, _base(ready, whole.loss))
    scan = _histograms(whole, 0, [], Tree.empty(0), 0, list(range(len(features))), len(features))
    best = best_splits(fit.rows.mapInArrow(scan, HISTOGRAM), whole)
    named = [(i, name, j, float(c)) for i, (name, cut) in enumerate(zip(features, cuts)) for j, c in enumerate(cut)]
    borders = rows.sparkSession.createDataFrame(named, "_i int, feature string, _j int, threshold double")
    met = best.join(borders, (F.col("_i") == -F.col("best.feature")) & (F.col("_j") == -F.col("best.bin")))
    return met.select("feature", "threshold", F.col("best.gain").alias("gain"), F.col("best.n_left").cast("long").alias("rows_left"), F.col("n").cast("long").alias("rows"))


def permutation_importance(rows: DataFrame, features: list[str], target: str, value_of, weight: str | None = None) -> DataFrame:
    """M11. (feature, loss, importance): squared error once a feature's values are exchanged, and its rise.

    ``value_of`` maps the name of an array column of the features to a prediction. All rows are numbered twice, in
    two orders by hash, and a row takes the value of the row that has its number in the other order. One job scores all
    features: the feature that is exchanged is a row key, -1 the untouched rows. Rows of equal content are
    interchangeable, so the result does not depend on how rows are dealt.
    """
    ready = prepared(rows, features, target, weight, None).drop("_held")
    order = lambda salt: [F.xxhash64("_key", F.lit(salt)), F.col("_key")]
    numbered = with_global_row_number(ready, order("takes"), "_n")
    donors = with_global_row_number(ready.select("_x", "_key"), order("gives"), "_n").select("_n", F.col("_x").alias("_other"))
    met = numbered.join(donors, "_n").withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = F.transform("_x", lambda x, i: F.when(i == F.col("_i"), F.element_at("_other", i + 1)).otherwise(x))
    scored = met.select("_i", "_y", "_w", swapped.alias("_x")).withColumn("_p", value_of("_x"))
    error = F.col("_w") * (F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))
    loss = scored.groupBy("_i").agg((F.sum(error) / F.sum("_w")).alias("loss"))
    plain = loss.filter("_i = -1").select("loss").scalar()
    names = F.array(*[F.lit(n) for n in features])
    return loss.filter("_i >= 0").select(F.element_at(names, F.col("_i") + 1).alias("feature"), "loss", (F.col("loss") - plain).alias("importance"))
