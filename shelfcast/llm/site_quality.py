"""Operator 9, quality classifier with hierarchical empirical Bayes.

A logistic classifier on text statistics gives each document's own evidence. Sites (source) and their sections
(source and lang, as sites keep one path per language) have quality rates of their own: a section's rate is shrunk
towards its site's, a site's towards the global rate, each as strongly as the spread between siblings says. A
document's posterior joins its evidence with its section's rate, from which its own share is taken out.

The classifier is fitted on a bounded sample (MAX_TRAIN_DOCS, chosen by hash) of labelled documents; rates are grouped
sums over all documents. The sums have partial aggregates, so a site with a third of all rows is no hot group, and
the texts themselves are never shuffled: rates reach them by a join with the small table of sections.

Defined results: null and empty texts have the statistics of an empty text. A null source or lang is a site or section of
its own. Without labels of both classes the evidence is 0 and all documents are kept. Repeated rows are judged each;
extra columns pass through; an empty table gives an empty result. A document with several labels is good if all say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfcast.llm.quality_rules import STAT_COLUMNS, text_values
from shelfcast.llm.words import text_slices
from shelfcast.session import written_table

MAX_TRAIN_DOCS = 20_000
MIN_POSTERIOR = 0.5
START_RATE = 0.9

_STAT = "_stat_"
_SITE, _SECTION = "_site", "_section"


def with_stats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and the text statistics as ``_stat_*``."""
    taken = [c for c in docs.columns if c.startswith(_STAT)]
    if taken:
        raise ValueError(f"reserved column names: {taken}")
    schema = StructType([*docs.schema.fields, *(StructField(_STAT + c, LongType()) for c in STAT_COLUMNS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                values = text_values(data, offsets)
                arrays = [*batch.slice(first, end - first).columns, *(pa.array(values[c], pa.int64()) for c in STAT_COLUMNS)]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *(_STAT + c for c in STAT_COLUMNS)])

    return docs.mapInArrow(add, schema)


def features() -> list[Column]:
    """Bounded measures of a text, as built-in expressions on its statistics."""
    s = {c: F.col(_STAT + c).cast("double") for c in STAT_COLUMNS}

    def share(a: Column, b: Column, full: float) -> Column:
        return F.least(a / F.greatest(b, F.lit(1.0)) / F.lit(full), F.lit(1.0))

    return [
        share(s["n_symbols"], s["word_chars"], 0.1),
        share(s["n_punct"], s["word_chars"], 0.2),
        share(s["n_upper"], s["n_upper"] + s["n_lower"], 0.5),
        share(s["n_marks"], s["n_words"], 0.5),
        share(s["n_digits"], s["word_chars"], 0.3),
        share(s["n_repeat_words"], s["n_words"], 0.5),
        share(s["n_dup_lines"], s["n_lines"], 0.5),
        share(s["n_words"], s["n_distinct_words"] * (1 + F.log(F.greatest(s["n_words"], F.lit(1.0)))), 2.0),
        share(s["word_chars"], s["n_words"], 15.0),
        F.least(F.log1p(s["n_words"]) / F.lit(5.0), F.lit(1.0)),
    ]


def fit_evidence(x: np.ndarray, good: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and bias of the log likelihood ratio good to bad: logistic regression without the classes' prior odds."""
    if not len(good) or good.all() or not good.any():
        return np.zeros(x.shape[1] + 1)
    design = np.c_[x, np.ones(len(x))]
    weights, penalty = np.zeros(design.shape[1]), np.r_[np.full(x.shape[1], 0.05), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (p - good) + penalty * weights
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    weights[-1] -= np.log(good.mean() / (1 - good.mean()))
    return weights


def _evidence(weights: np.ndarray) -> Column:
    total: Column = F.lit(float(weights[-1]))
    for column, weight in zip(features(), weights[:-1].tolist()):
        total = total + column * F.lit(weight)
    return F.greatest(F.least(total, F.lit(15.0)), F.lit(-15.0))


def _sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, n: str, total: str, parent: Column) -> float:
    """Documents that the parent's rate is worth, from how far the groups' rates spread around it (moments)."""
    rate = F.col(total) / F.col(n)
    row = groups.agg(
        F.sum(F.col(n) * (rate - parent) * (rate - parent)).alias("spread"),
        F.sum(parent * (1 - parent)).alias("chance"),
        F.sum(F.col(n) * parent * (1 - parent)).alias("weight"),
    ).first()
    if not row["weight"]:
        return 1.0
    shared = min(0.5, max(1e-6, (row["spread"] - row["chance"]) / row["weight"]))
    return (1 - shared) / shared


def site_rates(judged: DataFrame) -> tuple[DataFrame, float]:
    """(site, section, n, total, site_rate) from (site, section, own), and how many documents a site's rate is worth."""
    sections = written_table(
        judged.groupBy(_SITE, _SECTION).agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("total"))
    )
    sites = written_table(sections.groupBy(_SITE).agg(F.sum("n").alias("site_n"), F.sum("total").alias("site_total")))
    whole = sites.agg(F.sum("site_n").alias("n"), F.sum("site_total").alias("total")).first()
    rate = whole["total"] / whole["n"] if whole["n"] else START_RATE
    worth = _strength(sites, "site_n", "site_total", F.lit(rate))
    shrunk = sites.select(_SITE, ((F.lit(worth * rate) + F.col("site_total")) / (F.lit(worth) + F.col("site_n"))).alias("site_rate"))
    rated = written_table(sections.join(shrunk, _SITE))
    return rated, _strength(rated, "n", "total", F.col("site_rate"))


def _sited(docs: DataFrame, site: str, section: str) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null is "", not "="
    return docs.withColumns({_SITE: name(site), _SECTION: name(section)})


def judge_quality(docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with ``_evidence``, ``_section_rate`` and ``_quality`` (posterior of good)."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)
    sited = _sited(docs, site, section)
    stats = written_table(with_stats(sited.select("doc_id", "text", _SITE, _SECTION)).drop("text"))
    rows = stats.join(marks, "doc_id").select(F.array(*features()).alias("x"), "good").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(features()))
    weights = fit_evidence(x, np.array([r["good"] for r in rows], float) > 0)
    own = _sigmoid(_evidence(weights) + _logit(F.lit(START_RATE)))
    rates, worth = site_rates(stats.select(_SITE, _SECTION, own.alias("own")))
    # The same built-in expressions again, beside the texts.
    named = {c: f"_section_{c}" for c in ("n", "total", "site_rate")}
    full = with_stats(sited).join(rates.withColumnsRenamed(named), [_SITE, _SECTION])
    others = F.lit(worth) * F.col("_section_site_rate") + F.col("_section_total") - own
    others = others / (F.lit(worth) + F.col("_section_n") - 1)
    judged = full.withColumns({"_evidence": _evidence(weights), "_section_rate": others})
    judged = judged.withColumn("_quality", _sigmoid(F.col("_evidence") + _logit(F.col("_section_rate"))))
    return judged.select(*docs.columns, "_evidence", "_section_rate", "_quality")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are more likely good than not, with their columns only."""
    return judge_quality(docs, labels).filter(F.col("_quality") >= MIN_POSTERIOR).select(*docs.columns)


def op9_site_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = judge_quality(docs.select("doc_id", "text", "source", "lang"), labels)
    return judged.select(
        "doc_id", F.col("_evidence").alias("evidence"), F.col("_section_rate").alias("section_rate"),
        F.col("_quality").alias("quality"), (F.col("_quality") >= MIN_POSTERIOR).alias("kept"),
    )
