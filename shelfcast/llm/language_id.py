"""Operator 2, language of a text by a bidirectional recurrent network over its bytes.

The network labels every byte of the whole text; a document's probabilities are the means over its bytes. Texts
are read in windows, all windows of a batch at once. Training uses a bounded, stratified sample of labelled
documents (TRAIN_DOCS_PER_LANGUAGE in expectation, at most MAX_TRAIN_DOCS, one window each from a place given by
the id's hash); counts per language are over all documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any labelled document every
text is ``und``. Repeated rows give repeated rows, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.byte_gru import WINDOW, label_positions, train
from shelfcast.llm.words import text_slices

TRAIN_DOCS_PER_LANGUAGE = 1500
MAX_TRAIN_DOCS = 60_000  # of all languages; many languages share it evenly
MAX_LANGUAGES = 1_000  # labels learnt, the most frequent first; others are taken for noise in the column
HIDDEN = 8
TRAIN_ROUNDS = 250
UNKNOWN = "und"

_BATCH_WINDOWS = 1024
_SAMPLE_BUCKETS = 1 << 30


def train_sample(docs: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> tuple[list[str], list]:
    """(languages, rows of (lang, window of bytes)) of a stratified sample of ``docs`` (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    common = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    languages = sorted(counts)
    if not languages:
        return [], []
    # The draws of a language vary by about their square root; a twentieth less keeps the sum below the limit.
    per_language = min(per_language, 0.95 * MAX_TRAIN_DOCS / len(languages))
    limits = F.create_map(*[F.lit(x) for k in languages for x in (k, int(_SAMPLE_BUCKETS * min(1, per_language / counts[k])))])
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(_SAMPLE_BUCKETS))
    raw = F.col("text").cast("binary")
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1)))
    window = F.substring(raw, (place + 1).cast("int"), F.lit(WINDOW))
    picked = known.filter(chance < F.try_element_at(limits, F.col("lang"))).select("lang", window.alias("window"), chance.alias("chance"))
    return languages, picked.orderBy("chance", "lang", "window").limit(MAX_TRAIN_DOCS).collect()


def fit_language_model(docs: DataFrame, hidden: int = HIDDEN, rounds: int = TRAIN_ROUNDS) -> tuple[list[str], dict]:
    """(languages, weights) learnt from ``docs`` (doc_id, text, lang); the driver holds the sample's windows only."""
    languages, rows = train_sample(docs)
    if not rows:
        return [], {}
    codes = np.zeros((len(rows), WINDOW), np.uint8)
    real = np.zeros((len(rows), WINDOW), bool)
    for i, row in enumerate(rows):
        data = np.frombuffer(bytes(row["window"]), np.uint8)
        codes[i, : len(data)], real[i, : len(data)] = data, True
    labels = np.array([languages.index(row["lang"]) for row in rows])
    return languages, train(codes, real, labels, len(languages), hidden, rounds)


def text_probabilities(weights: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all bytes of each text."""
    size = np.diff(offsets)
    n_windows = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), n_windows)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = offsets[:-1][owner] + order * WINDOW
    length = np.minimum(WINDOW, offsets[1:][owner] - begin)
    total = np.zeros((len(size), len(weights["bias"])))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    steps = np.arange(WINDOW)
    for a in range(0, len(owner), _BATCH_WINDOWS):
        part = slice(a, a + _BATCH_WINDOWS)
        real = steps < length[part, None]
        codes = padded[begin[part, None] + steps] * real
        p = label_positions(weights, codes.astype(np.uint8))
        p *= real.T[:, None, :]
        sums = p.sum(axis=0)
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(owner[part], weights=sums[k], minlength=len(size))
    return total / np.maximum(size, 1)[:, None]


def _predictor(shared, languages: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                p = text_probabilities(weights, data, offsets)
                best = p.argmax(axis=1)
                letter = np.array(batch.column("has_letter").slice(first, end - first).to_pylist(), bool)
                names = [languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letter.tolist())]
                score = np.where(letter, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return predict


def predict_language(docs: DataFrame, languages: list[str], weights: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; reads doc_id and text only."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter"),
    )
    if not languages:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return texts.mapInArrow(_predictor(shared, languages), "doc_id long, lang_pred string, score double")


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, weights = fit_language_model(docs.filter(~held_out(3, 1)).select("doc_id", "text", "lang"))
    predicted = predict_language(docs, languages, weights)
    return predicted.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
