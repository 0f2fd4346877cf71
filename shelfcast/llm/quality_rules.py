"""Operator 7, quality rules by weak supervision.

Rules vote good, bad or abstain on each document. Expectation-maximisation over the counts of all vote
patterns estimates how often each rule is right; a document is kept by its posterior probability of being good,
not by passing every rule.

Defined results: a null or empty text has no words, fails the base checks and is not kept. Repeated rows give
repeated rows. Other columns are ignored by ``rule_votes``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import SHINGLE_WORDS, Words, text_slices
from shelfcast.session import written_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_LOWER[0xC3] = True  # lead byte of most accented Latin letters
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

STAT_COLUMNS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks",
    "n_digits", "n_punct", "n_distinct_words",
]
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STAT_COLUMNS)

# Defect rules vote bad beyond their limit and abstain below it, as the absence of one defect proves nothing.
_BAD_RULES: dict[str, str] = {
    "symbols": "n_symbols > 0.05 * word_chars",
    "punctuation": "n_punct > 0.10 * word_chars",
    "repeats": "n_repeat_words > 0.15 * n_words",
    "dup_lines": "n_dup_lines > 0.25 * n_lines",
    "capitals": "n_upper > 0.4 * (n_upper + n_lower)",
    "marks": "n_marks > 0.25 * n_words",
    "digits": "n_digits > 0.30 * word_chars",
    "long_words": "word_chars > 14 * n_words",
    "few_kinds": "n_words > 1.2 * n_distinct_words * (1 + ln(greatest(n_words, 1)))",
}
_GOOD_RULES: dict[str, str] = {
    "prose": "n_words > 0 and n_punct < 0.06 * word_chars and n_upper < 0.3 * (n_upper + n_lower)",
    "plain": "n_words > 0 and n_symbols <= 0.01 * word_chars and n_marks <= 0.05 * n_words",
}
RULE_NAMES = [*_BAD_RULES, *_GOOD_RULES]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated_words(grams: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(grams), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(grams) + SHINGLE_WORDS, np.int64)
    edge[: len(grams)] += hit
    edge[SHINGLE_WORDS:] -= hit
    return int((np.cumsum(edge) > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    kept = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(kept), len(kept) - len(set(kept))


def text_values(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list[int]]:
    """The STAT_COLUMNS of each text of a slice."""
    words = Words(data, offsets, lower=False)
    grams, bounds = words.windows(), words.bounds.tolist()
    spans = list(zip(bounds[:-1], bounds[1:]))
    lines = [_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": words.counts(),
        "word_chars": _per_text(lead & ~words.space, offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": [x[1] for x in lines],
        "n_repeat_words": [_repeated_words(grams[a : max(a, b - SHINGLE_WORDS + 1)]) for a, b in spans],
        "n_lines": [x[0] for x in lines],
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_lower": _per_text(_LOWER[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
        "n_digits": _per_text(_DIGIT[data], offsets),
        "n_punct": _per_text(_PUNCT[data], offsets),
        "n_distinct_words": [len(np.unique(words.hashes[a:b])) for a, b in spans],
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in text_slices(batch.column("text")):
            values = text_values(data, offsets)
            arrays = [ids.slice(first, end - first), *(pa.array(values[c], pa.int64()) for c in STAT_COLUMNS)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *STAT_COLUMNS])


def text_stats(docs: DataFrame) -> DataFrame:
    """Counts per document from its whole text; no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _stats, _SCHEMA
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_votes(stats: DataFrame) -> DataFrame:
    """Add one column per rule: 1 good, -1 bad, 0 abstain."""
    bad = {f"vote_{n}": F.when(F.expr(e), -1).otherwise(0).cast("tinyint") for n, e in _BAD_RULES.items()}
    good = {f"vote_{n}": F.when(F.expr(e), 1).otherwise(0).cast("tinyint") for n, e in _GOOD_RULES.items()}
    return stats.withColumns(bad | good)


def fit_rules(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation of how often each rule votes on good and on bad documents.

    patterns: distinct vote rows (-1, 0, 1); counts: documents per row. Returns the log prior odds of good and
    the log likelihood ratio, good to bad, of each rule's vote and of its abstention. Beta priors worth a
    twentieth of the documents say which way a rule points, and no ratio may point the other way, so the
    classes cannot swap. A vote is thus as strong as its rule agrees with the others, an abstention too.
    """
    total, vote = counts.sum(), patterns != 0
    sign = np.array([-1.0] * len(_BAD_RULES) + [1.0] * len(_GOOD_RULES))
    on_good, on_bad = np.where(sign < 0, 0.02, 0.95), np.where(sign < 0, 0.3, 0.2)
    prior_good, prior_bad, prior = on_good, on_bad, 0.85
    for _ in range(rounds if total else 0):
        ratio, rest = np.log(on_good / on_bad), np.log((1 - on_good) / (1 - on_bad))
        logit = np.log(prior / (1 - prior)) + np.where(vote, ratio, rest).sum(axis=1)
        good = counts / (1 + np.exp(-np.clip(logit, -50, 50)))
        bad, weight = counts - good, total / 20
        new_good = (good @ vote + weight * prior_good) / (good.sum() + weight)
        new_bad = (bad @ vote + weight * prior_bad) / (bad.sum() + weight)
        new_bad = np.where(sign < 0, np.maximum(new_bad, new_good), np.minimum(new_bad, new_good))
        done = max(np.abs(new_good - on_good).max(), np.abs(new_bad - on_bad).max()) < 1e-7
        on_good, on_bad, prior = new_good, new_bad, float(np.clip(good.sum() / total, 0.5, 0.95))
        if done:
            break
    return float(np.log(prior / (1 - prior))), np.log(on_good / on_bad), np.log((1 - on_good) / (1 - on_bad))


def quality_posterior(votes: DataFrame) -> DataFrame:
    """Add ``quality``: posterior probability of good. The driver gets at most 2^rules pattern counts."""
    names = [f"vote_{name}" for name in RULE_NAMES]
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    patterns = np.array([[row[c] for c in names] for row in rows], np.int64).reshape(-1, len(names))
    prior, ratio, rest = fit_rules(patterns, np.array([row["n"] for row in rows], float))
    logit: Column = F.lit(prior)
    for name, voted, abstained in zip(names, ratio.tolist(), rest.tolist()):
        logit = logit + F.when(F.col(name) != 0, voted).otherwise(abstained)
    return votes.withColumn("quality", 1 / (1 + F.exp(-logit)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Stats, votes, posterior and verdict of every row of ``docs`` (doc_id, text)."""
    stats = written_table(text_stats(docs))
    judged = quality_posterior(rule_votes(stats))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("quality") >= 0.5))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "quality")
