"""Operator 4, toxicity by weak supervision.

1. Lexicons: words and word beginnings that toxic training documents hold much more often than others, and a
   short fixed list, are dealt to many voters; pattern voters look at how many different terms a text holds.
2. Label model: expectation-maximisation over the counts of all vote patterns of all documents estimates, for each
   voter, how often it votes on either class, and the covariance of the voters within the classes, so that
   voters which repeat each other do not count twice.
3. Classifier: logistic regression on term presence, fitted to the label model's posterior probabilities.

Labels come from a bounded sample (MAX_TRAIN_DOCS, chosen by hash) of the labelled documents; term statistics are
over that sample, vote patterns and scores over all documents and whole texts.

Defined results: null and empty texts hold no term and get the score of the bias alone. Without labels of both
classes only the fixed list votes. Repeated rows give repeated rows; extra columns are ignored; an empty table gives an
empty result. A document with several labels counts as toxic if any says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.language_id import held_out
from shelfcast.llm.words import Words, mix, text_slices
from shelfcast.session import broadcast_if_bounded, written_table

MAX_TRAIN_DOCS = 20_000
MAX_TERMS = 1_000
MIN_RATIO = 4.0
MIN_LIKELIHOOD = 30.0  # log-likelihood ratio statistic; chance reaches it once in 20 million terms
PREFIX_BYTES = (4, 5, 6)
LEXICONS = 10  # voters that share the terms; each votes where one of its terms occurs
PATTERN_COUNTS = (2, 3, 5)  # voters on the number of different terms

# Fixed list of plain insults; one more voter.
SEED_WORDS = ["idiot", "stupid", "moron", "scum", "trash", "imbecile", "idiota", "estúpido", "basura", "dummkopf",
              "abschaum", "crétin", "ordure"]

_KIND = np.uint64(3)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_SPACES = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, text of each): hashes of all letter words and of their beginnings, repeats included."""
    letters = _SPACES[data]
    words = Words(letters, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), words.counts())
    # The low two bits say which kind a term is: a word, or the length of a beginning.
    terms, owners = [words.hashes & ~_KIND], [text]
    for k, size in enumerate(PREFIX_BYTES):
        long = words.ends - words.starts > size
        at = words.starts[long][:, None] + np.arange(size)
        head = letters[at].astype(np.uint64)
        head += np.where((head >= ord("A")) & (head <= ord("Z")), np.uint64(32), np.uint64(0))
        packed = np.zeros(len(head), np.uint64)
        for j in range(size):
            packed = packed * np.uint64(257) + head[:, j]
        terms.append((mix(packed) & ~_KIND) | np.uint64(k + 1))
        owners.append(text[long])
    return np.concatenate(terms), np.concatenate(owners)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each text's smallest shingle hash, which near copies mostly share."""
    for batch in batches:
        least = []
        for _, _, data, offsets in text_slices(batch.column("text")):
            least += [int(s[0]) - (1 << 63) if len(s) else 0 for s in Words(data, offsets).shingles()]
        yield batch.append_column("sketch", pa.array(least, pa.int64()))


def _word_term(word: str) -> int:
    data = word.encode()
    return int(text_terms(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term and class, summed over each slice before anything is shuffled."""
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        for first, end, data, offsets in text_slices(batch.column("text")):
            terms, text = text_terms(data, offsets)
            order = np.lexsort((text, terms))
            terms, text = terms[order], text[order]
            new = np.r_[True, (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])] if len(terms) else np.zeros(0, bool)
            terms, hit = terms[new], toxic[first:end][text[new]]
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
            n_toxic = np.add.reduceat(hit, starts) if len(starts) else starts
            n_docs = np.diff(np.r_[starts, len(terms)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms[starts].view(np.int64)), pa.array(n_toxic), pa.array(n_docs)], ["term", "n_toxic", "n_docs"]
            )


class Terms:
    """The terms in use, for look-ups in tasks: which of them each text holds."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.hashes & np.uint64(0xFFFF)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term number) pairs, each once."""
        terms, text = text_terms(data, offsets)
        likely = self.bits[terms & np.uint64(0xFFFF)]
        terms, text = terms[likely], text[likely]
        place = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        real = self.hashes[place] == terms
        pairs = np.unique(text[real] * len(self.hashes) + place[real])
        return pairs // len(self.hashes), pairs % len(self.hashes)


def _present_rows(shared):
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                text, term = terms.present(data, offsets)
                cuts = np.searchsorted(text, np.arange(end - first + 1))
                rows = [term[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                columns = [batch.column(c).slice(first, end - first) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], [*names, "terms"])

    return present


def voter_matrix(kinds: np.ndarray, seeds: list[int], numbers: list[np.ndarray]) -> np.ndarray:
    """Votes (texts, voters): lexicons take every LEXICONS-th term, then the fixed list, then the pattern voters.

    A word and its beginnings are one finding, so patterns count the terms of the kind that has most.
    """
    votes = np.zeros((len(numbers), LEXICONS + 1 + len(PATTERN_COUNTS)), bool)
    is_seed = np.isin(np.arange(len(kinds)), seeds)
    for i, own in enumerate(numbers):
        if len(own):
            votes[i, np.unique(own % LEXICONS)] = True
            votes[i, LEXICONS] = is_seed[own].any()
            votes[i, LEXICONS + 1 :] = np.bincount(kinds[own]).max() >= np.array(PATTERN_COUNTS)
    return votes


def _vote_rows(kinds: np.ndarray, seeds: list[int]):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = voter_matrix(kinds, seeds, [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column("terms")])
            packed = votes @ (1 << np.arange(votes.shape[1]))
            seen, counts = np.unique(packed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts)], ["votes", "n"])

    return vote


class LabelModel:
    """Two classes of votes: each voter's rates on both, and the voters' correlations within the classes.

    A voter's evidence is divided by one plus its correlations with the others, so that voters which repeat each
    other within a class count about once.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 100):
        total = max(counts.sum(), 1)
        v = votes.astype(float)
        mean = counts @ v / total
        discount = self._discount(v - mean, counts)
        share = v @ discount
        p = np.clip(1.5 * share / max(share.max(initial=0), 1e-9), 0.001, 0.99)  # those with most votes start as toxic
        self.prior = prior
        for _ in range(rounds if counts.sum() else 1):
            toxic, clean = counts * p, counts * (1 - p)
            # Voters never vote for clean: their rate among toxic texts is at least that among all others.
            self.on_clean = (clean @ v + 0.01) / (clean.sum() + 1)
            self.on_toxic = np.maximum((toxic @ v + 0.5) / (toxic.sum() + 1), self.on_clean)
            spread = v - p[:, None] * self.on_toxic - (1 - p)[:, None] * self.on_clean
            self.discount = self._discount(spread, counts)
            cast = np.log(self.on_toxic / self.on_clean)
            silent = np.log((1 - self.on_toxic) / (1 - self.on_clean))
            self.weights = self.discount * (cast - silent)
            self.bias = float(np.log(self.prior / (1 - self.prior)) + self.discount @ silent)
            new = self.posterior(votes)
            self.prior = float(np.clip((counts @ new) / total, 0.001, 0.5))
            done = np.abs(new - p).max(initial=0) < 1e-5
            p = new
            if done:
                break

    @staticmethod
    def _discount(spread: np.ndarray, counts: np.ndarray) -> np.ndarray:
        covariance = (spread * counts[:, None]).T @ spread / max(counts.sum(), 1)
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-6))
        correlation = np.maximum(covariance / np.outer(scale, scale), 0)
        np.fill_diagonal(correlation, 1)
        return 1 / correlation.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes.astype(float) @ self.weights + self.bias, -30, 30)))


def fit_classifier(presence: list[np.ndarray], target: np.ndarray, n_terms: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on term presence against probabilities, with a small penalty; accelerated descent.

    Columns are scaled by how rare their term is; the step follows from the largest curvature, so terms that
    always occur together do no harm.
    """
    if not presence:
        return np.zeros(n_terms), -3.0
    x = np.zeros((len(presence), n_terms + 1), np.float32)
    for i, own in enumerate(presence):
        x[i, own] = 1
    x[:, n_terms] = 1
    scale = 1 / np.sqrt(x.mean(axis=0) + 2e-3)
    x *= scale
    y, n = target.astype(np.float32), len(presence)
    top = np.ones(n_terms + 1, np.float32)
    for _ in range(20):
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    step = 1 / (0.25 * np.linalg.norm(x.T @ (x @ top)) / n + 1e-4)
    now = ahead = np.zeros(n_terms + 1, np.float32)
    for k in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) / n
        new = ahead - np.float32(step) * (error @ x + np.float32(1e-4) * ahead)
        ahead, now = new + np.float32(k / (k + 3)) * (new - now), new
    weights = now * scale
    return weights[:n_terms].astype(float), float(weights[n_terms])


def _scorer(shared, weights: np.ndarray, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = [bias + float(weights[np.frombuffer(b.as_buffer(), np.int32)].sum()) for b in batch.column("terms")]
            p = 1 / (1 + np.exp(-np.clip(np.array(logit, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, may_learn=None) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; labels (doc_id, toxic), of those ``may_learn`` holds for."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("toxic is not null and doc_id is not null")
    known = known.filter(may_learn) if may_learn is not None else known
    marks = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)
    # The sample's size is bounded, so the texts stay where they are.
    train = texts.join(broadcast_if_bounded(sample, MAX_TRAIN_DOCS), "doc_id").select("doc_id", "text", "toxic").mapInArrow(
        _sketches, "doc_id long, text string, toxic int, sketch long"
    )
    # A text copied fifty times is one witness, else its own words look like signs of its label.
    train = written_table(train.dropDuplicates(["sketch", "toxic"]).drop("sketch"))
    size = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n_toxic, n_clean = size["toxic"], size["n"] - size["toxic"]
    counted = train.select("text", "toxic").mapInArrow(_count_terms, "term long, n_toxic long, n_docs long")
    rates = counted.groupBy("term").agg(F.sum("n_toxic").alias("t"), F.sum(F.col("n_docs") - F.col("n_toxic")).alias("c"))
    t, c = F.col("t"), F.col("c")
    ratio = ((t + 0.5) / F.lit(n_toxic + 1)) / ((c + 0.5) / F.lit(n_clean + 1))
    expected = (t + c) * F.lit(n_toxic / max(1, size["n"]))
    surprise = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0))
    chosen = rates.filter("t > 1").withColumns({"ratio": ratio, "surprise": surprise})
    chosen = chosen.filter((F.col("ratio") >= MIN_RATIO) & (F.col("surprise") >= MIN_LIKELIHOOD))
    found = chosen.orderBy(F.desc("surprise"), "term").limit(MAX_TERMS).collect()
    seeds = np.unique(np.array([_word_term(w) for w in SEED_WORDS], np.uint64))
    mined = np.array([r["term"] for r in found], np.int64).view(np.uint64)
    terms = Terms(np.unique(np.concatenate([mined, seeds])))
    kinds = (terms.hashes & _KIND).astype(np.int64)
    n_terms, seed_numbers = len(terms.hashes), np.searchsorted(terms.hashes, seeds).tolist()
    shared = spark.sparkContext.broadcast(terms)
    held = written_table(texts.mapInArrow(_present_rows(shared), "doc_id long, terms binary"))
    patterns = held.select("terms").mapInArrow(_vote_rows(kinds, seed_numbers), "votes long, n long")
    rows = patterns.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    n_voters = LEXICONS + 1 + len(PATTERN_COUNTS)
    votes = (np.array([r["votes"] for r in rows], np.int64)[:, None] >> np.arange(n_voters) & 1).astype(bool)
    prior = (n_toxic + 1) / (size["n"] + 20)
    model = LabelModel(votes, np.array([r["n"] for r in rows], float), float(np.clip(prior, 0.001, 0.5)))
    fit = train.select("toxic", "text").mapInArrow(_present_rows(shared), "toxic int, terms binary").collect()
    presence = [np.frombuffer(bytes(r["terms"]), np.int32) for r in fit]
    target = model.posterior(voter_matrix(kinds, seed_numbers, presence)) if presence else np.zeros(0)
    weights, bias = fit_classifier(presence, target, n_terms)
    return held.mapInArrow(_scorer(shared, weights, bias), "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, labels, ~held_out(5, 0))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted.alias("predicted"))
