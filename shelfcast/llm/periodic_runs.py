"""Operator 12, periodic runs of words.

A run is a stretch of words with smallest period q (words q apart are identical) of at least 12 and at least 2 q words
that no neighbouring word extends. At each dyadic scale s the words are cut into blocks of s. An exact number-theoretic
transform of the squared differences finds where a block occurs again, without a mismatch, 2 s to 4 s words further on
(from 1 at the first scale). Each distance is a seed, extended to both sides by comparing words that far apart.

Nothing is missed: a run of period q, 2 s <= q < 4 s, holds a whole aligned block in its first q words and, as it has
2 q words, that block's occurrence q words on. At the first scale, s = 2, the twelve words do the same for q below 8.
Only blocks whose words all recur within 4 s words are transformed; no other can occur again there. The transform works
modulo a prime, so a false zero is possible; extension compares the words themselves and finds no run from it.

Defined results: a null or empty text has no words and no runs; its collapsed text is empty. Repeated rows give repeated
rows. Columns other than the id and the text are ignored; an empty table gives an empty result. A text is held whole by
one task (about 100 bytes a word); tables of any size stream through in record batches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN_WORDS = 12
FIRST_SCALE = 2
BATCH_VALUES = 1 << 17  # numbers transformed at once, unless one block alone needs more

_PRIME = 998_244_353  # 119 * 2^23 + 1, with primitive root 3
_Q = np.uint64(_PRIME)

Words = list[bytes]
Rewrite = Callable[[int | None, Words], Words]

_roots: dict[tuple[int, bool], np.ndarray] = {}


def _root_powers(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half."""
    if (half, inverse) not in _roots:
        root = pow(3, (_PRIME - 1) // (2 * half), _PRIME)
        root = pow(root, -1, _PRIME) if inverse else root
        out = np.ones(half, np.uint64)
        done = 1
        while done < half:
            step = np.uint64(pow(root, done, _PRIME))
            out[done : 2 * done] = out[:done] * step % _Q
            done *= 2
        _roots[half, inverse] = out
    return _roots[half, inverse]


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two of values below the prime), in bit-reversed order."""
    out = rows.astype(np.uint64)
    half = out.shape[1] // 2
    while half:
        pairs = out.reshape(len(out), -1, 2, half)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0] = (low + high) % _Q
        pairs[:, :, 1] = (low + _Q - high) * _root_powers(half, False) % _Q
        half //= 2
    return out


def transform_back(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    out = rows.astype(np.uint64)
    size, half = out.shape[1], 1
    while half < size:
        pairs = out.reshape(len(out), -1, 2, half)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1] * _root_powers(half, True) % _Q
        pairs[:, :, 0] = (low + high) % _Q
        pairs[:, :, 1] = (low + _Q - high) % _Q
        half *= 2
    return out * np.uint64(pow(size, -1, _PRIME)) % _Q


def block_occurrences(codes: np.ndarray, places: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each block of ``size`` codes that occurs again ``least`` to 4 * size - 1 places on.

    The sum of squared differences of block and text is the sum of both squares less twice their correlation; it is
    taken modulo the prime, so a pair may be reported in error, but none is left out. Codes are positive integers.
    """
    found, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    reach = 4 * size - least
    width = reach + size - 1
    padded = np.concatenate([codes, np.zeros(5 * size, np.int64)]).astype(np.int64)
    squares = np.concatenate([[0], np.cumsum(padded * padded % _PRIME)])
    step = max(1, BATCH_VALUES // (4 * size))
    for first in range(0, len(places), step):
        at = places[first : first + step]
        block = np.zeros((len(at), 4 * size), np.int64)
        block[:, :size] = padded[at[:, None] + np.arange(size)[::-1]]
        window = np.zeros_like(block)
        window[:, :width] = padded[at[:, None] + least + np.arange(width)]
        product = transform_back(transform(block) * transform(window) % _Q)[:, size - 1 : size - 1 + reach].astype(np.int64)
        begin = at[:, None] + least + np.arange(reach)
        energy = squares[begin + size] - squares[begin] + (squares[at + size] - squares[at])[:, None]
        row, shift = np.nonzero((energy - 2 * product) % _PRIME == 0)
        found.append(at[row])
        apart.append(shift + least)
    return np.concatenate(found), np.concatenate(apart)


def _gaps(codes: np.ndarray) -> np.ndarray:
    """Distance of each word to its next occurrence; the number of words if there is none."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    out = np.full(len(codes), len(codes), np.int64)
    out[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return out


def _has_smaller_period(codes: np.ndarray, period: int) -> bool:
    """Whether a stretch of at least two periods has a smaller one, which then divides the period."""
    rest, factor = period, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor == 0:
            part = period // factor
            if (codes[part:] == codes[:-part]).all():
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def _extended(codes: np.ndarray, places: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of the period ``distance`` around blocks that occur again."""
    differ = np.flatnonzero(codes[distance:] != codes[:-distance])
    place = np.searchsorted(differ, places)
    edge = np.concatenate([[-1], differ, [len(codes) - distance]])
    return sorted(set(zip((edge[place] + 1).tolist(), (edge[place + 1] + distance).tolist())))


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of positive integers, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    count, size, least = len(codes), FIRST_SCALE, 1
    if count < MIN_RUN_WORDS:
        return runs
    gaps = _gaps(codes)
    while least <= count // 2:
        whole = count // size
        near = gaps[: whole * size].reshape(whole, size).max(axis=1) < 4 * size
        if near.any():
            places, apart = block_occurrences(codes, np.flatnonzero(near) * size, size, least)
            fresh = np.ones(len(places), bool)
            for start, length, period in runs:
                # A seed inside a run whose period divides the distance belongs to that run.
                if length >= size + least:
                    fresh &= ~((apart % period == 0) & (places >= start) & (places + size + apart <= start + length))
            places, apart = places[fresh], apart[fresh]
            order = np.lexsort((places, apart))
            places, apart = places[order], apart[order]
            kinds, first = np.unique(apart, return_index=True)
            for distance, a, b in zip(kinds.tolist(), first.tolist(), [*first.tolist()[1:], len(apart)]):
                inside = [(s, n) for s, n, q in runs if distance % q == 0]
                for start, end in _extended(codes, places[a:b], distance):
                    if end - start < max(MIN_RUN_WORDS, 2 * distance) or any(s <= start and end <= s + n for s, n in inside):
                        continue
                    if not _has_smaller_period(codes[start:end], distance):
                        runs.append((start, end - start, distance))
        least, size = (4 * size, 2 * size)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of the words that no run contains after its first period."""
    edge = np.zeros(count + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def runs_of_text(text: str | None, doc_id: int | None, rewrite: Rewrite | None) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs and collapsed text of one text."""
    words = (text or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D, like the words of the contract
    words = rewrite(doc_id, words) if rewrite else words
    runs: list[tuple[int, int, int]] = []
    if len(words) >= MIN_RUN_WORDS:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        runs = find_runs(np.array(list(map(number.__getitem__, words)), np.int64))
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return len(words), runs, b" ".join(words)


def _each_text(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[pa.Array, list]]:
    """Ids and results of about a megabyte of text at a time."""
    for batch in batches:
        ids, texts, first, size = batch.column("doc_id"), batch.column("text"), 0, 0
        out = []
        for row in range(len(batch)):
            text = texts[row].as_py()
            out.append(runs_of_text(text, ids[row].as_py(), rewrite))
            size += len(text or "")
            if size > 1 << 20 or row == len(batch) - 1:
                yield ids.slice(first, row + 1 - first), out
                first, size, out = row + 1, 0, []


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs`` (doc_id, text); runs by start, then period.

    collapsed: the words that no run contains after its first period, joined by one space. ``rewrite`` may change the
    words of a text before, given its doc_id.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, out in _each_text(batches, rewrite):
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in out]
            arrays = [ids, pa.array(runs, kind), pa.array([t.decode() for *_, t in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return _documents(docs).mapInArrow(scan, schema)


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: number of runs, the longest (ties: smallest start, then period) and hashes of runs and collapsed text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, out in _each_text(batches, rewrite):
            best = [min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None for _, runs, _ in out]
            listed = ["".join(f"{s},{n},{q}\n" for s, n, q in runs) for _, runs, _ in out]
            columns = {
                "doc_id": ids,
                "n_runs": pa.array([len(runs) for _, runs, _ in out], pa.int64()),
                "start": pa.array([b and b[0] for b in best], pa.int64()),
                "length": pa.array([b and b[1] for b in best], pa.int64()),
                "period": pa.array([b and b[2] for b in best], pa.int64()),
                "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
                "collapsed_sha256": pa.array([hashlib.sha256(t).hexdigest() for *_, t in out], pa.string()),
                "n_kept_words": pa.array([n for n, *_ in out], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, n_kept_words long"
    )
    return _documents(docs).mapInArrow(scan, schema)


def repeat_tail(doc_id: int | None, words: Words) -> Words:
    """The words of the contract: in a tenth of the documents (by the crc32 of doc_id) the tail repeats its first words.

    A document without a doc_id keeps its words.
    """
    if doc_id is None or not words:
        return words
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return words
    rest = hashed // 10
    first = rest % len(words)
    count = len(words) - first
    period = 1 + count // (3 + rest % 8)
    head = words[first : first + period]
    return words[:first] + (head * (count // len(head) + 1))[:count]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeat_tail)
