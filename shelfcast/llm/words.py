"""Words, shingles and their 64-bit hashes for batches of texts, in numpy inside Spark tasks.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Texts are scanned as UTF-8 in pieces of
bounded size, so memory stays small whatever the length of a text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts scanned together
PIECE_BYTES = 1 << 18  # bytes hashed at once; pieces end at white space
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20_240_607)
_BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES, 1 << int(n - 1).bit_length()) if n else PIECE_BYTES
    if size not in _tables:
        if size > PIECE_BYTES:  # one very long word; not kept
            return _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        _tables[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _tables[size]


def mix(value: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    z = value.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of one slice: ``hashes`` of all words in order, ``bounds[i]:bounds[i + 1]`` those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.space = _SPACE[data]
        inside = ~self.space
        starts = inside.copy()
        starts[1:] &= self.space[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        starts[cuts] = inside[cuts]
        self.starts = np.flatnonzero(starts)
        last = inside.copy()
        last[:-1] &= starts[1:] | self.space[1:]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(data, _LOWER_VALUE if lower else _BYTE_VALUE)

    def _hash(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(self.starts):
            begin = self.starts[first]
            end = max(first + 1, int(np.searchsorted(self.ends, begin + PIECE_BYTES, side="right")))
            piece = data[begin : self.ends[end - 1]]
            power, inverse = _power_tables(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
            a, b = self.starts[first:end] - begin, self.ends[first:end] - begin
            out[first:end] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
            first = end
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, size: int = SHINGLE_WORDS) -> np.ndarray:
        """Hash of the ``size`` words from each word on; entries that reach over a text's end are meaningless."""
        w = self.hashes
        total = np.zeros(len(w), np.uint64)
        for j in range(min(size, len(w))):
            total[: len(w) - j] += w[j:] * _PLACE[j]
        return mix(total)

    def shingles(self, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
        """Distinct shingle hashes of each text, ascending; a shorter text is one shingle of all its words."""
        grams = self.windows(size)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                rest = (self.hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([rest], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
