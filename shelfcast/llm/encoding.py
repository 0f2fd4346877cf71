"""Encode whole texts with a word-level BPE of the tokenizers library, each different word once.

The tokenizer lower-cases, drops white space and encodes each pre-token by itself. Texts of plain Latin
characters are cut into pre-tokens with numpy by the tokenizer's own pattern, and only pre-tokens not seen before go
through the library. Any other text goes through the library as a whole, so all ids are the library's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from shelfcast.llm.words import mix

SLICE_CHARS = 2_000_000
MAX_KNOWN = 400_000  # pre-tokens remembered by a worker; more are encoded again in each slice

_LATIN_END = 0x250
# Characters whose handling differs between libraries, or whose normal form or lower case is another length.
_NOT_PLAIN = re.compile("[^\t\n\r -~¡-¬®-įı-ɏ]|<\\|")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _class_of(c: str) -> int:
    return _SPACE if c in "\t\n\r " else _LETTER if c.isalpha() else _DIGIT if c.isnumeric() else _OTHER


_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(_LATIN_END)], np.uint16)
_CLASS = np.array([_class_of(chr(i)) for i in range(_LATIN_END)], np.uint8)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, _LATIN_END, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _starts(codes: np.ndarray) -> np.ndarray:
    """Flags of the first characters of pre-tokens: runs of letters or of others, single digits, contractions."""
    kind = _CLASS[codes]
    start = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
    start |= kind == _DIGIT
    quote = np.flatnonzero((codes == ord("'")) & start)
    if len(quote):
        after = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for spots, size in ((quote[short], 2), (quote[pair & ~short], 3)):
            start[spots + 1] = False
            rest = spots[spots + size < len(start)] + size
            start[rest] = True
    return start


class Encoder:
    """Remembers the ids of pre-tokens across the texts of a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = np.zeros(0, np.uint64)  # hashes of pre-tokens, ascending
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        joined = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a pre-token was cut up; this tokenizer needs whole texts")
        return ids, np.diff(np.r_[0, ends])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = " ".join(texts)
        codes = _LOWER[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        inside = np.cumsum([0] + [len(t) + 1 for t in texts])
        flags = _starts(codes)
        spots = np.flatnonzero(flags)
        ends = np.r_[spots[1:], len(codes)]
        word = _CLASS[codes[spots]] != _SPACE
        spots, ends = spots[word], ends[word]
        hashes = self._hash(codes, spots, ends)
        kinds, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, kinds), max(len(self.known) - 1, 0))
        old = self.known[place] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        fresh = np.flatnonzero(~old)
        text = codes.astype("<u2").tobytes().decode("utf-16-le")
        new_ids, new_size = self._encode_words([text[spots[i] : ends[i]] for i in sample[fresh].tolist()])
        first, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        if old.any():
            first[old], size[old] = self.first[place[old]], self.size[place[old]]
        size[fresh] = new_size
        first[fresh] = len(self.pool) + np.cumsum(new_size) - new_size
        pool = np.concatenate([self.pool, new_ids])
        lengths = size[inverse]
        total = np.r_[0, np.cumsum(lengths)]
        out = pool[np.repeat(first[inverse] - total[:-1], lengths) + np.arange(total[-1])]
        if len(fresh) and len(self.known) + len(fresh) <= MAX_KNOWN:
            order = np.argsort(np.concatenate([self.known, kinds[fresh]]), kind="stable")
            self.known = np.concatenate([self.known, kinds[fresh]])[order]
            self.first = np.concatenate([self.first, first[fresh]])[order]
            self.size = np.concatenate([self.size, size[fresh]])[order]
            self.pool = pool
        cuts = total[np.searchsorted(spots, inside)]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _hash(codes: np.ndarray, spots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power = np.full(len(codes), _BASE, np.uint64)
        inverse = np.full(len(codes), pow(_BASE, -1, 2**64), np.uint64)
        if len(codes):
            power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_VALUE[codes] * power, out=total[1:])
        return mix((total[ends] - total[spots]) * inverse[spots] + (ends - spots).astype(np.uint64)) if len(spots) else total[:0]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null is empty."""
        run: list[str] = []
        chars = 0

        def plain_run() -> list[np.ndarray]:
            return self._plain(run) if run else []

        for text in texts:
            text = text or ""
            if _NOT_PLAIN.search(text):
                yield from plain_run()
                run, chars = [], 0
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            run.append(text)
            chars += len(text)
            if chars >= SLICE_CHARS:
                yield from plain_run()
                run, chars = [], 0
        yield from plain_run()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


