"""Operator 13, SentencePiece encoding with offsets, and decoding.

A text is normalised as the model says: from each place the longest prefix in the compiled character map is replaced,
any other character is kept, spaces become the meta symbol, and a dummy prefix goes before. Every byte of the normalised
text remembers the byte of the source it came from, so each piece is projected to a span of source bytes. The normalised
text is cut where no piece of the vocabulary reaches across (before a meta symbol that follows another character, and
between characters that never meet in a piece); each different part is merged once, best pair first, and remembered. Ids are those of the sentencepiece library, which also
decodes them.

Defined results: a null text is empty and has the end id only. Repeated rows give repeated rows; other columns are
ignored; an empty table gives an empty result. A text is held whole by one task (about 30 bytes a byte of text).
Byte-fallback pieces of a character span nothing but the last, which spans the character, as in the library. Models
other than BPE, or with user-defined or unused pieces, raise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
META = "▁"  # stands for a space in pieces
MAX_KNOWN = 1_000_000  # parts remembered by a worker (about 150 MB); beyond that, or MAX_POOL pieces, it starts anew
MAX_POOL = 8_000_000
MAX_SHORT = 48  # longer parts are merged with a queue
SLICE_CHARS = 2 << 20

# Numbers of the model's file format: piece kinds and the field numbers of its messages.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_BPE = 2

_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Normalizer:
    """The model's rules: compiled map (a double-array trie and its replacements), dummy prefix, extra spaces."""

    units: np.ndarray
    replacements: bytes
    dummy_prefix: bool = True
    drop_spaces: bool = True
    escape: bool = True

    @classmethod
    def of_model(cls, model: bytes) -> Normalizer:
        spec = dict(_fields(dict(_fields(model)).get(_NORMALIZER, b"")))
        compiled = bytes(spec.get(2, b""))
        size = int.from_bytes(compiled[:4], "little")
        units = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64)
        return cls(units, compiled[4 + size :], bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    def longest_prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest mapped prefix of ``data`` from ``at`` on, and its length; else one character."""
        units, found, length = self.units, -1, 0
        if len(units):
            unit = int(units[0])
            place = (unit >> 10) << ((unit & 512) >> 6)
            for end in range(at, len(data)):
                place ^= data[end]
                if place >= len(units):
                    break
                unit = int(units[place])
                if unit & 0x800000FF != data[end]:
                    break
                place ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit & 256:
                    found, length = int(units[place]) & 0x7FFFFFFF, end + 1 - at
        if length:
            return self.replacements[found : self.replacements.index(b"\0", found)], length
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + length], length

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the place in ``data`` it came from."""
        meta = META.encode() if self.escape else b" "
        if not data:
            return b"", np.zeros(1, np.int64)
        if not len(self.units) and not self.drop_spaces:
            return self._kept(data, meta)
        out, origin, at = bytearray(), [], 0
        if self.drop_spaces:
            while at < len(data):
                text, length = self.longest_prefix(data, at)
                if text.strip(b" "):
                    break
                at += length
            if at == len(data):
                return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += meta
            origin += [at] * len(meta)
        after_space = self.drop_spaces
        while at < len(data):
            text, length = self.longest_prefix(data, at)
            text = text.lstrip(b" ") if after_space else text
            if text:
                after_space = self.drop_spaces and text.endswith(b" ")
                text = text.replace(b" ", meta)
                out += text
                origin += [at] * len(text)
            at += length
        if self.drop_spaces:
            while out.endswith(meta):
                at = origin[len(out) - len(meta)]
                del out[len(out) - len(meta) :], origin[len(out) :]
        return bytes(out), np.array([*origin, at], np.int64)

    def _kept(self, data: bytes, meta: bytes) -> tuple[bytes, np.ndarray]:
        """The case without a map: characters stay, spaces become the meta symbol."""
        codes = np.frombuffer(data, np.uint8)
        start = np.arange(len(codes))
        if not data.isascii():
            start = np.maximum.accumulate(start * _LEAD[codes])
        prefix = meta if self.dummy_prefix else b""
        origin = np.repeat(start, (codes == 0x20) * (len(meta) - 1) + 1)
        return prefix + data.replace(b" ", meta), np.concatenate([np.zeros(len(prefix), np.int64), origin, [len(data)]])


def _classes(pieces: list[str]) -> list[str]:
    """Characters that a chain of neighbours within pieces connects, as strings, the largest class first."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for piece in pieces:
        inner = piece.lstrip(META)
        if len(piece) > 1 and inner:
            for a, b in zip(inner, inner[1:] or inner):
                parent[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in parent:
        classes.setdefault(top(c), []).append(c)
    return sorted(("".join(sorted(c)) for c in classes.values()), key=lambda c: (-len(c), c))


class PieceEncoder:
    """Pieces, scores and rules of a BPE model; remembers the ids of parts across texts."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer.of_model(model)
        trainer = dict(_fields(dict(_fields(model))[_TRAINER]))
        if trainer.get(3, 1) != _BPE or trainer.get(24, 0):
            raise ValueError("only BPE models with the meta symbol before words are supported")
        self.id_of: dict[str, int] = {}
        self.cost: dict[str, float] = {}  # joins by the smallest cost first, that is the best score
        self.byte_id: dict[int, int] = {}
        self.unknown = 0
        for number, piece in enumerate(v for k, v in _fields(model) if k == _PIECES):
            values = dict(_fields(piece))
            text, kind = bytes(values[1]).decode(), values.get(3, _NORMAL)
            if kind in (_USER, _UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            if kind == _BYTE:
                self.byte_id[int(text[3:5], 16)] = number
            elif kind == _NORMAL:
                self.id_of[text] = number
                self.cost[text] = -float(np.frombuffer(values.get(2, bytes(4)), "<f4")[0])
            elif kind == _UNKNOWN:
                self.unknown = number
        if any(META in piece.lstrip(META) for piece in self.id_of):
            self.parts = re.compile("(?s:.+)")  # a piece reaches over the cuts, so texts are merged whole
        else:
            # No piece holds neighbours of two classes, so a part is some meta symbols and characters of one class.
            joined = [f"{META}*[{re.escape(c)}]+" for c in _classes(list(self.id_of))]
            self.parts = re.compile("|".join([*joined, f"{META}+", "(?s:.)"]))
        self.end = self.library.eos_id()
        self.name = list(map(str, range(self.library.get_piece_size())))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.sizes = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint32)

    def merged(self, part: str) -> list[str]:
        """Texts of the pieces of a part: the two neighbours of the smallest cost are joined, of equal ones the
        leftmost, until no join is a piece."""
        texts, cost = list(part), self.cost.get
        if len(texts) > MAX_SHORT:
            return self._merged_long(texts)
        none = float("inf")
        costs = [cost(a + b, none) for a, b in zip(texts, texts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            texts[i] += texts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(texts[i - 1] + texts[i], none)
            if i < len(costs):
                costs[i] = cost(texts[i] + texts[i + 1], none)
        return texts

    def _merged_long(self, texts: list[str]) -> list[str]:
        """The same with a queue of joins; pieces live at the place of their first character."""
        after, before = list(range(1, len(texts) + 1)), list(range(-1, len(texts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(texts):
                both = texts[left] + texts[after[left]]
                if both in self.cost:
                    heapq.heappush(queue, (self.cost[both], left, both))

        for left in range(len(texts) - 1):
            offer(left)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            # An offer is out of date if either side was joined to something else meanwhile.
            if not texts[left] or right >= len(texts) or texts[left] + texts[right] != both:
                continue
            texts[left], texts[right] = both, ""
            after[left] = after[right]
            if after[left] < len(texts):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [t for t in texts if t]

    def _remember(self, part: str) -> None:
        """Put the ids and sizes in bytes of a part's pieces into the pool."""
        ids, sizes = [], []
        for text in self.merged(part):
            data = text.encode()
            if text in self.id_of:
                ids.append(self.id_of[text])
                sizes.append(len(data))
            elif self.byte_id:
                ids += [self.byte_id[b] for b in data]
                sizes += [1] * len(data)
            else:
                ids.append(self.unknown)
                sizes.append(len(data))
        number, end = len(self.known), self.used + len(ids)
        if number == len(self.first):
            self.first, self.count = np.resize(self.first, 2 * number), np.resize(self.count, 2 * number)
        if end > len(self.ids):
            self.ids, self.sizes = np.resize(self.ids, 2 * end), np.resize(self.sizes, 2 * end)
        self.ids[self.used : end], self.sizes[self.used : end] = ids, sizes
        self.first[number], self.count[number] = self.used, len(ids)
        self.known[part], self.used = number, end

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text the ids (without the end id) and the first and end byte of the source of each piece."""
        normal = [self.normalizer.normalise((t or "").encode()) for t in texts]
        each = [self.parts.findall(data.decode()) for data, _ in normal]
        if len(self.known) > MAX_KNOWN or self.used > MAX_POOL:
            self._forget()
        for part in set().union(*each).difference(self.known):
            self._remember(part)
        out = []
        for parts, (_, origin) in zip(each, normal):
            number = np.array(list(map(self.known.__getitem__, parts)), np.int64)
            count = self.count[number]
            total = np.concatenate([[0], np.cumsum(count)])
            place = np.repeat(self.first[number] - total[:-1], count) + np.arange(total[-1])
            ids, edges = self.ids[place], np.concatenate([[0], np.cumsum(self.sizes[place], dtype=np.int64)])
            if not self.byte_id and len(ids):
                # Without byte pieces the library makes one piece of unknown characters in a row.
                keep = np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])
                ids, edges = ids[keep], np.append(edges[:-1][keep], edges[-1])
            edges = origin[edges] if len(ids) else np.zeros(1, np.int64)
            out.append((ids, edges[:-1], edges[1:]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and model file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray, str]


def _each_text(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[Encoded]]]:
    """Ids of rows, and of each text the ids with the end id, first and end bytes and the decoded text."""
    encoder = piece_encoder(path)
    for batch in batches:
        rows, texts, first, size = batch.column("doc_id"), batch.column("text"), 0, 0
        some: list[str | None] = []
        for row in range(len(batch)):
            some.append(texts[row].as_py())
            size += len(some[-1] or "")
            if size > SLICE_CHARS or row == len(batch) - 1:
                found = encoder.encode(some)
                ids = [np.append(x, np.uint32(encoder.end)) for x, *_ in found]
                decoded = encoder.decode([x.tolist() for x in ids])
                yield rows.slice(first, row + 1 - first), [(i, *s, d) for i, (_, *s), d in zip(ids, found, decoded)]
                first, size, some = row + 1, 0, []


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) of every row of ``docs`` (doc_id, text).

    ids end with the end id, which has no span; piece i comes from the bytes begins[i] to ends[i] of the UTF-8 text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _each_text(batches, path):
            arrays = [
                rows,
                pa.array([x.astype(np.int32) for x, *_ in out], pa.list_(pa.int32())),
                pa.array([b for _, b, _, _ in out], pa.list_(pa.int64())),
                pa.array([e for _, _, e, _ in out], pa.list_(pa.int64())),
                pa.array([d for *_, d in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "begins", "ends", "decoded"])

    return _documents(docs).mapInArrow(scan, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number of ids, hashes of ids and decoded text, and a checksum of the spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = piece_encoder(path).name.__getitem__
        for rows, out in _each_text(batches, path):
            spans = [zlib.crc32(e.astype("<i8").tobytes(), zlib.crc32(b.astype("<i8").tobytes())) for _, b, e, _ in out]
            listed = [" ".join(map(name, x.tolist())) for x, *_ in out]
            columns = {
                "doc_id": rows,
                "n_tokens": pa.array([len(x) for x, *_ in out], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for *_, d in out]),
                "spans_crc32": pa.array(spans, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return _documents(docs).mapInArrow(scan, schema)


def op13_piece_spans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
