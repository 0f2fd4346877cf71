"""Operator 1, token ids as length-delimited binary records with an offset index.

A record file holds, for each document: the length of the payload (8 bytes), a masked checksum of these bytes (4),
the payload, and a masked checksum of the payload (4). The payload is the doc_id (8), the bytes per id (1: 2 or 4) and the
ids. The index file beside it holds the offset and the length of every record (8 + 8), for reads in any order.
All numbers are little-endian. A checksum is a CRC-32, rotated right by 15 bits plus a constant, so that checksums
of data that hold checksums stay useful.

Defined results: null and empty texts give the end id alone. Rows are written in ascending order, rows without a doc_id
first, marked as such, and read back without one. Repeated rows are written each. Extra
columns are ignored. An empty table writes no files and reads back empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfcast.llm.encoding import encoder
from shelfcast.llm.shards import new_file, read_files
from shelfcast.session import work_folder

END_ID = 2
SHARD_TEXT_BYTES = 16 << 20
TOKENIZER = "word_bpe_49k.json"

# Fixed values of the checksum mask.
_MASK_DELTA = 0xA282EAD8
_MASK_SHIFT = 15
_NO_DOC_ID = 0x80  # flag in the byte that gives the bytes per id


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> _MASK_SHIFT) | (crc << (32 - _MASK_SHIFT))) + _MASK_DELTA) & 0xFFFFFFFF


def frame_record(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_checksum(length)), payload, struct.pack("<I", masked_checksum(payload))))


def read_records(data: memoryview) -> Iterator[memoryview]:
    """Payloads of a record file; a wrong checksum or a cut record raises."""
    place = 0
    while place < len(data):
        head = data[place : place + 12]
        if len(head) < 12 or masked_checksum(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"bad record length at byte {place}")
        (size,) = struct.unpack("<Q", head[:8])
        payload, tail = data[place + 12 : place + 12 + size], data[place + 12 + size : place + 16 + size]
        if len(tail) < 4 or masked_checksum(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"bad record at byte {place}")
        yield payload
        place += 16 + size


def read_record_at(data: memoryview, index: bytes, number: int) -> memoryview:
    """The payload of one record, found by the index."""
    offset, length = struct.unpack_from("<QQ", index, 16 * number)
    return next(read_records(data[offset : offset + length]))


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    width = (4 if wide else 2) | (_NO_DOC_ID if doc_id is None else 0)
    return struct.pack("<qB", doc_id or 0, width) + ids.astype("<u4" if wide else "<u2").tobytes()


def from_payload(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload[9:], f"<u{width & 7}").astype(np.uint32)
    return None if width & _NO_DOC_ID else doc_id, ids


_MANIFEST = "shard int, name string, index_name string, n_records long, n_tokens long"


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path).encode
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        records, tokens, place = 0, 0, 0
        with new_file(folder, f"shard-{shard:06d}", ".records") as (name, out), new_file(
            folder, f"shard-{shard:06d}", ".index"
        ) as (index_name, index):
            for batch in _and_then(first, batches):
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                        record = frame_record(to_payload(doc_id, np.append(ids, np.uint32(end_id))))
                        out.write(record)
                        index.write(struct.pack("<QQ", place, len(record)))
                        place += len(record)
                        records += 1
                        tokens += len(ids) + 1
        columns = zip([shard, name, index_name, records, tokens])
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["shard", "name", "index_name", "n_records", "n_tokens"]
        )

    return write


def _and_then(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def write_token_records(
    docs: DataFrame, folder: str, tokenizer_path: str, order: list[Column] | None = None, end_id: int = END_ID
) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards, ascending by ``order`` (doc_id if none); returns the manifest.

    Shards are range partitions of the order, so no task sorts more than its shard. The order ends with the text's
    hash, so a doc_id that very many rows share is split, too.
    """
    keys = order or [F.col("doc_id")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[k.alias(f"_order{i}") for i, k in enumerate(keys)],
    )
    n_bytes = rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    by = [*[F.col(f"_order{i}").asc_nulls_first() for i in range(len(keys))], F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(1 + n_bytes // SHARD_TEXT_BYTES, *by).sortWithinPartitions(*by)
    manifest = sorted_rows.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer_path, end_id), _MANIFEST)
    path = f"{folder}/_manifest"
    manifest.write.parquet(path)
    return docs.sparkSession.read.schema(manifest.schema).parquet(path)


_READ = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _reader(keep_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, starts = batch.column("shard").to_pylist(), batch.column("start").to_pylist()
            for shard, start, content in zip(shards, starts, batch.column("content")):
                rows: list[tuple] = []
                for payload in read_records(memoryview(content.as_buffer())):
                    doc_id, ids = from_payload(payload)
                    raw = ids.astype("<u4").tobytes()
                    rows.append((shard, doc_id, start, len(ids), zlib.crc32(raw), raw if keep_ids else None))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return read


def read_token_records(manifest: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """(shard, doc_id, start, n_tokens, ids_crc32, ids) of every record; ids as little-endian unsigned 32-bit integers.

    The manifest has one row per shard; only it passes through one task, for the running totals.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "name", "start")
    return read_files(placed, folder, ".records").select("shard", "start", "content").mapInArrow(_reader(keep_ids), _READ)


def op1_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_records(docs, folder, public_tokenizers.path(TOKENIZER))
    return read_token_records(manifest, folder, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
