"""Operator 6, WARC archives with boundary-chain verification.

Writing: one record per page. Of pages with equal payloads the one with the smallest page_id becomes a response,
the others revisits that refer to it and carry the HTTP head alone. By default every record is a gzip member of its own;
plain files are an option.

Reading: tasks look for the record magic anywhere in an archive and emit, for every place where a whole record
parses, the offset and the offset behind it. A payload may hold archives itself, so such a place proves nothing: only
records reachable from the file's start through the chain of successors are real. The chain is followed by pointer
jumping (joins that double the reach each round), never by one task walking a file.

Defined results: null html is an empty payload; rows without a page_id are left out (nothing could name them); rows
with one page_id are records of their own, each a response or a revisit by its own payload. Payloads below
``min_payload`` bytes are never revisits. Urls and payloads may have any length. Extra columns are ignored. An empty
table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.shards import new_file, read_files
from shelfcast.session import delete_folder, work_folder, written_table

MIN_PAYLOAD = 0
ARCHIVE_PAGE_BYTES = 16 << 20

# Fixed values of the format.
_PLAIN_MAGIC = b"WARC/1.1\r\n"
_GZIP_MAGIC = b"\x1f\x8b\x08"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of page ``refers_to`` with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else f"urn:page:{page_id}"
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return _PLAIN_MAGIC + "\r\n".join(head).encode() + _HEAD_END + block + _HEAD_END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, length) of the record at the start of ``data``, or None if no whole record is there."""
    if data[: len(_PLAIN_MAGIC)] != _PLAIN_MAGIC:
        return None
    end = data.find(_HEAD_END)
    fields = _fields(data[:end]) if end > 0 else {}
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        return None
    first = end + len(_HEAD_END)
    last = first + int(fields["content-length"])
    if data[last : last + len(_HEAD_END)] != _HEAD_END:
        return None
    return fields, data[first:last], last + len(_HEAD_END)


def _plain_candidates(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    end = data.find(_HEAD_END)
    for found in re.finditer(re.escape(_PLAIN_MAGIC), data):
        start = found.start()
        if 0 <= end < start:  # else the head ends where an earlier one does; the file is searched once
            end = data.find(_HEAD_END, start)
        size = _fields(data[start:end]).get("content-length", "") if end > start else ""
        if re.fullmatch(r"\d{1,18}", size):
            record = parse_record(data[start : end + 2 * len(_HEAD_END) + int(size)])
            if record:
                yield start, start + record[2], record[0], record[1]


def _gzip_candidates(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    for found in re.finditer(re.escape(_GZIP_MAGIC), data):
        member = zlib.decompressobj(31)
        start = found.start()
        try:
            head = member.decompress(data[start : start + 4096], len(_PLAIN_MAGIC))
            if head != _PLAIN_MAGIC:
                continue
            rest, place = [head, member.decompress(member.unconsumed_tail)], start + 4096
            while not member.eof and place < len(data):
                rest.append(member.decompress(data[place : place + (1 << 16)]))
                place += 1 << 16
        except zlib.error:
            continue
        record = parse_record(b"".join(rest)) if member.eof else None
        if record and record[2] == sum(map(len, rest)):
            yield start, min(place, len(data)) - len(member.unused_data), record[0], record[1]


_MANIFEST = "file int, name string, n_bytes long, n_records long"
_CANDIDATE = (
    "file int, place long, after long, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def _writer(folder: str, compress: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = records = 0
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        first = next(rows, None)
        if first is None:
            return
        with new_file(folder, "archive", ".warc.gz" if compress else ".warc") as (name, out):
            row: tuple[pa.RecordBatch, int] | None = first
            while row is not None:
                page_id, url, html, refers_to = (row[0].column(c)[row[1]].as_py() for c in ("page_id", "url", "html", "refers_to"))
                record = to_record(page_id, url, (html or "").encode(), refers_to)
                if compress:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = packer.compress(record) + packer.flush()
                out.write(record)
                size += len(record)
                records += 1
                row = next(rows, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([size]), pa.array([records])],
            ["file", "name", "n_bytes", "n_records"],
        )

    return write


def mark_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads of pages that equal that of a page with a smaller page_id.

    Only digests are shuffled; the smallest page_id of each is a partial aggregate, so a payload that a third of all
    pages share is one row per task. ``pages`` has page_id, html and the html's digest.
    """
    marks = pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_payload).select("page_id", "digest")
    shared = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return marks.hint("merge").join(shared, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, compress: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives of about ``ARCHIVE_PAGE_BYTES`` of html; returns the manifest.

    The pages are shuffled once: by page_id and digest, which deals them to the archives and brings the marks to them.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).filter("page_id is not null")
    pages = pages.withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    n_bytes = pages.select(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    n_archives = 1 + n_bytes // ARCHIVE_PAGE_BYTES
    key = ["page_id", "digest"]
    marks = mark_revisits(pages, min_payload).repartition(n_archives, *key)
    dealt = pages.repartition(n_archives, *key).hint("merge").join(marks, key, "left")
    manifest = dealt.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder, compress), _MANIFEST)
    path = f"{folder}/_manifest"
    manifest.write.parquet(path)
    return pages.sparkSession.read.schema(manifest.schema).parquet(path)


def _scanner(keep_payload: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, content in zip(batch.column("file").to_pylist(), batch.column("name").to_pylist(), batch.column("content")):
                data = content.as_buffer().to_pybytes()
                find = _gzip_candidates if name.endswith(".gz") else _plain_candidates
                rows = []
                for place, after, fields, block in find(data):
                    rows.append((file, place, after, *_described(fields, block, keep_payload)))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _CANDIDATE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return scan


def _page_of(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", field or "")
    number = int(found[1]) if found else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def _described(fields: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    head, _, payload = block.partition(_HEAD_END)
    length = _fields(head).get("content-length", "")
    size = int(length) if re.fullmatch(r"\d{1,18}", length) else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = fields.get("warc-type")
    refers_to = _page_of(fields.get("warc-refers-to")) if kind == "revisit" else None
    return _page_of(fields.get("warc-record-id")), size, digest, kind, refers_to, payload if keep_payload else None


def chained(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, place) of the candidates on the chain from each file's start, by pointer jumping.

    One table of (file, place, to, real): after r rounds ``to`` is the candidate 2^r records further on, and real are all
    reachable records among the first 2^r of each file; so n records of a file take about log2(n) rounds. A round is
    written, and the one before deleted.
    """
    spark, folder = candidates.sparkSession, work_folder(candidates.sparkSession)

    def written(frame: DataFrame, number: int) -> DataFrame:
        frame.write.parquet(f"{folder}/round-{number}")
        if number:
            delete_folder(spark, f"{folder}/round-{number - 1}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/round-{number}")

    first = candidates.select("file", "place", F.col("after").alias("to"), (F.col("place") == 0).alias("real"))
    table = written(first.distinct(), 0)
    most = manifest.agg(F.max("n_records")).first()[0] or 0
    for number in range(1, max(0, int(most) - 1).bit_length() + 1):
        # Both sides grow with the archives, so neither is broadcast.
        ends = table.select("file", F.col("place").alias("to"), F.col("to").alias("next"))
        further = table.hint("merge").join(ends, ["file", "to"], "left").select("file", "place", F.col("next").alias("to"), "real")
        met = table.filter("real and to is not null").select("file", F.col("to").alias("place"), F.lit(True).alias("met"))
        table = further.hint("merge").join(met, ["file", "place"], "left")
        table = written(table.select("file", "place", "to", (F.col("real") | F.col("met").isNotNull()).alias("real")), number)
    return table.filter("real").select("file", "place")


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives, verified by their boundary chains; a broken chain raises."""
    found = read_files(manifest.select("file", "name"), folder, "").select("file", "name", "content")
    candidates = written_table(found.mapInArrow(_scanner(keep_payload), _CANDIDATE))
    real = chained(candidates, manifest)
    records = candidates.hint("merge").join(real, ["file", "place"])
    tails = records.groupBy("file").agg(F.max("after").alias("end"))
    broken = manifest.join(tails, "file", "left").filter("end is null or end <> n_bytes")
    if not broken.isEmpty():
        raise ValueError(f"the record chain does not end at the end of {broken.first()['name']}")
    return records


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_archives(manifest, folder, keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
