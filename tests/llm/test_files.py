"""Operators 1 and 6: exact round trips."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfcast.llm.encoding import Encoder
from shelfcast.llm.token_records import (
    frame_record, from_payload, read_record_at, read_records, read_token_records, to_payload, write_token_records,
)
from shelfcast.llm.warc import payload_digest, read_archives, to_record, write_archives
from shelfcast.session import work_folder
from tests.llm.corpus import empty, frame, rows, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't won't I'll 'sabc \"'s it's x'", "'re 've'll 'dog 5th 12", "a²b ½ x×y <|endoftext|> hi", "日本語 text", "İstanbul éa",
       "ÀÉß ſ ŉ ǆ", "a b\x0bc\x1cd", "é Å", "___--!!", "Hello, WORLD!! 3.14"]


def test_encoder_equals_the_library_on_whole_texts():
    plain = Tokenizer.from_file(PATH)
    own = Encoder(PATH)
    for _ in range(2):  # the second time from memory
        for text, ids in zip([*texts(), *ODD], own.encode([*texts(), *ODD])):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_records_and_index_round_trip_and_damage_is_seen():
    payloads = [to_payload(5, np.array([1, 2], np.uint32)), to_payload(None, np.array([70000], np.uint32)), to_payload(-1, np.zeros(0, np.uint32))]
    records = [frame_record(p) for p in payloads]
    data = b"".join(records)
    assert [bytes(p) for p in read_records(memoryview(data))] == payloads
    index = b"".join(np.array([sum(map(len, records[:i])), len(r)], "<u8").tobytes() for i, r in enumerate(records))
    assert [bytes(read_record_at(memoryview(data), index, i)) for i in (2, 0, 1)] == [payloads[2], payloads[0], payloads[1]]
    assert [(i, ids.tolist()) for i, ids in map(from_payload, map(memoryview, payloads))] == [(5, [1, 2]), (None, [70000]), (-1, [])]
    for k in range(len(data)):
        with pytest.raises(ValueError):
            list(read_records(memoryview(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])))
    with pytest.raises(ValueError):
        list(read_records(memoryview(data[:-1])))


def test_token_records_of_a_table(spark):
    plain = Tokenizer.from_file(PATH)
    folder = work_folder(spark)
    got = read_token_records(write_token_records(frame(spark), folder, PATH), folder).collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: r["start"]), want):
        ids = [*plain.encode(w[1] or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (w[0], start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    folder = work_folder(spark)
    assert read_token_records(write_token_records(empty(spark), folder, PATH), folder).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip_with_records_inside_payloads(spark, compress):
    inner = to_record(99, "http://x", b"inner", None).decode()
    pages = [(1, "http://a", f"<p>{inner}</p>"), (2, "http://b c", None), (3, None, "x"), (4, "http://d", "x"), (5, "", inner * 3),
             (6, "http://e", ""), (7, "http://f", "x"), (8, "http://g", "é" * 70000), (None, "http://h", "lost"), (3, None, "x")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, name string")
    folder = work_folder(spark)
    got = read_archives(write_archives(table, folder, compress=compress), folder).collect()
    first: dict = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    expected = []
    for page_id, _, html in pages:
        if page_id is not None:
            data, origin = (html or "").encode(), first[html or ""]
            own = page_id == origin
            expected.append((page_id, len(data), payload_digest(data), "response" if own else "revisit", None if own else origin, data if own else b""))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([(*[r[c] for c in columns], bytes(r["payload"])) for r in got], key=str) == sorted(expected, key=str)
    folder = work_folder(spark)
    assert read_archives(write_archives(table.limit(0), folder, compress=compress), folder).collect() == []


def test_small_payloads_are_no_revisits(spark):
    table = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    folder = work_folder(spark)
    got = read_archives(write_archives(table, folder, min_payload=5), folder).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("compress", [True, False])
def test_rows_of_one_page_id_and_long_urls(spark, compress):
    """Each row is judged by its own payload, and no head is too long to be read."""
    long = "http://" + "u" * 200_000
    pages = [(1, "a", "x"), (2, "a", "x"), (2, "a", "own"), (2, "b", "y"), (5, "c", "x"), (5, "c", "y"), (7, long, "z" * 300_000), (8, long, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = work_folder(spark)
    got = read_archives(write_archives(table, folder, compress=compress), folder).collect()
    kind = {"x": 1, "y": 2}
    want = []
    for page_id, _, html in pages:
        origin = kind.get(html, page_id)
        own = origin == page_id
        want.append((page_id, len(html or ""), payload_digest((html or "").encode()), None if own else origin, (html or "").encode() if own else b""))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"], bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def test_heads_without_an_end_are_no_records():
    from shelfcast.llm.warc import _plain_candidates

    junk = b"WARC/1.1\r\nWARC-Type: response\r\n" * 2000
    record = to_record(1, "u", b"WARC/1.1\r\n" * 3, None)
    assert [c[:2] for c in _plain_candidates(record + junk)] == [(0, len(record))]
    places = [c[:2] for c in _plain_candidates(junk + record)]
    assert places[-1] == (len(junk), len(junk) + len(record))
