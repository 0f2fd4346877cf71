"""Operator 13 against the sentencepiece library: normal form, ids, spans and decoded text."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm.piece_spans import MODEL, Normalizer, PieceEncoder, encoded_pieces, piece_digests, piece_encoder
from tests.llm.corpus import SCHEMA, empty, frame, rows

PATH = public_tokenizers.path(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = "ａｂｃ ﬁ ①②  x　y  ｶﾞ ẛ̣ é é Ⅷ ½ ㍿ … ' ​­ é 한글 각 ﻿\ttab\r\nline  ｡  "


@st.composite
def odd_texts(draw):
    letters = st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" ▁\t\nabeé 123٣中文🙂\u0000" + ODD))
    return "".join(draw(st.lists(letters, max_size=40)))


@settings(max_examples=300, deadline=None)
@given(odd_texts())
def test_ids_and_text_equal_the_library(text):
    ids, begins, ends = piece_encoder(PATH).encode([text])[0]
    assert ids.tolist() == LIBRARY.encode(text)
    assert piece_encoder(PATH).decode([[*ids.tolist(), 2]])[0] == LIBRARY.decode(ids.tolist())
    assert (begins[1:] == ends[:-1]).all() and (not len(ids) or (begins[0] == 0 and ends[-1] == len(text.encode())))
    want = LIBRARY.encode(text, out_type="proto").pieces
    assert [(p.begin, p.end) for p in want] == list(zip(begins.tolist(), ends.tolist()))


def test_starting_anew_changes_nothing(monkeypatch):
    monkeypatch.setattr("shelfcast.llm.piece_spans.MAX_KNOWN", 3)
    encoder = PieceEncoder(PATH)
    for text in ["one two three four five", "six seven", "", "x" * 200 + " two", "one six"]:
        assert encoder.encode([text])[0][0].tolist() == LIBRARY.encode(text)


def test_spans_equal_the_library():
    for text in (ODD, "Hello wörld 🙂 x", " a  b", "▁▁ lead", "日本語 text 12345"):
        _, begins, ends = piece_encoder(PATH).encode([text])[0]
        want = LIBRARY.encode(text, out_type="proto").pieces
        assert [(p.begin, p.end) for p in want] == list(zip(begins.tolist(), ends.tolist()))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [(True, True), (False, True), (True, False), (False, False)])
def test_compiled_map_equals_the_library(rule, flags):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=flags[0], escape_whitespaces=True, remove_extra_whitespaces=flags[1])
    ours = Normalizer.of_model(library.serialized_model_proto())
    assert (ours.dummy_prefix, ours.drop_spaces) == flags
    random_ = random.Random(2)
    texts = [ODD, "", " ", "  ", "　 　", ODD + "   ", "plain words", "▁ x"]
    texts += ["".join(random_.choice(ODD) for _ in range(random_.randint(1, 30))) for _ in range(150)]
    for text in texts:
        want, places = library.normalize(text, with_offsets=True)
        data, origin = ours.normalise(text.encode())
        assert data.decode() == want, text
        chars = [0]
        for c in text:
            chars.append(chars[-1] + len(c.encode()))
        starts, at = [], 0
        for c in want:
            starts.append(at)
            at += len(c.encode())
        assert [chars[p] for p in places] == origin[[*starts, at]].tolist(), text


def test_digests_of_documents(spark):
    random_ = random.Random(4)
    data = [*rows(), (500, ODD * 50, None, None, 0, "x", 1, "y"), (501, "x" * 3000, None, None, 0, None, 1, None)]
    data += [(502, " ".join(random_.choice(["été", "Straße", "42", "▁", ""]) for _ in range(60_000)), None, None, 0, None, 1, None)]
    got = sorted(map(tuple, piece_digests(spark.createDataFrame(data, SCHEMA).repartition(3), PATH).drop("spans_crc32").collect()), key=str)
    want = []
    for doc_id, text, *_ in data:
        ids = LIBRARY.encode(text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIBRARY.decode(ids))]
        want.append((doc_id, len(ids), *sha))
    assert got == sorted(want, key=str)
    pieces = {r["doc_id"]: r for r in encoded_pieces(frame(spark), PATH).collect()}
    text = rows()[0][1]
    assert pieces[0]["decoded"] == text and len(pieces[0]["ids"]) == len(pieces[0]["ends"]) + 1
    assert pieces[0]["ends"][-1] == len(text.encode())
    assert piece_digests(empty(spark), PATH).collect() == [] and encoded_pieces(empty(spark), PATH).collect() == []
