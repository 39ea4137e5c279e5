"""Ids and decoded texts against the library, whole text by whole text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from genesieve.llm import pieces
from genesieve.llm.common import Texts

ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b ", "x\x00y", "\x00end", "a▁b", "▁", "▁▁a", " ▁ ", "é　 x", "</s> <s> <0x0A>", "﻿a",
    "𝄞 \U0010ffff", "a\n b\t c\r\n", " " * 40, "x" * 3000, "word " * 2000, "日本語のテキスト、空白なし" * 30, "▁▂", "â\u0096\u0081",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def check(library, values):
    model = pieces.pieces()
    texts = [(v or "").replace("▁", " ") for v in values]
    ids, bounds = model.encode(Texts(pa.array(texts, pa.string())))
    data, cut = model.decode(ids, bounds)
    for i, v in enumerate(values):
        want = library.encode(v or "", add_eos=True)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert data[cut[i] : cut[i + 1]].tobytes().decode() == library.decode(want)


def test_odd_texts(library):
    for _ in range(2):  # the second time from the table
        check(library, ODD)
    assert pieces.pieces().apart
    check(library, [])


@given(st.lists(st.text(st.one_of(st.sampled_from(list("ab ▁é\n日.")), st.characters(blacklist_categories=["Cs"])), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_texts(library, values):
    check(library, values)


def test_table_is_bounded_and_hashes_are_verified(library, monkeypatch):
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)
    monkeypatch.setattr(pieces, "pieces", lambda: model)
    rnd = random.Random(1)
    for _ in range(5):
        check(library, [" ".join(str(rnd.randrange(10**6)) for _ in range(30))])
    assert len(model._slot) < 200
    real = Texts.span_hash
    monkeypatch.setattr(Texts, "span_hash", lambda self, a, b, salt=0: real(self, a, b, salt) if salt else np.zeros(len(a), np.uint64))
    check(library, ["one two one three", "two"])


def test_ids_that_no_text_gave(library):
    model = pieces.pieces()
    rnd = random.Random(3)
    lists = [[], [2], [1, 400], [400, 2, 401], [3 + 0xC3, 400], [3 + 0xC3, 3 + 0xA9], [264, 0, 264], [3 + 0xA9], [264, 3 + 0xC3], [3 + 0xA9, 264]]
    lists += [[rnd.randrange(32000) for _ in range(rnd.randint(1, 6))] for _ in range(200)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    data, cut = model.decode(np.array([i for x in lists for i in x]), bounds)
    for k, x in enumerate(lists):
        assert data[cut[k] : cut[k + 1]].tobytes().decode() == library.decode(x), x


def test_query(spark, library):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in real.collect()] + [(9000 + i, v) for i, v in enumerate(ODD)] + [(9001, ""), (None, "no id")]
    docs = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], "doc_id long, text string, ids string, made int, read string")
    coded = pieces.decode(pieces.encode(docs, ids="out"), ids="out")
    assert coded.columns == ["doc_id", "text", "ids", "made", "read", "out", "decoded"]
    kept = coded.collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted((i or 0, t or "") for i, t in rows)
    for r in kept:
        want = library.encode(r.text or "", add_eos=True)
        assert r.out == want and r.decoded == library.decode(want) and (r.ids, r.made, r.read) == ("c", 1, "d")
    for r in pieces.digest(pieces.decode(pieces.encode(docs.select("doc_id", "text"), keep=False))).where("doc_id < 50").collect():
        want = library.encode(dict(rows)[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert pieces.decode(pieces.encode(docs.where("false"))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in pieces.decode(nulls).collect()) == [(1, None), (2, "")]
