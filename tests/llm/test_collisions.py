"""Texts that a polynomial hash modulo a power of two cannot tell apart, and rows that share ids."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from genesieve.llm import common, line_dedup, near_duplicates, packing, quality_rules, repeated_bytes
from genesieve.llm.common import ModularHash, Texts
from genesieve.llm.tokens import byte_bpe


def thue_morse(n, first="a"):
    text = first
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text[:n]


PAIRS = [(thue_morse(n), thue_morse(n, "b")) for n in (64, 1024, 2048, 4096)]


def test_hashes_tell_them_apart():
    texts = Texts(pa.array([t for pair in PAIRS for t in pair] * 2))
    start, end = texts.bounds[:-1], texts.bounds[1:]
    for made in (texts.span_hash(start, end), texts.span_hash(start, end, salt=1), ModularHash(texts.data).spans(start, end)):
        assert len(set(made.tolist())) == 8 and (made[:8] == made[8:]).all()
    assert set(texts.span_hash(start, end).tolist()).isdisjoint(texts.span_hash(start, end, salt=1).tolist())


def test_modular_products_and_deletions():
    rnd = np.random.default_rng(0)
    a, b = (rnd.integers(0, 2**61 - 1, 500, dtype=np.uint64) for _ in "ab")
    assert ModularHash.times(a, b).tolist() == [int(x) * int(y) % (2**61 - 1) for x, y in zip(a, b, strict=True)]
    text = "zéabcabcabc"
    made = ModularHash(Texts(pa.array([text])).data)
    size = len(text.encode())
    raw = text.encode()
    for cut in range(size):
        other = Texts(pa.array([b"xy" + raw[:cut] + raw[cut + 1 :]], pa.binary()))
        want = ModularHash(other.data).spans(np.array([2]), np.array([2 + size - 1]))
        got = made.without(np.array([0]), np.array([size]), np.array([cut]), np.array([cut + 1]))
        assert got[0] == want[0]


def test_rolling_hash_follows_content():
    data = np.frombuffer(b"abcdefgh" * 20 + b"x" + b"abcdefgh" * 20, np.uint8)
    for width in (1, 8, 32):
        made = common.rolling_hash(data, width)
        assert len(made) == len(data) - width + 1
        content = [data[i : i + width].tobytes() for i in range(len(made))]
        assert len(set(made.tolist())) == len(set(content)) == len(set(zip(made.tolist(), content, strict=True)))
    assert len(common.rolling_hash(data[:5], 32)) == 0


def test_tokens():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    values = [f"{x} {y} {x}" for x, y in PAIRS]
    for _ in range(2):
        ids, bounds = byte_bpe().encode(Texts(pa.array(values)))
        for i, v in enumerate(values):
            assert whole.encode(v, add_special_tokens=False).ids == ids[bounds[i] : bounds[i + 1]].tolist()


def test_tokens_of_words_with_one_hash(monkeypatch):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    real = Texts.span_hash
    monkeypatch.setattr(Texts, "span_hash", lambda self, a, b, salt=0: real(self, a, b, salt) if salt else np.zeros(len(a), np.uint64))
    ids, bounds = byte_bpe().encode(Texts(pa.array(["one two three", "same", "one"])))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [whole.encode(v).ids for v in ("one two three", "same", "one")]


def test_packing_ids(spark):
    import zlib

    x, y = PAIRS[1]
    docs = spark.createDataFrame([(1, f"{x} {y}"), (2, f"{y} {x}")], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    for i, text in ((1, f"{x} {y}"), (2, f"{y} {x}")):
        ids = byte_bpe()._encode_whole(text.encode()).tolist() + [0]
        for r in (r for r in got if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_different_shingles_are_no_duplicates(spark):
    x, y = PAIRS[1]
    docs = spark.createDataFrame([(1, f"{x} end"), (2, f"{y} end"), (3, f"{x} end")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs, width=2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_line_and_window_counts(spark):
    x, y = PAIRS[1]
    docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"a b {x} c a b {y} c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs, None).collect()}
    assert got == {1: (0, 0), 2: (0, 0)}


def test_unique_lines_stay(spark):
    for x, y in PAIRS:
        docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: x, 2: y, 3: ""}


def test_repeats_in_rows_that_share_an_id(spark):
    a, b = ("".join(chr(97 + (k * k * s + k) % 26) for k in range(300)) for s in (3, 7))
    a, b = (hashlib.sha512(t.encode()).hexdigest() * 3 for t in (a, b))
    a, b = "".join(hashlib.sha256(f"{a}{k}".encode()).hexdigest() for k in range(5)), "".join(hashlib.sha256(f"{b}{k}".encode()).hexdigest() for k in range(5))
    rows = [(1, a), (2, a), (2, b), (2, None), (5, b), (5, b), (None, b)]
    got = repeated_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter((r.doc_id, bytes(r.kept).decode()) for r in got)
    assert kept == Counter([(1, a), (2, ""), (2, b), (2, ""), (5, ""), (5, ""), (None, b)])
    # two texts of one id that begin alike: one of them keeps the shared passage
    both = spark.createDataFrame([(7, a + "x" * 40), (7, a + "y" * 40)], "doc_id long, text string")
    for hot in (2000, 1):
        removed = sorted(r.n_removed for r in repeated_bytes.remove_repeats(both, hot=hot).collect())
        assert removed == [0, len(a)]
