"""Functions of tasks, held against brute force without Spark."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genesieve.llm import bwt, packing, repeated_bytes, top_k
from genesieve.llm.common import Texts, slices
from genesieve.llm.line_dedup import _lines
from genesieve.llm.near_duplicates import shingle_sets
from genesieve.llm.text_statistics import Words, features, symbols
from genesieve.llm.tokens import byte_bpe

WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", " ", "\n\n", "a", "a b a b a b", "é É x\n\né É x", "x" * 500, "a\tb\x0bc\rd", None, "#|<>&%$* \n a\n a", "ab" * 40 + " "]
ALPHABET = st.sampled_from(list("abAB é\n\t#|1.　"))


def texts(values):
    return Texts(pa.array(values, pa.string()))


def counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(set(words)),
    )


@given(st.lists(st.text(ALPHABET, max_size=60), max_size=5))
@settings(max_examples=80, deadline=None)
def test_statistics_match_brute_force(values):
    values = values + ODD
    t = texts(values)
    w = Words(t)
    got = zip(w.counts(), w.code_points(), symbols(t), w.lines()[1], w.repeated(), w.distinct(), strict=True)
    assert [tuple(int(x) for x in g) for g in got] == [counts(v) for v in values]
    assert np.isfinite(features(t)).all()


def test_statistics_of_nothing():
    assert features(texts([])).shape[0] == 0
    assert [len(b) for b in slices(iter([pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]), "t")] == []


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles_match_sets(width):
    values = [v for v in ODD if v is not None] + ["A b C d e f g", "a B c D E F G"]
    sets, bounds = shingle_sets(texts(values), width)
    found = [frozenset(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    lower = [re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), v)) for v in values]
    expected = [
        frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        for w in lower
    ]
    assert list(map(len, found)) == list(map(len, expected))
    for a in range(len(values)):
        for b in range(len(values)):
            assert len(found[a] & found[b]) == len(expected[a] & expected[b])


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    values = [v or "" for v in ODD] + [
        "a  b", "a \n b", "x\n\n a", "a ", " a", "it's  we'll <|endoftext|> x", "é\t \tq 12 a1!? \r\n z", "a　 b",
        "  lead", "a' s", "don 't do", "one two " * 50,
    ]
    for _ in range(2):  # the second time from the cache
        ids, bounds = byte_bpe().encode(texts(values))
        for i, v in enumerate(values):
            assert whole.encode(v, add_special_tokens=False).ids == ids[bounds[i] : bounds[i + 1]].tolist()


@given(st.lists(st.text(st.sampled_from("ab\n"), max_size=9), max_size=5))
@settings(max_examples=60, deadline=None)
def test_lines_match_split(values):
    t = texts(values)
    got = [(bytes(t.data[a:b]).decode(), int(i), int(k)) for a, b, i, k in zip(*_lines(t), strict=True)]
    assert got == [(line, i, k) for i, v in enumerate(values) for k, line in enumerate(v.split("\n"))]


def test_merged_transform_sorts_all_suffixes():
    rnd = random.Random(5)
    strings = [[rnd.randint(1, 3) for _ in range(rnd.randint(1, 9))] for _ in range(12)]
    flat = np.array([x for s in strings for x in s])
    shards, at, base = [], 0, 0
    for part in (strings[:4], strings[4:5], strings[5:]):
        sizes = [len(s) for s in part]
        n = sum(sizes)
        following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        following[ends] = -1 - np.arange(len(part))
        previous[np.append(0, ends[:-1] + 1)] = -1
        made = bwt.transform(flat[base : base + n], following, previous, ends)
        shards.append(bwt.Transform(made.before, np.where(made.place >= 0, made.place + base, -1), made.strings))
        base += n
        at += len(part)
    where, same = bwt.merge(shards, 20)
    suffix = [tuple(s[i:]) + (0,) for s in strings for i in range(len(s))]
    got = [suffix[i] for i in where]
    assert got == sorted(got) and len(got) == len(suffix)
    where, same = bwt.merge(shards, 2)
    for a, b, x, y in zip(where[:-1], where[1:], same[:-1], same[1:], strict=True):
        full = len(suffix[a]) > 2 and len(suffix[b]) > 2
        assert (x == y) == (full and suffix[a][:2] == suffix[b][:2])


def test_repeated_windows_match_brute_force():
    rnd = random.Random(1)
    for t in range(30):
        base = [bytes(rnd.choice(b"ab") if t % 2 else rnd.randrange(97, 123) for _ in range(rnd.randint(100, 260))) for _ in range(3)]
        strings = []
        for _ in range(rnd.randint(0, 25)):
            b = rnd.choice(base)[rnd.randrange(40) :]
            if rnd.random() < 0.5:
                p = rnd.randrange(len(b))
                b = b[:p] + b"#" + b[p:]
            strings.append(b"z" * rnd.randint(90, 400) if rnd.random() < 0.1 else b)
        at = np.array([[rnd.randrange(4), rnd.randrange(1000)] for _ in strings]).reshape(-1, 2)
        seen = {}
        for i, s in enumerate(strings):
            for k in range(len(s) - 99):
                here = (at[i][0], at[i][1] + k)
                seen[s[k : k + 100]] = min(seen.get(s[k : k + 100], here), here)
        expected = sorted(
            (i, k) for i, s in enumerate(strings) for k in range(len(s) - 99) if seen[s[k : k + 100]] < (at[i][0], at[i][1] + k)
        )
        which, offset = repeated_bytes.repeated_windows(pa.array(strings, pa.binary()), at, rnd.choice([1, 2, 4]))
        assert sorted(zip(which.tolist(), offset.tolist(), strict=True)) == expected


@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["residual_norm", "dot_product"]), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_packing_holds_every_capacity(lengths, select, documents):
    capacity = packing.Capacity(tokens=100, documents=documents, attention=100 * 100 if documents % 2 else 10_000, select=select)
    lengths = np.array(lengths, dtype=np.int64)
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in set(sequence.tolist()):
        rows = np.flatnonzero(sequence == s)
        rows = rows[np.argsort(offset[rows])]
        assert lengths[rows].sum() <= 100 and len(rows) <= documents and (lengths[rows] ** 2).sum() <= capacity.attention
        assert offset[rows].tolist() == (np.cumsum(lengths[rows]) - lengths[rows]).tolist()


def test_packing_fills_sequences():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 2049, 4000)
    sequence, _ = packing.best_fit(lengths)
    assert len(set(sequence.tolist())) <= 1.02 * math.ceil(lengths.sum() / 2048)
    tight = packing.Capacity(attention=2048 * 512)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2048]), tight)


def test_pruned_search_is_exact():
    rnd = np.random.default_rng(0)
    vectors = np.floor(rnd.normal(size=(900, 12)) * rnd.gamma(2, 40, size=(900, 1)))
    vectors[500:520] = vectors[3]
    ids = rnd.permutation(900)
    axes = np.linalg.svd(vectors, full_matrices=False)[2].T
    q = vectors[:40]
    best = top_k.search(q, ids[:40], np.full(40, -np.inf), vectors, ids, axes, k=5, leading=4, chunk=64)
    for i in range(40):
        scores = sorted(((-(q[i] @ vectors[j]), ids[j]) for j in range(900) if ids[j] != ids[i]))[:5]
        assert [(-s, n) for s, n in zip(best.score[i], best.id[i], strict=True)] == scores


def brute_force(q, query_ids, vectors, ids, k=5):
    scores = [[int(s) for s in row] for row in q.astype(object) @ vectors.astype(object).T]
    pairs = [sorted((-s, n) for s, n in zip(row, ids.tolist(), strict=True) if n != i) for row, i in zip(scores, query_ids, strict=True)]
    return [[(-s, n) for s, n in found[:k]] for found in pairs]


def held(best):
    return [[(s, n) for s, n in zip(*row, strict=True) if s != top_k.NONE] for row in zip(best.score.tolist(), best.id.tolist(), strict=True)]


def test_few_products_among_vectors_without_direction(monkeypatch):
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(3000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int64)
    ids, q = np.arange(3000), vectors[::50]
    axes = np.linalg.svd(vectors.astype(float), full_matrices=False)[2].T
    made, products = [], top_k.products
    monkeypatch.setattr(top_k, "products", lambda a, b, about: made.append(len(a)) or products(a, b, about))
    best = top_k.search(q, ids[::50], np.full(60, -np.inf), vectors, ids, axes)
    assert held(best) == brute_force(q, ids[::50], vectors, ids)
    assert sum(made) < 0.05 * len(q) * len(vectors)


@pytest.mark.parametrize("scale", [1, 10**7])
def test_search_of_any_signs_and_lengths(monkeypatch, scale):
    monkeypatch.setattr(top_k, "SLAB", 16)
    rnd = np.random.default_rng(6)
    vectors = np.floor(-np.abs(rnd.normal(size=(700, 24))) * rnd.gamma(0.3, 20, size=(700, 1)) * scale).astype(np.int64)
    vectors[40:60], vectors[100:140], vectors[300:330] = 0, vectors[7], -vectors[300:330]
    ids = rnd.permutation(700)
    axes = np.linalg.svd(vectors.astype(float), full_matrices=False)[2].T
    for about in (vectors, -vectors):  # all scores of most queries are negative
        q = about[:130]
        exact = brute_force(q, ids[:130], vectors, ids)
        assert held(top_k.search(q, ids[:130], np.full(130, -np.inf), vectors, ids, axes, chunk=64)) == exact
        floors = np.array([float(row[2][0]) for row in exact])
        best = top_k.search(q, ids[:130], floors, vectors, ids, axes, leading=3, chunk=64)
        assert [row[:3] for row in held(best)] == [row[:3] for row in exact]
