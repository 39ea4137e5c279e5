"""Spelling variants against brute force, and the filter and hashes below them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from genesieve.llm import bloom, spelling
from genesieve.llm.common import U, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(word):
    return re.sub("[A-Z]", lambda m: m.group().lower(), word)


def expected(rows, least=7, ratio=10):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += len(w) >= least
    n = {w: c for w, c in seen.items() if c >= 2}
    meet = {}
    for w in n:
        for k in range(len(w)):
            meet.setdefault((k, w[:k] + w[k + 1 :], len(w)), []).append(w)
    near = {w: set() for w in n}
    for group in meet.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for k in range(len(w)):
            x = w[:k] + w[k + 1 :]
            if x in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def table(seed, words=60, docs=40):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 10))) for _ in range(words)]
    rows = []
    for i in range(docs):
        line = []
        for _ in range(150):
            w = base[min(int(rnd.expovariate(0.15)), words - 1)]
            if rnd.random() < 0.2:
                p, o = rnd.randrange(len(w)), rnd.randrange(3)
                w = w[:p] + ("" if o == 0 else rnd.choice("abcéÉÿZ")) + w[p + (o != 1) :]
            line.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, " ".join(line)))
    return rows


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_forms_roots_and_counts_match_brute_force(spark):
    rows = table(1) + [(900, None), (901, ""), (None, "abcabcabc abcabcabc abcabcab× abcabcab×"), (902, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 2999 + "y")]
    rows += rows[:5]
    # a chain of forms: each word a hundred times as frequent as the last
    for k, w in enumerate(["chainword", "chainwore", "chainwoie", "chaiiwoie"]):
        rows += [(2000 + k, f"{w} ")] * 0 + [(3000 + 100 * k + j, f"{w} {w}") for j in range(12 ** (3 - k) // 2 + 1)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = expected(rows)
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())
    assert got(spelling.spelling_variants(docs)) == want
    # a filter too small for the vocabulary is dealt into parts, with the same result
    assert got(spelling.spelling_variants(docs, filter_bits=2000)) == want


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling.spelling_variants(docs)) == expected(rows)


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "short words no")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_edit_hashes_follow_the_edited_word():
    words = ["abcdefg", "ééàbcdefghi", "zzzzzzz"]
    made = spelling.Edits(pa.array(words), 1)
    for i, w in enumerate(words):
        for k in range(len(w)):
            at = np.array([int(made.bounds[i]) + k])
            shorter = spelling.Edits(pa.array([w[:k] + w[k + 1 :]]), 1).words()
            assert made.deleted(at)[0] == shorter[0]
            other = spelling.Edits(pa.array([w[:k] + "q" + w[k + 1 :]]), 1).words()
            assert made.replaced(at, np.array([ord("q")]))[0] == other[0]


@pytest.mark.parametrize("count", [0, 5, 4000])
def test_filter_holds_all_keys_and_few_others(spark, count):
    keys = mix(np.arange(1, 2 * count + 1, dtype=U))
    shard = (np.arange(2 * count) % 3 + 7).astype(np.int64)
    rows = [(int(s), int(k)) for s, k in zip(shard[:count], keys[:count].view(np.int64))]
    layout = bloom.Layout.of(dict(Counter(s for s, _ in rows)))
    words = bloom.build(spark.createDataFrame(rows, "shard long, key long"), layout)
    assert layout.words == len(words)
    inside = bloom.holds(layout, words, shard[:count], keys[:count])
    assert sorted(inside.tolist()) == list(range(count))
    assert len(bloom.holds(layout, words, shard[count:], keys[count:])) <= 0.02 * count
    assert len(bloom.holds(layout, words, np.full(count, 50), keys[:count])) == 0
