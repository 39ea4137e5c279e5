"""Divergence of sources against brute force over whole tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from genesieve.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= min_docs:
            kept[lang].append(t)

    def shares(count, lang):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(counts[g], g[0]) for g in groups}
    q = {lang: shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang) for lang, _ in groups}
    out = []
    for lang, source in groups:
        listed = [(-sum(abs(p[lang, source][t] - p[lang, o][t]) for t in kept[lang]), o.encode(), "pair") for li, o in groups if li == lang and o != source]
        terms = [(q[lang][t] - p[lang, source][t], t.encode(), "term") for t in kept[lang] if counts[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part in (sorted(listed), sorted(terms)[:top]):
            out += [(lang, source, kind, item.decode(), -v, k + 1) for k, (v, item, kind) in enumerate(part)]
    return sorted(out)


def table(seed, n=300):
    rnd = random.Random(seed)
    words = ["Été", "ß", "word", "WORD", "日本", "a_b", "x1y", " "] + ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = [(" ".join(rnd.choice(words[: rnd.randint(5, 68)]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, "en"]), rnd.choice(["a", "b", "É", "z", None, "a"])) for _ in range(n)]
    rows += [(None, "en", "nothing"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("alone", "yy", "only")]
    return rows + rows[:7]


@pytest.mark.parametrize("block,ordered", [(50_000, 16), (7, 1)])
def test_matches_brute_force(spark, monkeypatch, block, ordered):
    monkeypatch.setattr(source_divergence, "BLOCK_ROWS", block)
    monkeypatch.setattr(source_divergence, "ORDERED_BY", ordered)
    rows = table(2)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n int, term string")
    got = source_divergence.divergence(docs, min_docs=5, top=9).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, 5, 9)


def test_without_kept_terms_and_rows(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergence.divergence(docs).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence.divergence(docs.where("false")).collect() == []


def test_shares_are_exact():
    for n, whole, terms in [([0, 7, 10**6], 10**7, 13), ([0, 3 * 10**15], 3 * 10**15, 10), ([10**17], 10**18, 10**9)]:
        got = source_divergence.share(np.array(n), whole, terms)
        assert got.tolist() == [1 + 10**9 * (x + 5) // (whole + 5 * terms) for x in n]


def test_runs_meet_at_their_bounds():
    rnd = random.Random(5)
    for _ in range(50):
        n = rnd.randint(1, 30)
        a, b = (np.array([rnd.randrange(3) for _ in range(n)]) for _ in "ab")
        times = np.array([rnd.randint(1, 9) for _ in range(n)])
        until = np.concatenate([[0], np.cumsum(times)])
        runs = [(source_divergence.encode(c), c[source_divergence.encode(c)]) for c in (a, b)]
        assert source_divergence.run_sum(*runs, until) == (abs(a - b) * times).sum()
