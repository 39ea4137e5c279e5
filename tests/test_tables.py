"""Merging, labels, sampling, graphs and files on small fixtures."""

import itertools
import random
from collections import deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genesieve.functions import text
from genesieve.operators import graph, labels, merging, sampling
from genesieve.sources import files, tables


def test_not_in_is_null_aware(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "s string, x int")
    extra = spark.createDataFrame([("b", 3), ("c", 4), (None, 5)], "s string, x int")
    def appended(b):
        return sorted(r["x"] for r in merging.append_unseen(b, extra, "s").collect())
    assert appended(base) == [1, 2, 4]
    assert appended(base.unionAll(spark.createDataFrame([(None, 9)], "s string, x int"))) == [1, 2, 9]
    assert appended(base.filter("false")) == [3, 4, 5]


def test_source_priority_keeps_null_samples(spark):
    one = spark.createDataFrame([("a", 1), (None, 2)], "s string, x int")
    two = spark.createDataFrame([("a", 3), ("b", 4), (None, 5)], "s string, x int")
    rows = merging.prioritise_sources([one, two], "s").collect()
    assert sorted(r["x"] for r in rows) == [1, 2, 4, 5]


def test_hypermutator_limit_is_strict(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)], "s string")
    assert [r["s"] for r in merging.drop_hypermutators(df, "s", 3).collect()] == ["b", "b"]


def test_class_guard(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(17)], "label int")
    with pytest.raises(ValueError):
        labels.check_classes(df)
    labels.check_classes(df.unionAll(df))


def test_strict_recode_fails_on_unknown(spark):
    df = spark.createDataFrame([("x",)], "c string")
    with pytest.raises(Exception, match="unknown category"):
        df.select(text.recode(F.col("c"), {"y": "z"}, strict=True)).collect()


def test_folds_are_balanced_and_complete(spark):
    df = spark.createDataFrame([(f"g{i}", 0 if i % 5 else 1 + i % 2) for i in range(237)], "key string, label int")
    rows = sampling.stratified_folds(df, "key", folds=10, repeats=3).collect()
    assert len(rows) == 237 * 3
    assert len({(r["key"], r["iteration"]) for r in rows}) == 237 * 3
    for iteration, label in itertools.product((1, 2, 3), (0, 1, 2)):
        sizes = [
            sum(r["iteration"] == iteration and r["label"] == label and r["fold"] == f for r in rows)
            for f in range(1, 11)
        ]
        assert max(sizes) - min(sizes) <= 1
    by_key = {r["key"]: r["fold"] for r in rows if r["iteration"] == 1}
    assert by_key != {r["key"]: r["fold"] for r in rows if r["iteration"] == 2}


def test_permutation_is_a_joint_bijection(spark):
    df = spark.createDataFrame([(f"g{i}", i, i * 2) for i in range(50)], "key string, a int, b int")
    rows = sampling.permute_columns(df, "key", ["a", "b"], 3).collect()
    assert sorted(r["a"] for r in rows) == list(range(50))
    assert all(r["b"] == 2 * r["a"] for r in rows)
    assert any(r["key"] != f"g{r['a']}" for r in rows)


def test_bootstrap_sizes(spark):
    df = spark.createDataFrame([(f"g{i}", 0 if i < 60 else 1 + i % 2) for i in range(100)], "key string, label int")
    draws = sampling.stratified_bootstrap(df, "key", trees=3, block=8)
    totals = {(r["tree"], r["label"]): r["n"] for r in draws.groupBy("tree", "label").agg(F.sum("draws").alias("n")).collect()}
    assert totals == {(t, c): n for t in (1, 2, 3) for c, n in ((0, 28), (1, 14), (2, 14))}


def test_bootstrap_draws_stay_on_the_executors(spark):
    """In a plan the draws look like the few rows they come from, small enough to be broadcast."""
    df = spark.createDataFrame([(f"g{i}", i % 3) for i in range(30)], "key string, label int")
    plan = sampling.stratified_bootstrap(df, "key", trees=3)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [label" in plan and "BroadcastHashJoin [label" not in plan.split("hashpartitioning(label")[0]


def brute_betweenness(edges):
    nodes = sorted({n for e in edges for n in e})
    near = {n: {b for e in edges for b in e if n in e and b != n} for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, dist, sigma = [], {s: 0}, {s: 1.0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) if n > 2 else v for k, v in score.items()}


GRAPHS = {
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "star": [("x", c) for c in "abcde"],
    "cycle": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")],
    "mixed": [("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("p", "q"), ("z", "z")],
}


def hanging(seed):
    """Two rings that share a node, a lone edge, a tree, and trees hanging from all of them."""
    rnd = random.Random(seed)
    edges = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [(f"s{i}", f"s{(i + 1) % 4}") for i in range(4)] + [("r0", "s0"), ("r2", "r5")]
    edges += [("k0", "k1"), ("t0", "t1")]
    for i in range(30):
        ends = sorted({n for e in edges for n in e})
        edges.append((rnd.choice(ends), f"h{i}"))
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_pendant_trees_are_folded(spark, seed):
    edges = graph.simple_edges(spark.createDataFrame(hanging(seed), "u string, v string"), "u", "v")
    expected = brute_betweenness([tuple({*e}) for e in hanging(seed)])
    for batches, whole_core in ((None, 1000), (3, 0 if seed == 1 else 1000)):
        found = {r["node"]: r["betweenness"] for r in graph.node_betweenness(edges, batches, whole_core).collect()}
        assert found == pytest.approx(expected)


def blocky(seed):
    """Random clumps that share nodes or hang together by bridges, in two components."""
    rnd = random.Random(seed)
    edges = []
    for side in "lr":
        nodes = [f"{side}0"]
        for clump in range(6):
            start = rnd.choice(nodes)
            fresh = [f"{side}{clump}{k}" for k in range(rnd.randint(1, 5))]
            ring = [start, *fresh]
            edges += [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]
            edges += [tuple(rnd.sample(ring, 2)) for _ in range(rnd.randint(0, 2))]
            nodes += fresh
    return edges


def biconnected(edges):
    """Blocks as sets of edges: two edges are in one if no single node parts them."""
    edges = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    group = {e: {e} for e in edges}
    together = {(a, b) for a in edges for b in edges if a < b and set(a) & set(b)}
    for a, b in together:
        cut = (set(a) & set(b)).pop()
        one, = set(a) - {cut}
        seen, queue = {one}, [one]
        while queue:
            v = queue.pop()
            for e in edges:
                if v in e and cut not in e:
                    w = e[0] if e[1] == v else e[1]
                    if w not in seen:
                        seen.add(w)
                        queue.append(w)
        if (set(b) - {cut}).pop() in seen and group[a] is not group[b]:
            merged = group[a] | group[b]
            for e in merged:
                group[e] = merged
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("seed", [3])
def test_cores_are_taken_apart_into_blocks(spark, seed):
    pairs = blocky(seed)
    edges = graph.simple_edges(spark.createDataFrame(pairs, "u string, v string"), "u", "v")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    both = both.union(both.select("next", "node")).filter("node <> next")
    core = both.select("node").distinct().select("node", F.lit(1).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("squares"))
    members, links = graph._blocks(core, both)
    found = {}
    for r in links.collect():
        found.setdefault(r["block"], set()).add(tuple(sorted((r["node"], r["next"]))))
    assert {frozenset(g) for g in found.values()} == biconnected(pairs)
    sums = members.groupBy("block").agg(F.sum("weight").alias("s"), F.max("total").alias("t"))
    assert all(r["s"] == r["t"] for r in sums.collect())
    got = {r["node"]: r["betweenness"] for r in graph.node_betweenness(edges, whole_core=0).collect()}
    assert got == pytest.approx(brute_betweenness([tuple({*e}) if len({*e}) == 2 else e for e in pairs]), abs=1e-12)


def ringed(seed, longest=8):
    """Hubs in a ring, rings and clumps that hang from them, one between two hubs, one alone, and tails."""
    rnd = random.Random(seed)
    edges = [(f"h{i}", f"h{(i + 1) % 5}") for i in range(5)] + [("h0", "x0"), ("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("x2", "h3")]
    for r in range(32):
        ring = [f"{'' if r < 31 else 'alone'}{r}.{k}" for k in range(longest if r == 0 else rnd.randint(3, 6))]
        edges += [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]
        if r < 31:
            edges += [(ring[0], f"h{r % 5}")] + [(ring[2], f"h{r % 5}")] * (r % 3 == 0) + [(ring[0], ring[2])] * (r % 4 == 0)
        if r % 7 == 0:
            edges += [(ring[1], f"t{r}"), (f"t{r}", f"u{r}")]
    return edges


def test_small_pieces_are_folded(spark, monkeypatch):
    """A ring of many nodes, once a written table or more for each of its levels."""
    pairs, written, settle = ringed(5, longest=70), [], graph.settle
    edges = graph.simple_edges(spark.createDataFrame(pairs, "u string, v string"), "u", "v")
    monkeypatch.setattr(graph, "settle", lambda df: written.append(1) or settle(df))
    found = {r["node"]: r["betweenness"] for r in graph.node_betweenness(edges, whole_core=10).collect()}
    assert found == pytest.approx(brute_betweenness(pairs), abs=1e-12)
    assert len(written) < 110


def test_large_pieces_stay(spark):
    pairs = ringed(6)
    edges = graph.simple_edges(spark.createDataFrame(pairs, "u string, v string"), "u", "v")
    found = {r["node"]: r["betweenness"] for r in graph.node_betweenness(edges, whole_core=10, piece_steps=70).collect()}
    assert found == pytest.approx(brute_betweenness(pairs), abs=1e-12)


def test_piles_of_pieces_are_searched_a_few_at_a_time(monkeypatch):
    rnd, rows, expected = random.Random(7), [], {}
    for piece in range(20):
        size = rnd.randint(1, 9)
        inside = {tuple(sorted(rnd.sample(range(size), 2))) for _ in range(3 * size) if size > 1} | {(i, i + 1) for i in range(size - 1)}
        hub = rnd.random() < 0.7
        ends = [*inside, *((i, size) for i in range(size) if hub and (i == 0 or rnd.random() < 0.4))]
        if not ends:
            continue
        # the hub's own nodes hang from it as leaves
        rest = rnd.randint(1, 4) if hub else 0
        score = brute_betweenness([*ends, *((size, size + k) for k in range(1, rest))])
        nodes = len(score)
        for i in range(size):
            expected[100 * piece + i] = score[i] * ((nodes - 1) * (nodes - 2) if nodes > 2 else 1)
        for a, b in ends:
            rows += [(piece, 100 * piece + a, 1, 100 * piece + b, rest)] + [(piece, 100 * piece + b, 1, 100 * piece + a, rest)] * (b < size)
    rnd.shuffle(rows)
    table = pa.table(dict(zip(("piece", "node", "weight", "next", "rest"), map(list, zip(*rows, strict=True)), strict=True)))
    for steps in (graph.PIECE_STEPS, 60):
        monkeypatch.setattr(graph, "PIECE_STEPS", steps)
        found = graph._search_pile(table).to_pydict()
        got = {k: v for k, v in zip(found["node"], found["delta"], strict=True) if k in expected}
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("name", GRAPHS)
def test_graphs(spark, name):
    df = spark.createDataFrame([*GRAPHS[name], ("a", None)], "u string, v string")
    edges = graph.simple_edges(df, "u", "v")
    expected = brute_betweenness([tuple(set(e)) if e[0] != e[1] else e for e in GRAPHS[name]])
    for batches in (1, 2) if name == "mixed" else (1,):
        found = {r["node"]: r["betweenness"] for r in graph.node_betweenness(edges, batches).collect()}
        assert found == pytest.approx(expected)
    if name == "mixed":
        degree = {r["node"]: r["degree"] for r in graph.node_degree(edges).collect()}
        assert degree == {"a": 1, "b": 5, "c": 2, "d": 3, "e": 1, "p": 1, "q": 1, "z": 2}


def test_keyed_files_skip_preamble_and_isoforms(spark, tmp_path):
    for letter, name, rows in (("T", "TP53", 3), ("T", "TP53_ENST0001", 2), ("0-9", "9A", 1)):
        (tmp_path / letter).mkdir(exist_ok=True)
        lines = [f"head {i}" for i in range(8)] + [f"{name} {i}" for i in range(rows)]
        (tmp_path / letter / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "T" / "notes.txt").write_text("x\n" * 20)
    rows = files.read_keyed_files(spark, str(tmp_path), preamble=8, glob="*.tsv").collect()
    assert sorted(tuple(r) for r in rows) == [("9A", "9A 0")] + [("TP53", f"TP53 {i}") for i in range(3)]


def test_sequence_lengths_and_value_lists(spark, tmp_path):
    (tmp_path / "p53_protein.txt").write_text(">p53\nMEEP\nQSD\n")
    (tmp_path / "p53_ENST01_protein.txt").write_text(">x\nMM\n")
    assert [tuple(r) for r in files.sequence_lengths(spark, str(tmp_path)).collect()] == [("p53", 7)]
    banned = tmp_path / "banned"
    banned.write_bytes(b"#note\r\n587226\r\n TCGA-1 \r\n")
    values = files.read_value_list(spark, str(banned), comments=True).collect()
    assert sorted(r["value"] for r in values) == ["587226", "TCGA-1"]


def test_replacing_a_table_by_a_part_of_itself(spark):
    first = tables.replace_table(spark.range(10).toDF("x"), "genesieve_test")
    tables.replace_table(first.filter("x < 3"), "genesieve_test")
    assert spark.table("genesieve_test").count() == 3
