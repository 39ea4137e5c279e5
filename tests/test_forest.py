"""Forests against a grower that tries every split one by one, and votes against a walk down each tree."""

import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from genesieve.functions.numbered_md5 import numbered_md5
from genesieve.operators import forest

FEATURES = ["a", "b", "c", "d", "e"]
SMALL = forest.ForestSettings(trees=4, max_depth=6, max_bins=8, seed=3)


def table(spark, n=160, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = rnd.choice([0, 0, 1, 2])
        values = [rnd.choice([0.0, 1.5, 2.0, 7.25]), rnd.gauss(label, 1), float(label == 1) + rnd.random(), 4.0, rnd.gauss(0, 1)]
        rows.append((f"k{i}", label, *[None if rnd.random() < 0.03 else math.nan if rnd.random() < 0.02 else v for v in values]))
    return spark.createDataFrame(rows, "gene string, label int, a double, b double, c double, d double, e double")


def brute_tree(rows, sizes, seed, tree, settings, node=1, out=None):
    """``rows``: (bins, label, draws); exact search over every cut of every tried feature."""
    out = {} if out is None else out

    def weights(part):
        return [sum(d for _, c, d in part if c == k) / sizes[k] if sizes[k] else 0.0 for k in range(3)]

    def impurity(part):
        w = weights(part)
        return (w[0] * w[0] + w[1] * w[1] + w[2] * w[2]) / (w[0] + w[1] + w[2])

    w, own = weights(rows), impurity(rows)
    best = None
    if len({c for _, c, _ in rows}) > 1 and node.bit_length() - 1 < settings.max_depth:
        tried = forest.draw_features(seed, tree, np.array([node]), len(rows[0][0]), settings.tried(len(rows[0][0])))[0]
        for f in tried.tolist():
            for cut in sorted({b[f] for b, _, _ in rows})[:-1]:
                left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
                score = impurity(left) + impurity(right)
                if score > own * forest.BETTER and (best is None or score > best[0]):
                    best = (score, f, cut, left, right)
    kind = w.index(max(w))
    draws = sum(d for _, _, d in rows)
    if best is None:
        out[tree, node] = (None, None, kind, 0.0, draws)
    else:
        score, f, cut, left, right = best
        out[tree, node] = (f, cut, kind, score - own, draws)
        brute_tree(left, sizes, seed, tree, settings, 2 * node, out)
        brute_tree(right, sizes, seed, tree, settings, 2 * node + 1, out)
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_levels_and_subtrees_equal_brute_force(spark, plain):
    settings = forest.ForestSettings(**{**SMALL.__dict__, "plain": plain})
    df = table(spark).cache()
    edges = forest.bin_edges(df, FEATURES, settings.max_bins)
    assert len(edges[3]) == 1 and all(len(e) < 8 for e in edges)
    rows = forest.binned(df, FEATURES, edges)
    for r in rows.collect():
        for value, edge, b in zip(r[2:7], edges, r["bins"], strict=True):
            missing = value is None or math.isnan(value)
            assert (b is None or b > len(edge)) if missing else b == sum(x <= value for x in edge)
    df = df.na.fill(9.0).cache()
    edges = forest.bin_edges(df, FEATURES, settings.max_bins)
    rows = forest.binned(df, FEATURES, edges)
    members = df.select(F.lit(0).alias("iteration"), F.lit(0).alias("fold"), "gene", "label")
    sample = forest.draw_samples(members, "gene", "label", settings).join(rows.select("gene", "bins"), "gene").cache()
    want = {}
    for t in range(1, settings.trees + 1):
        own = sample.where(F.col("tree") == t).collect()
        sizes = [own[0][f"s{c}"] for c in range(3)]
        brute_tree([(r["bins"], r["label"], r["draws"]) for r in own], sizes, settings.seed, t, settings, out=want)
    assert len(want) > 60
    for limit in (0, 25, 10**6):  # level by level, half and half, in one group per tree
        grown = forest.grow(sample, len(FEATURES), forest.ForestSettings(**{**settings.__dict__, "subtree_rows": limit}))
        got = {(r["tree"], r["node"]): (r["feature"], r["bin"], r["class"], r["gain"], r["draws"]) for r in grown.collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k][:3] == w[:3] and got[k][4] == w[4] and got[k][3] == pytest.approx(w[3], abs=1e-12)


def test_samples_follow_class_sizes(spark):
    df = table(spark)
    members = df.select(F.lit(2).alias("iteration"), F.lit(5).alias("fold"), "gene", "label")
    drawn = forest.draw_samples(members, "gene", "label", SMALL).collect()
    n = {c: sum(r["label"] == c for r in df.collect()) for c in range(3)}
    sizes = {1: int(0.7 * n[1]), 2: int(0.7 * n[2]), 0: int(0.7 * n[1] + 0.7 * n[2])}
    for t in range(1, 5):
        for c in range(3):
            assert sum(r["draws"] for r in drawn if r["tree"] == t and r["label"] == c) == sizes[c]
    assert {(r["s0"], r["s1"], r["s2"]) for r in drawn} == {(sizes[0], sizes[1], sizes[2])}
    assert len({frozenset(r["gene"] for r in drawn if r["tree"] == t) for t in range(1, 5)}) == 4


def test_mixing_agrees_in_both_places(spark):
    rows = spark.createDataFrame([(t, n) for t in (1, 7, 200) for n in (1, 2, 2**30 + 5)], "tree int, node bigint")
    for r in rows.select("tree", "node", forest.tried_features(F.lit(475), 24, 4).alias("f")).collect():
        assert r["f"] == forest.draw_features(475, r["tree"], np.array([r["node"]]), 24, 4)[0].tolist()


def test_votes_walk_every_tree(spark, tmp_path):
    df = table(spark).cache()
    filled = df.na.fill(9.0)
    path = forest.train_forest(filled, "gene", FEATURES, str(tmp_path / "forest"), SMALL)
    nodes = {(r["tree"], r["node"]): r for r in forest.read_nodes(spark, path).collect()}
    wide = df.withColumns({"row": F.lit("x"), "i": F.lit(1), "values": F.lit(2)})  # names used inside
    got = {r["gene"]: r for r in forest.score_forest(wide, FEATURES, path).collect()}
    assert len(got) == df.count() and set(next(iter(got.values())).asDict()) == {*wide.columns, "oncogene_score", "tsg_score"}
    for r in df.collect():
        votes = []
        for t in range(1, 5):
            n = 1
            while nodes[t, n]["feature"] is not None:
                x = r[FEATURES[nodes[t, n]["feature"]]]
                n = 2 * n + (0 if x is not None and not math.isnan(x) and x < nodes[t, n]["threshold"] else 1)
            votes.append(nodes[t, n]["class"])
        assert (got[r["gene"]]["oncogene_score"], got[r["gene"]]["tsg_score"]) == (votes.count(1) / 4, votes.count(2) / 4)
    split = forest.score_models(df.withColumns({"iteration": F.lit(0), "fold": F.lit(0)}), FEATURES, forest.read_nodes(spark, path), rows_per_part=9)
    assert {r["gene"]: r["tsg_score"] for r in split.collect()} == {g: r["tsg_score"] for g, r in got.items()}
    assert forest.score_forest(df.where("false"), FEATURES, path).collect() == []


def test_bank_holds_rows_out_and_importance_sums_gains(spark, tmp_path):
    df = table(spark).na.fill(9.0).cache()
    path = str(tmp_path / "bank")
    folds = forest.train_bank(df, "gene", FEATURES, path, SMALL, folds=3, repeats=2)
    nodes = forest.read_nodes(spark, path).cache()
    assert nodes.select("iteration", "fold").distinct().count() == 6
    # every model equals one grown alone on the rows outside its fold, with its own seed
    outside = df.join(folds.where("iteration = 2 AND fold = 3").select("gene"), "gene", "left_anti")
    settings = forest.ForestSettings(**{**SMALL.__dict__, "seed": SMALL.seed + 203})
    members = outside.select(F.lit(0).alias("iteration"), F.lit(0).alias("fold"), "gene", "label")
    sample = forest.draw_samples(members, "gene", "label", settings)
    sample = sample.join(forest.binned(df, FEATURES, forest.bin_edges(df, FEATURES, 8)).select("gene", "bins"), "gene")
    alone = forest.grow(sample, len(FEATURES), settings).select("tree", "node", "feature", "class", "draws").collect()
    assert sorted(map(tuple, alone), key=repr) == sorted(
        map(tuple, nodes.where("iteration = 2 AND fold = 3").select("tree", "node", "feature", "class", "draws").collect()), key=repr)
    taken = {(r["iteration"], r["fold"], r["feature"]): r["importance"] for r in forest.importance(nodes, FEATURES).collect()}
    assert len(taken) == 6 * len(FEATURES) and all(taken[i, j, "d"] == 0 for i in (1, 2) for j in (1, 2, 3))
    for (i, j, f), value in taken.items():
        own = [r["gain"] for r in nodes.where(f"iteration = {i} AND fold = {j} AND feature = {FEATURES.index(f)}").collect()]
        assert value == pytest.approx(sum(own) / SMALL.trees)
    summary = {r["feature"]: r for r in forest.importance_summary(forest.importance(nodes, FEATURES).where("fold = 3")).collect()}
    two = [taken[i, 3, "b"] for i in (1, 2)]
    assert summary["b"]["mean_importance"] == pytest.approx(sum(two) / 2)
    assert summary["b"]["std_importance"] == pytest.approx(abs(two[0] - two[1]) / math.sqrt(2))
    new = df.limit(5).withColumn("gene", F.concat(F.lit("new"), "gene"))
    assert forest.score_bank(new, "gene", FEATURES, path, 2).count() == 5


@pytest.mark.parametrize("plain", [False, True])
def test_whole_trees_equal_trees_of_samples(spark, tmp_path, monkeypatch, plain):
    """Draws made beside the trees equal those of the samples, also for keys that repeat or are null."""
    settings = forest.ForestSettings(**{**SMALL.__dict__, "plain": plain})
    df = table(spark, 60).na.fill(9.0, FEATURES)
    df = df.unionByName(df.limit(9)).unionByName(df.limit(2).withColumn("gene", F.lit(None).cast("string"))).cache()
    found = []
    for whole in (forest.WHOLE_BYTES, 0):
        monkeypatch.setattr(forest, "WHOLE_BYTES", whole)
        path = forest.train_forest(df, "gene", FEATURES, str(tmp_path / f"{plain}{whole}"), settings)
        rows = forest.read_nodes(spark, path).withColumn("gain", F.round("gain", 9)).collect()
        found.append(sorted(map(tuple, rows), key=repr))
        if whole:  # a tree is one row, so scoring moves trees and not nodes
            assert forest.read_trees(spark, path).count() == settings.trees
    assert found[0] == found[1] and len(found[0]) > 4 * settings.trees


@pytest.mark.parametrize("head", [b"", b"71|1|0|", b"123456|200|2|", b"x" * 48, b"x" * 51, b"x" * 60])
def test_numbered_md5_equals_one_by_one(head):
    """Also for texts of more than one block, and where the number gets a digit more."""
    for first, last in ((0, 13_000), (5, 7), (3, 3), (9_990, 22_001), (1_234_567, 1_237_000), (998_000, 1_003_000)):
        want = [int.from_bytes(md5(head + b"%d" % d).digest()[:4], "big") for d in range(first, last)]
        assert numbered_md5(head, first, last).tolist() == want


@pytest.mark.parametrize("draws_at_most", [3, 10**6])
def test_counted_and_sorted_cuts_equal_brute_force(monkeypatch, draws_at_most):
    """However many rows are split at once, by whichever way, and with counts too large for one number."""
    rnd = np.random.default_rng(4)
    n, features, settings = 700, 5, forest.ForestSettings(max_depth=9, seed=3)
    bins, label = rnd.integers(0, 12, (n, features)).astype(np.uint8), rnd.integers(0, 3, n)
    draws = rnd.integers(1, draws_at_most + 1, n)
    sizes = np.bincount(label, weights=draws, minlength=3).astype(np.int64)
    want = brute_tree([(b.tolist(), int(c), int(d)) for b, c, d in zip(bins, label, draws, strict=True)], sizes.tolist(), 3, 7, settings)
    for rows_at_once, many, long in ((40, 1, 10**9), (10**6, 0, 1), (200, 10**9, 1), (32_768, 4, 1_200)):
        for name, value in (("ROWS_AT_ONCE", rows_at_once), ("MANY_ROWS", many), ("LONG_ROWS", long)):
            monkeypatch.setattr(forest, name, value)
        made = forest.grow_subtree(bins, label, draws, sizes, 3, 7, 1, settings.tried(features), 9)
        got = {(7, int(r[0])): (None if r[1] < 0 else r[1], None if r[1] < 0 else r[2], r[3], r[5]) for r in zip(*made, strict=True)}
        assert got == {k: (*w[:3], w[4]) for k, w in want.items()}
        assert all(g == pytest.approx(want[7, int(node)][3], abs=1e-12) for node, g in zip(made[0], made[4], strict=True))


def test_votes_in_batches_of_nodes(spark, tmp_path, monkeypatch):
    df = table(spark).cache()
    path = forest.train_forest(df.na.fill(9.0), "gene", FEATURES, str(tmp_path / "forest"), SMALL)
    asked = ("gene", "oncogene_score", "tsg_score")
    want = sorted(map(tuple, forest.score_forest(df, FEATURES, path).select(*asked).collect()))
    for name, value in (("ROUTED_NODES", 30), ("ROUTED_AT_ONCE", 7)):
        monkeypatch.setattr(forest, name, value)
    assert sorted(map(tuple, forest.score_forest(df, FEATURES, path).select(*asked).collect())) == want


def test_a_bank_packs_rows_once_per_repeat(spark):
    """And not once for every model that learns from them."""
    df = table(spark, 90).na.fill(9.0, FEATURES).cache()
    rows = forest.binned(df, FEATURES, forest.bin_edges(df, FEATURES, 8)).select("gene", "bins")
    held = df.selectExpr("explode(array(1, 2)) AS iteration", "1 + pmod(hash(gene), 10) AS fold", "gene", "label")
    packed = forest._packed(held, rows, "gene", "label", range(1, 11), 81, len(FEATURES), SMALL).collect()
    assert sum(len(r["flags"]) for r in packed) == 2 * 90
    assert sum(len(r["bins"]) for r in packed) == 2 * 90 * len(FEATURES)
