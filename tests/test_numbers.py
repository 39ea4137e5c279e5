"""Ordered operators, significance and curves against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genesieve.operators import evaluation, features, significance, stats
from genesieve.operators.ordered import (
    Running, hashed_row_number, running, split_ranges, value_rank,
)


def hot_values(n=900):
    """A third of the rows share one value."""
    rng = np.random.default_rng(3)
    return [0.5 if i % 3 == 0 else float(np.round(rng.random(), 2)) for i in range(n)]


def test_running_totals(spark):
    values = hot_values()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    units = split_ranges(df.groupBy("v").agg(F.count("*").alias("c")), "v", 7)
    rows = running(
        units, "v",
        up=Running("sum", "c"), down=Running("sum", "c", descending=True),
        below=Running("sum", "c", inclusive=False), least=Running("min", "c", descending=True),
    ).collect()
    array = np.array(values)
    count = {v: values.count(v) for v in set(values)}
    assert len(rows) == len(count)
    for r in rows:
        assert r["up"] == (array <= r["v"]).sum()
        assert r["down"] == (array >= r["v"]).sum()
        assert r["below"] == (array < r["v"]).sum()
        assert r["least"] == min(c for v, c in count.items() if v >= r["v"])


def test_value_rank_spreads_ties(spark):
    values = hot_values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    rows = sorted(value_rank(df, "v", ["id"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(values) + 1))
    assert [r["v"] for r in rows] == sorted(values)


def test_row_numbers_are_contiguous_per_group(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, 1).otherwise(2))
    rows = hashed_row_number(df, ["id"], ["g"]).collect()
    for g, n in ((1, 400), (2, 100)):
        assert sorted(r["row_number"] for r in rows if r["g"] == g) == list(range(1, n + 1))


def test_p_value_lookup_edges(spark):
    simulated = spark.createDataFrame([("a", s) for s in (1.0, 2.0, 2.0, 3.0)], "score_type string, score double")
    null = significance.null_distribution(simulated)
    assert {r["score"]: r["p"] for r in null.collect()} == {1.0: 1.0, 2.0: 0.75, 3.0: 0.25}
    observed = spark.createDataFrame(
        [("a", s) for s in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)], "score_type string, score double"
    )
    found = {r["score"]: r["p"] for r in significance.lookup_p_values(observed, null).collect()}
    assert found == {0.5: 1.0, 1.0: 0.75, 1.5: 0.75, 2.0: 0.25, 2.5: 0.25, 3.0: 0.25, 3.5: 0.0}


def brute_bh(p):
    p = np.asarray(p)
    order = np.argsort(-p)
    ranks = np.arange(len(p), 0, -1)
    q = np.empty(len(p))
    q[order] = np.minimum(1, np.minimum.accumulate(len(p) / ranks * p[order]))
    return q


def test_bh_with_ties(spark):
    p = [round(v, 2) for v in hot_values(300)] + [0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    found = {r["p"]: r["q"] for r in significance.adjust_p_values(df).collect()}
    for value, q in zip(p, brute_bh(p)):
        assert found[value] == pytest.approx(q, abs=1e-12)
        assert found[value] >= value


def sklearn_like(labels, scores):
    """Cumulative counts at distinct thresholds, from the highest down."""
    tp, n, t = [], [], []
    for threshold in sorted(set(scores), reverse=True):
        hit = [y for y, s in zip(labels, scores) if s >= threshold]
        tp.append(sum(hit)), n.append(len(hit)), t.append(threshold)
    return np.array(tp, float), np.array(n, float), np.array(t)


@pytest.mark.parametrize("seed", range(4))
def test_curves_match_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.random(80), 1 if seed % 2 else 3).tolist()
    labels = (rng.random(80) < 0.3).astype(int).tolist()
    if seed == 3:
        scores[0], labels[0] = 2.0, 0  # the best score is a negative
    df = spark.createDataFrame(
        [("m", y, s) for y, s in zip(labels, scores)], "method string, label int, score double"
    )
    tp, n, t = sklearn_like(labels, scores)
    grid = np.linspace(0, 1, 100)
    stop = int(np.argmax(tp == tp[-1])) + 1
    recall = np.r_[0, tp[:stop] / tp[-1]]
    precision, threshold = np.r_[1, tp[:stop] / n[:stop]], np.r_[1.0, t[:stop]]
    rows = evaluation.pr_curve(df).orderBy("grid_index").collect()
    assert [r["precision"] for r in rows] == pytest.approx(np.interp(grid, recall, precision), abs=1e-9)
    assert [r["threshold"] for r in rows] == pytest.approx(np.interp(grid, recall, threshold), abs=1e-9)
    negatives = len(labels) - tp[-1]
    fpr, tpr = np.r_[0, (n - tp) / negatives], np.r_[0, tp / tp[-1]]
    roc = evaluation.roc_curve(df).orderBy("grid_index").collect()
    assert [r["tpr"] for r in roc] == pytest.approx(np.interp(grid, fpr, tpr), abs=1e-9)
    area = evaluation.area(evaluation.roc_curve(df), "fpr", "tpr", ["method"]).first()["auc"]
    assert area == pytest.approx(np.trapezoid(np.interp(grid, fpr, tpr), grid), abs=1e-9)


def test_quantiles(spark):
    values = hot_values()
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = stats.box_summary(df, "v", "g").first()
    expected = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
    assert [row[c] for c in stats.FIVE_NUMBERS] == pytest.approx(expected)


def test_entropy_of_one_and_uniform(spark):
    df = spark.createDataFrame([("one", 1)] * 4 + [("even", i) for i in range(4)], "g string, o int")
    rows = {r["g"]: r for r in stats.group_entropy(df, "g", "o").collect()}
    assert rows["one"]["entropy"] == pytest.approx(0)
    assert rows["even"]["entropy"] == pytest.approx(2)
    assert rows["even"]["pct_of_uniform"] == pytest.approx(1)


def test_ratio_features_add_up(spark):
    names = [*features.COUNT_COLUMNS, "non_silent_snv"]
    df = spark.createDataFrame(
        [("a", 3, 1, 1, 0, 6, 2, 1, 2, 2, 9), ("b", *[0] * 10)],
        "gene string, " + ", ".join(f"{c} long" for c in names),
    )
    rows = {r["gene"]: r for r in features.ratio_features(df).collect()}
    parts = ["silent", "nonsense", "splice_site", "missense", "frameshift_indel", "inframe_indel",
             "lost_start_and_stop"]
    assert sum(rows["a"][c] for c in parts) == pytest.approx(1)
    assert rows["a"]["recurrent_missense"] == pytest.approx(2 / 16)
    assert rows["a"]["missense_to_silent"] == pytest.approx(6 / 4)
    assert all(rows["b"][c] == 0 for c in parts)


def test_radix_selection_finds_every_rank(spark):
    rng = np.random.default_rng(5)
    values = {"a": [0.0, -0.0, 1e-300, -1e-300, 5e-324, float("inf"), float("-inf"), -2.5, -2.5, 1e308] + rng.normal(size=90).tolist(),
              "b": [3.0] * 40, "c": [-7.25]}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own] + [("a", None), ("d", None)], "g string, v double")
    wanted = spark.createDataFrame([(g, k) for g, own in values.items() for k in range(len(own))], "g string, rank bigint")
    got = {(r["g"], r["rank"]): r["value"] for r in stats.order_statistics(df, "v", ["g"], wanted).collect()}
    for g, own in values.items():
        assert [got[g, k] for k in range(len(own))] == sorted(own)
    whole = spark.createDataFrame([(2,)], "rank bigint")
    assert stats.order_statistics(df, "v", [], whole).collect()[0]["value"] == sorted(v for own in values.values() for v in own)[2]


def test_box_summary_sorts_nothing(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(50)], "g string, v double")
    row = {r["g"]: r for r in stats.box_summary(df, "v", "g").collect()}["a"]
    assert (row["minimum"], row["q1"], row["median"], row["q3"], row["maximum"]) == (0, 12.25, 24.5, 36.75, 49)


def test_density_error_stays_below_its_bound(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=400), rng.exponential(9, size=200), [250.0]])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    grid = [-3.0, 0.0, 0.3, 4.0, 60.0, 250.0, 900.0]
    h = values.std(ddof=1) * len(values) ** -0.2
    exact = [np.exp(-((x - values) / h) ** 2 / 2).sum() / (len(values) * h * np.sqrt(2 * np.pi)) for x in grid]
    for nodes in (16, stats.NODES_PER_WIDTH):
        got = {r["grid_index"]: r["density"] for r in stats.density(df, "v", "g", grid, nodes).collect()}
        for i, e in enumerate(exact):
            assert abs(got[i] - e) <= 1 / (8 * nodes**2) / (h * np.sqrt(2 * np.pi)) + 1e-15
    lone = {r["grid_index"]: r["density"] for r in stats.density(df.where("v = 250"), "v", "g", grid).collect()}
    assert all(v is None for v in lone.values())
    same = stats.density(spark.createDataFrame([("g", 1.0)] * 3, "g string, v double"), "v", "g", grid)
    assert all(r["density"] is None for r in same.collect())


def test_significance_in_the_row_equals_the_joins(spark):
    rng = np.random.default_rng(2)
    scores = ["x", "y"]
    simulated = spark.createDataFrame([(s, float(v)) for s in scores for v in rng.integers(0, 40, 300) / 40], "score_type string, score double")
    null = significance.null_distribution(simulated).cache()
    top = null.groupBy("score_type").agg(F.max("score").alias("m")).collect()[0]["m"]
    rows = [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 44, 200) / 40, rng.random(200)))]
    rows += [(900, None, float("nan")), (901, top, 0.0), (902, top + 1e-9, 5.0), (903, float("nan"), -1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    fast = {r["id"]: tuple(r) for r in significance.significance(df, null, scores).collect()}
    slow = {r["id"]: tuple(r[c] for c in ("id", "x", "y", "x_p", "x_q", "y_p", "y_q")) for r in significance._significance_by_join(df, null, scores).collect()}
    assert fast.keys() == slow.keys()
    for i, row in slow.items():
        assert repr(fast[i][:3]) == repr(row[:3]) and fast[i][3:] == pytest.approx(row[3:], nan_ok=True, abs=1e-12), i
    plan = significance.significance(df, null, scores)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
    none = null.where("score_type = 'z'")
    assert significance.significance(df, none, scores).count() == len(rows)
