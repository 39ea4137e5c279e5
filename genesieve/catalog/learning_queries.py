"""Folds and samples, graphs, rules, and forests."""

import dataclasses
import os

from pyspark.sql import functions as F

from ..operators import evaluation, forest, graph, rules, sampling, significance
from ..session import scratch_path, settle
from .base import LABELS, bind, plain, query, rounded
from .feature_queries import MATRIX, MATRIX_COLUMNS, NETWORK, SUMMARY, matrix, summary
from .forest_sql import training, votes

FOLD_SQL = f"""
  entity AS ({plain(LABELS)}),
  repeated AS (SELECT gene, label, CAST(i AS INT) AS iteration FROM entity, range(1, 6) r(i)),
  folds AS (
    SELECT gene, label, iteration, CAST(ntile(10) OVER (PARTITION BY iteration, label
      ORDER BY md5(gene || '|0|' || CAST(iteration AS VARCHAR)), gene) AS INT) AS fold FROM repeated)
"""


def _folds(spark, sf_dir):
    return sampling.stratified_folds(bind(spark, sf_dir, LABELS), "gene", folds=10, repeats=5)


@query("stratified_folds", f"WITH {FOLD_SQL} SELECT gene, label, iteration, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


ALL_GENES = "SELECT DISTINCT 'G' || CAST(l_partkey * 2 AS STRING) AS gene FROM {lineitem}"


@query(
    "route_to_fold",
    f"""
    WITH {FOLD_SQL}, wanted AS (SELECT gene, CAST(i AS INT) AS iteration FROM ({plain(ALL_GENES)}) a, range(1, 6) r(i))
    SELECT w.gene, w.iteration, coalesce(fold, 1) AS fold FROM wanted w LEFT JOIN folds f ON w.gene = f.gene AND w.iteration = f.iteration
    """,
)
def route_to_fold(spark, sf_dir):
    return sampling.route_to_fold(bind(spark, sf_dir, ALL_GENES), "gene", _folds(spark, sf_dir), 5)


@query(
    "permute_columns",
    f"""
    WITH x AS ({plain(NETWORK)}),
    target AS (SELECT gene, row_number() OVER (ORDER BY md5(gene), gene) AS i FROM x),
    donor AS (SELECT gene_betweeness, gene_degree, row_number() OVER (ORDER BY md5(gene || '|7'), gene) AS i FROM x)
    SELECT gene, gene_betweeness, gene_degree FROM target JOIN donor USING (i)
    """,
)
def permute_columns(spark, sf_dir):
    return sampling.permute_columns(
        bind(spark, sf_dir, NETWORK), "gene", ["gene_betweeness", "gene_degree"], seed=7
    )


@query(
    "stratified_bootstrap",
    f"""
    WITH entity AS ({plain(LABELS)}), n AS (SELECT label, count(*) AS n FROM entity GROUP BY label),
    s AS (SELECT label, n, CAST(floor(CASE WHEN label = 0 THEN (SELECT sum(n * 0.7::DOUBLE) FROM n WHERE label <> 0) ELSE n * 0.7::DOUBLE END) AS BIGINT) AS s FROM n),
    d AS (SELECT label, n, tree, unnest(range(0, s)) AS draw FROM s, range(1, 201) r(tree)),
    h AS (SELECT tree, label, n, md5('0|' || CAST(tree AS VARCHAR) || '|' || CAST(label AS VARCHAR) || '|' || CAST(draw AS VARCHAR)) AS h FROM d),
    c AS (SELECT tree, label, CAST(floor(('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE * n) AS BIGINT) + 1 AS i, count(*) AS draws FROM h GROUP BY ALL),
    m AS (SELECT gene, label, row_number() OVER (PARTITION BY label ORDER BY md5(gene), gene) AS i FROM entity)
    SELECT CAST(tree AS INT) AS tree, gene, label, draws FROM c JOIN m USING (label, i)
    """,
)
def stratified_bootstrap(spark, sf_dir):
    return sampling.stratified_bootstrap(bind(spark, sf_dir, LABELS), "gene", trees=200)


EDGES = """
SELECT CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) ELSE 'C' || CAST(o_custkey AS STRING) END AS first,
  'S' || CAST(l_suppkey AS STRING) AS second
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""


@query(
    "node_degree",
    f"""
    WITH e AS (SELECT DISTINCT least(first, second) AS a, greatest(first, second) AS b FROM ({plain(EDGES)}) x WHERE first IS NOT NULL AND second IS NOT NULL)
    SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) n GROUP BY node
    """,
)
def node_degree(spark, sf_dir):
    return graph.node_degree(graph.simple_edges(bind(spark, sf_dir, EDGES), "first", "second"))


# Parts hang from their brands; brands, types and words of names occur together.
WORD_EDGES = """
SELECT 'P' || CAST(p_partkey AS STRING) AS first, p_brand AS second FROM {part}
UNION ALL SELECT p_brand, p_type FROM {part}
UNION ALL SELECT p_type, split_part(p_name, ' ', 1) FROM {part}
UNION ALL SELECT split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM {part}
UNION ALL SELECT p_brand, CAST(NULL AS STRING) FROM {part}
"""
_DEPTH = 8  # levels of the search in SQL; the graph's diameter is smaller


def _betweenness_sql() -> str:
    """Shortest paths level by level, then the share of each pair's paths over a node."""
    text = f"""
    WITH e AS (SELECT DISTINCT least(first, second) AS a, greatest(first, second) AS b FROM ({plain(WORD_EDGES)}) x
      WHERE first IS NOT NULL AND second IS NOT NULL),
    n AS (SELECT a AS v FROM e UNION SELECT b FROM e),
    adj AS (SELECT a AS v, b AS w FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b),
    r0 AS (SELECT v AS s, v, 0 AS d, 1::DOUBLE AS paths FROM n)"""
    for k in range(_DEPTH):
        text += f""",
    r{k + 1} AS (SELECT * FROM r{k} UNION ALL
      SELECT s, w, {k + 1}, sum(paths) FROM r{k} JOIN adj USING (v)
      WHERE d = {k} AND NOT EXISTS (SELECT 1 FROM r{k} o WHERE o.s = r{k}.s AND o.v = adj.w) GROUP BY s, w)"""
    return text + f""",
    inner_ AS (SELECT v FROM adj GROUP BY v HAVING count(*) > 1),
    b AS (SELECT x.v, sum(x.paths * y.paths / z.paths) AS total
      FROM r{_DEPTH} z JOIN (SELECT * FROM r{_DEPTH} SEMI JOIN inner_ USING (v)) x ON x.s = z.s JOIN r{_DEPTH} y ON y.s = x.v AND y.v = z.v
      WHERE x.d + y.d = z.d AND x.v <> z.s AND x.v <> z.v GROUP BY x.v)
    SELECT n.v AS node, round(coalesce(total, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 9) AS betweenness
    FROM n LEFT JOIN b ON b.v = n.v
    """


@query("node_betweenness", _betweenness_sql())
def node_betweenness(spark, sf_dir):
    edges = graph.simple_edges(bind(spark, sf_dir, WORD_EDGES), "first", "second")
    return rounded(graph.node_betweenness(edges), "betweenness", digits=9)


# Orders hang from customers, customers and suppliers from nations, nations from regions.
TREE_EDGES = """
SELECT 'O' || CAST(o_orderkey AS STRING) AS first, 'C' || CAST(o_custkey AS STRING) AS second FROM {orders}
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING) FROM {customer}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING) FROM {nation}
"""


@query(
    "node_betweenness_tree",
    f"""
    WITH RECURSIVE up AS (SELECT DISTINCT first AS node, second AS parent FROM ({plain(TREE_EDGES)}) e),
    n AS (SELECT node FROM up UNION SELECT parent FROM up),
    walk AS (SELECT node, node AS above FROM n UNION ALL SELECT w.node, u.parent FROM walk w JOIN up u ON u.node = w.above),
    size AS (SELECT above AS node, count(*) AS s FROM walk GROUP BY above),
    root AS (SELECT w.node, w.above AS top FROM walk w WHERE w.above NOT IN (SELECT node FROM up)),
    below AS (SELECT u.parent AS node, sum(s * s) AS q FROM up u JOIN size USING (node) GROUP BY u.parent),
    total AS (SELECT count(*) AS c FROM n)
    SELECT node, round((2.0::DOUBLE * (z.s - 1) * (t.s - z.s) + (z.s - 1) * (z.s - 1) - coalesce(q, 0)) / (c - 1) / (c - 2), 12) AS betweenness
    FROM size z JOIN root USING (node) JOIN size t ON t.node = top LEFT JOIN below USING (node), total
    """,
)
def node_betweenness_tree(spark, sf_dir):
    """All orders, customers, suppliers, nations and regions: a graph that grows with the tables."""
    edges = graph.simple_edges(bind(spark, sf_dir, TREE_EDGES), "first", "second")
    return rounded(graph.node_betweenness(edges), "betweenness", digits=12)


# A customer's orders follow each other and begin and end at the customer: a ring, hanging like the customer.
RING_EDGES = """
SELECT 'O' || CAST(o_orderkey AS STRING) AS first, coalesce(
  'O' || CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING), 'C' || CAST(o_custkey AS STRING)) AS second FROM {orders}
UNION ALL SELECT 'O' || CAST(max(o_orderkey) AS STRING), 'C' || CAST(o_custkey AS STRING) FROM {orders} GROUP BY o_custkey
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING) FROM {customer}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING) FROM {nation}
"""


@query(
    "node_betweenness_rings",
    """
    WITH cust AS (
      SELECT c_custkey AS c, c_nationkey AS n, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    supp AS (SELECT s_nationkey AS n, count(*) AS m FROM supplier GROUP BY ALL),
    nat AS (
      SELECT n_nationkey AS n, n_regionkey AS r, 1 + coalesce(any_value(m), 0) + coalesce(sum(1 + k), 0) AS s,
        coalesce(any_value(m), 0) + coalesce(sum((1 + k) * (1 + k)), 0) AS q
      FROM nation LEFT JOIN cust ON cust.n = n_nationkey LEFT JOIN supp ON supp.n = n_nationkey GROUP BY ALL),
    reg AS (SELECT r, 1 + sum(s) AS w, sum(s * s) AS q FROM nat GROUP BY r),
    total AS (SELECT sum(w)::DOUBLE AS c FROM reg),
    home AS (SELECT c, k, w FROM cust JOIN nat USING (n) JOIN reg USING (r)),
    ring AS (
      SELECT c, 0 AS i, 'C' || c AS node, (w - k)::DOUBLE AS w, k + 1 AS l FROM home
      UNION ALL SELECT c, row_number() OVER (PARTITION BY c ORDER BY o_orderkey), 'O' || o_orderkey, 1, k + 1 FROM orders JOIN home ON c = o_custkey),
    apart AS (SELECT a.c, a.i, b.i AS j, a.w * b.w AS w, a.l, least(abs(a.i - b.i), a.l - abs(a.i - b.i)) AS d FROM ring a JOIN ring b ON a.c = b.c AND a.i <> b.i),
    inner_ AS (
      SELECT x.c, x.j AS i, sum(z.w / CASE WHEN 2 * z.d = z.l THEN 2 ELSE 1 END) AS delta
      FROM apart x JOIN apart y ON x.c = y.c AND x.j = y.i JOIN apart z ON z.c = x.c AND z.i = x.i AND z.j = y.j
      WHERE x.d + y.d = z.d GROUP BY ALL),
    found AS (
      SELECT node, coalesce(delta, 0) + CASE WHEN i = 0 THEN 2.0::DOUBLE * k * (home.w - 1 - k) ELSE 0 END AS b
      FROM ring JOIN home USING (c) LEFT JOIN inner_ USING (c, i)
      UNION ALL SELECT 'S' || s_suppkey, 0 FROM supplier
      UNION ALL SELECT 'N' || n, (w - 1)::DOUBLE * (w - 1) - nat.q - (w - s)::DOUBLE * (w - s) FROM nat JOIN reg USING (r)
      UNION ALL SELECT 'R' || r, (w - 1)::DOUBLE * (w - 1) - q FROM reg)
    SELECT node, round(b / (c - 1) / (c - 2), 12) AS betweenness FROM found, total
    """,
)
def node_betweenness_rings(spark, sf_dir):
    """A core that grows with the tables and falls apart into one block for each customer."""
    edges = graph.simple_edges(bind(spark, sf_dir, RING_EDGES), "first", "second")
    return rounded(graph.node_betweenness(edges), "betweenness", digits=12)


_RULE_COUNTS = """
  SELECT gene, recurrent_missense AS recurrent, nonsense + lost_stop + lost_start + splice_site + frameshift_indel AS deleterious,
    silent + nonsense + lost_stop + lost_start + missense + splice_site + inframe_indel + frameshift_indel AS total FROM summary
"""


def _published(r: str, d: str, factor: str) -> str:
    return f"""CASE WHEN {r} >= 0.2 AND {r} * total >= 10 * {factor}
        THEN CASE WHEN {d} <= 0.05 THEN 'oncogene' WHEN {d} * total >= 7 * {factor} THEN 'tsg' ELSE 'other' END
      WHEN {d} >= 0.2 AND {d} * total >= 7 * {factor} THEN 'tsg' ELSE 'other' END"""


@query(
    "ratio_rule",
    f"""
    WITH {SUMMARY}, c AS ({_RULE_COUNTS}),
    x AS (SELECT *, recurrent / nullif(total, 0) AS r, deleterious / nullif(total, 0) AS d, (SELECT sum(total) FROM c) / 404863.0::DOUBLE AS f FROM c)
    SELECT gene, CASE WHEN total < 5 THEN 'other' ELSE {_published("r", "d", "1")} END AS published,
      CASE WHEN total < 5 THEN 'other' ELSE {_published("r", "d", "f")} END AS scaled,
      {_published("r", "d", "1")} AS from_fractions,
      CASE WHEN total < 5 THEN 'other' WHEN r >= 0.2 THEN CASE WHEN r >= d THEN 'oncogene' ELSE 'tsg' END WHEN d >= 0.2 THEN 'tsg' ELSE 'other' END AS minimum
    FROM x
    """,
)
def ratio_rule(spark, sf_dir):
    deleterious = ["nonsense", "lost_stop", "lost_start", "splice_site", "frameshift_indel"]
    rest = ["silent", "missense", "inframe_indel"]
    counts = settle(
        summary(spark, sf_dir).select(
            "gene", F.col("recurrent_missense").alias("recurrent"),
            sum(F.col(c) for c in deleterious).alias("deleterious"),
            sum(F.col(c) for c in deleterious + rest).alias("total"),
        )
    )
    args = ("recurrent", "deleterious", "total")
    df = rules.ratio_rule(counts, *args, minimum_total=5, output="published")
    df = rules.ratio_rule(df, *args, minimum_total=5, scale_to=404863, output="scaled")
    df = rules.ratio_rule(df, *args, variant="minimum", minimum_total=5, output="minimum")
    total = F.nullif(F.col("total"), F.lit(0))
    df = df.withColumns({"r": F.col("recurrent") / total, "d": F.col("deleterious") / total})
    df = rules.ratio_rule(df, "r", "d", "total", as_fraction=True, output="from_fractions")
    return df.select("gene", "published", "scaled", "from_fractions", "minimum")


@query(
    "baseline_majority",
    f"""
    WITH {FOLD_SQL},
    pairs AS (SELECT DISTINCT iteration, fold FROM folds),
    train AS (SELECT p.iteration, p.fold, f.label, count(*) AS n FROM pairs p JOIN folds f ON f.iteration = p.iteration AND f.fold <> p.fold GROUP BY ALL),
    best AS (SELECT iteration, fold, label AS predicted FROM train QUALIFY row_number() OVER (PARTITION BY iteration, fold ORDER BY n DESC, label) = 1)
    SELECT gene, label, iteration, fold, predicted, CASE WHEN predicted = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS oncogene_score,
      CASE WHEN predicted = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS tsg_score
    FROM folds JOIN best USING (iteration, fold)
    """,
)
def baseline_majority(spark, sf_dir):
    return rules.majority_baseline(settle(_folds(spark, sf_dir)), "gene")


BAYES_COUNTS = ["recurrent_missense", "nonsense", "missense", "silent", "inframe_indel", "frameshift_indel",
                "lost_stop", "splice_site"]
_TRAIN = "CAST(substr(gene, 2) AS BIGINT) % 2 = 0"


@query(
    "naive_bayes",
    f"""
    WITH {SUMMARY}, x AS (SELECT s.*, l.label FROM summary s JOIN ({plain(LABELS)}) l USING (gene)),
    t AS (SELECT * FROM x WHERE {_TRAIN}),
    m AS (SELECT label, count(*) / (SELECT count(*) FROM t) AS prior, {" + ".join(f"sum({c})" for c in BAYES_COUNTS)} AS total,
      {", ".join(f"sum({c}) AS s_{c}" for c in BAYES_COUNTS)} FROM t GROUP BY label),
    j AS (SELECT x.gene, m.label AS class, ln(prior) + {" + ".join(f"x.{c} * ln((s_{c} + 1) / (total + {len(BAYES_COUNTS)}))" for c in BAYES_COUNTS)} AS joint FROM x, m),
    p AS (SELECT gene, class, joint, exp(joint - max(joint) OVER (PARTITION BY gene)) AS e FROM j)
    SELECT gene, arg_max(class, joint) AS predicted, round(sum(e) FILTER (class = 0) / sum(e), 6) AS other_probability,
      round(sum(e) FILTER (class = 1) / sum(e), 6) AS oncogene_probability, round(sum(e) FILTER (class = 2) / sum(e), 6) AS tsg_probability
    FROM p GROUP BY gene
    """,
)
def naive_bayes(spark, sf_dir):
    counts = summary(spark, sf_dir).select("gene", *BAYES_COUNTS)
    rows = settle(counts.join(bind(spark, sf_dir, LABELS).select("gene", "label"), "gene"))
    scored = rules.naive_bayes(rows.filter(_TRAIN), rows, BAYES_COUNTS)
    names = ["other_probability", "oncogene_probability", "tsg_probability"]
    return rounded(
        scored.select("gene", "predicted", *[F.col("probabilities")[i].alias(n) for i, n in enumerate(names)]),
        *names,
    )


# Forests with the settings of the operators, on the whole matrix.
SETTINGS = forest.ForestSettings()
FOLDS, REPEATS = 10, 5
_trained_models: dict[tuple, tuple] = {}


def _labelled(spark, sf_dir):
    labels = bind(spark, sf_dir, LABELS).select("gene", "label")
    return settle(rounded(matrix(spark, sf_dir), *MATRIX_COLUMNS, digits=9).join(labels, "gene"))


def _trained(spark, sf_dir, kind: str, train):
    """The model folder and the labelled matrix.

    Trained once per data set and session; later queries reuse the saved models.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _trained_models:
        labelled, path = _labelled(spark, sf_dir), scratch_path(spark, kind)
        train(labelled, path)
        _trained_models[key] = (path, labelled)
    return _trained_models[key]


def _forest(spark, sf_dir):
    return _trained(
        spark, sf_dir, "forest",
        lambda df, path: forest.train_forest(df, "gene", MATRIX_COLUMNS, path, SETTINGS),
    )


def _bank(spark, sf_dir):
    return _trained(
        spark, sf_dir, "bank",
        lambda df, path: forest.train_bank(
            df, "gene", MATRIX_COLUMNS, path, SETTINGS, folds=FOLDS, repeats=REPEATS
        ),
    )


_MATRIX_SQL = f"""
  SELECT gene, label, {", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM joined)), 9) AS {c}" for c in MATRIX_COLUMNS)}
  FROM joined JOIN ({plain(LABELS)}) l USING (gene)"""
_ONE = f"WITH RECURSIVE {MATRIX}, {training(_MATRIX_SQL, MATRIX_COLUMNS, 'SELECT 0 AS iteration, 0 AS fold, gene, label FROM x', SETTINGS)}"
_CALLS_SQL = """oncogene_score, tsg_score, 1 - (oncogene_score + tsg_score) AS other_score, 1 - (1 - (oncogene_score + tsg_score)) AS driver_score"""
_MAJORITY_SQL = """CASE WHEN other_score >= oncogene_score AND other_score >= tsg_score THEN 0 WHEN oncogene_score >= tsg_score THEN 1 ELSE 2 END AS majority_class"""


@query(
    "rf_train",
    f"""{_ONE} SELECT CAST(tree AS INT) AS tree, node, feature, round(threshold, 9) AS threshold, class, round(gain, 9) AS gain, draws FROM nodes""",
)
def rf_train(spark, sf_dir):
    """Every node of a forest of 200 trees."""
    path, _ = _forest(spark, sf_dir)
    nodes = forest.read_nodes(spark, path).select("tree", "node", "feature", "threshold", "class", "gain", "draws")
    return rounded(nodes, "threshold", "gain", digits=9)


@query(
    "rf_score",
    f"""{_ONE}, {votes("SELECT gene, 0 AS iteration, 0 AS fold, v FROM x")},
    calls AS (SELECT gene, {_CALLS_SQL} FROM scored)
    SELECT gene, label, oncogene_score, tsg_score, driver_score, {_MAJORITY_SQL} FROM calls JOIN x USING (gene)""",
)
def rf_score(spark, sf_dir):
    path, df = _forest(spark, sf_dir)
    scored = forest.score_forest(df, MATRIX_COLUMNS, path)
    return significance.score_calls(scored, "oncogene_score", "tsg_score").select(
        "gene", "label", "oncogene_score", "tsg_score", "driver_score", "majority_class"
    )


@query("rf_train_cv")
def rf_train_cv(spark, sf_dir):
    """Every node of the 50 forests of a bank."""
    path, _ = _bank(spark, sf_dir)
    return rounded(forest.read_nodes(spark, path), "threshold", "gain", digits=9)


@query("rf_folds", f"WITH {FOLD_SQL.replace('|0|', '|71|')} SELECT gene, label, iteration, fold FROM folds WHERE gene IN (SELECT 'G' || CAST(l_partkey AS STRING) FROM lineitem)")
def rf_folds(spark, sf_dir):
    """The fold table beside the bank."""
    path, _ = _bank(spark, sf_dir)
    return spark.read.parquet(os.path.join(path, "folds"))


@query("rf_oof_scores")
def rf_oof_scores(spark, sf_dir):
    path, df = _bank(spark, sf_dir)
    return forest.score_bank(df, "gene", MATRIX_COLUMNS, path, REPEATS)


@query("rf_score_bank")
def rf_score_bank(spark, sf_dir):
    """Another cohort: half of its entities are unknown to the bank."""
    path, df = _bank(spark, sf_dir)
    number = F.substring("gene", 2, 20).cast("bigint")
    cohort = df.withColumn(
        "gene", F.when(number % 2 == 0, F.concat(F.lit("N"), number)).otherwise(F.col("gene"))
    )
    scored = forest.score_bank(cohort, "gene", MATRIX_COLUMNS, path, REPEATS)
    return significance.score_calls(scored, "oncogene_score", "tsg_score")


@query("cv_metrics")
def cv_metrics(spark, sf_dir):
    path, df = _bank(spark, sf_dir)
    scored = forest.score_bank(df, "gene", MATRIX_COLUMNS, path, REPEATS, average=False)
    rows = scored.withColumn("driver_score", F.col("oncogene_score") + F.col("tsg_score")).join(
        df.select("gene", "label"), "gene"
    )
    return evaluation.performance(settle(rows), "gene", "label")


@query("importance_summary")
def importance_summary(spark, sf_dir):
    """Only the last fold's fit of each repeat is recorded, one round per repeat."""
    path, _ = _bank(spark, sf_dir)
    rounds = forest.importance(forest.read_nodes(spark, path), MATRIX_COLUMNS).filter(F.col("fold") == FOLDS)
    return rounded(forest.importance_summary(rounds), "mean_importance", "std_importance", digits=9)


# Two features that tell the classes apart, with one value per class: whatever trees are
# drawn, every vote is right, also for entities that were held out or are new.
GAP = f"""
SELECT gene, label, CAST(label * 1000 AS DOUBLE) AS low, CAST(5000 - label * 10 AS DOUBLE) AS high FROM ({LABELS}) x
"""
GAP_FEATURES = ["low", "high"]
_EXACT = """label, CAST(label = 1 AS INT) * 1.0::DOUBLE AS oncogene_score, CAST(label = 2 AS INT) * 1.0::DOUBLE AS tsg_score,
  CAST(label > 0 AS INT) * 1.0::DOUBLE AS driver_score, label AS majority_class"""


def _gap_bank(spark, sf_dir):
    def train(df, path):
        forest.train_bank(df, "gene", GAP_FEATURES, path, SETTINGS, folds=FOLDS, repeats=REPEATS)

    key = (spark.sparkContext.applicationId, sf_dir, "gap")
    if key not in _trained_models:
        rows, path = settle(bind(spark, sf_dir, GAP)), scratch_path(spark, "gap")
        train(rows, path)
        _trained_models[key] = (path, rows)
    return _trained_models[key]


def _calls(scored, *columns):
    calls = significance.score_calls(scored, "oncogene_score", "tsg_score")
    return calls.select(*columns, "oncogene_score", "tsg_score", "driver_score", "majority_class")


@query("rf_score_gap", f"SELECT gene, {_EXACT} FROM ({plain(GAP)}) x")
def rf_score_gap(spark, sf_dir):
    """A forest of its own and its votes."""
    rows, path = settle(bind(spark, sf_dir, GAP)), scratch_path(spark, "gap")
    forest.train_forest(rows, "gene", GAP_FEATURES, path, SETTINGS)
    return _calls(forest.score_forest(rows, GAP_FEATURES, path), "gene", "label")


@query("rf_plain_gap", f"SELECT gene, {_EXACT} FROM ({plain(GAP)}) x")
def rf_plain_gap(spark, sf_dir):
    """The same with the plain forest, weighted by class and without stratified samples."""
    plain_settings = dataclasses.replace(SETTINGS, plain=True)
    rows, path = settle(bind(spark, sf_dir, GAP)), scratch_path(spark, "gap")
    forest.train_forest(rows, "gene", GAP_FEATURES, path, plain_settings)
    return _calls(forest.score_forest(rows, GAP_FEATURES, path), "gene", "label")


@query("rf_oof_gap", f"SELECT gene, {_EXACT} FROM ({plain(GAP)}) x")
def rf_oof_gap(spark, sf_dir):
    """Held-out votes of a whole bank, averaged over its repeats."""
    path, rows = _gap_bank(spark, sf_dir)
    scored = forest.score_bank(rows, "gene", GAP_FEATURES, path, REPEATS)
    averages = ("oncogene_score", "tsg_score", "driver_score")
    return rounded(_calls(scored.join(rows.select("gene", "label"), "gene"), "gene", "label"), *averages, digits=9)


@query("rf_bank_new_gap", f"SELECT 'N' || gene AS gene, {_EXACT} FROM ({plain(GAP)}) x")
def rf_bank_new_gap(spark, sf_dir):
    """A cohort whose entities the bank has never seen."""
    path, rows = _gap_bank(spark, sf_dir)
    new = rows.withColumn("gene", F.concat(F.lit("N"), "gene"))
    scored = forest.score_bank(new, "gene", GAP_FEATURES, path, REPEATS)
    averages = ("oncogene_score", "tsg_score", "driver_score")
    return rounded(_calls(scored.join(new.select("gene", "label"), "gene"), "gene", "label"), *averages, digits=9)


@query(
    "cv_metrics_gap",
    "SELECT type, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc FROM (VALUES ('Driver'), ('OG'), ('TSG')) t(type)",
)
def cv_metrics_gap(spark, sf_dir):
    path, rows = _gap_bank(spark, sf_dir)
    scored = forest.score_bank(rows, "gene", GAP_FEATURES, path, REPEATS, average=False)
    scored = scored.withColumn("driver_score", F.col("oncogene_score") + F.col("tsg_score"))
    measured = evaluation.performance(settle(scored.join(rows.select("gene", "label"), "gene")), "gene", "label")
    return rounded(measured, "roc_auc", "pr_auc", digits=9)


@query(
    "cv_class_metrics_gap",
    f"""
    WITH x AS ({plain(GAP)}), n AS (
      SELECT CAST(label AS VARCHAR) AS class, count(*) AS c FROM x GROUP BY label
      UNION ALL SELECT 'driver', count(*) FROM x WHERE label > 0
      UNION ALL SELECT 'macro', NULL)
    SELECT CAST(i AS INT) AS iteration, class, c AS support, c AS predicted_count, 1.0::DOUBLE AS precision,
      1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM n, range(1, {REPEATS + 1}) r(i)
    """,
)
def cv_class_metrics_gap(spark, sf_dir):
    """Metrics of every repeat of the bank from held-out calls."""
    path, rows = _gap_bank(spark, sf_dir)
    scored = forest.score_bank(rows, "gene", GAP_FEATURES, path, REPEATS, average=False)
    calls = significance.score_calls(scored, "oncogene_score", "tsg_score").join(rows.select("gene", "label"), "gene")
    return evaluation.repeat_metrics(settle(calls), "label")
