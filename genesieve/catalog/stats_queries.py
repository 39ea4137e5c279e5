"""Descriptive statistics, empirical significance and evaluation."""

from pyspark.sql import functions as F

from ..operators import evaluation, significance, stats
from ..session import settle
from .base import bind, plain, query, rounded, table


@query(
    "group_entropy",
    """
    SELECT l_partkey, CAST(any_value(n) AS BIGINT) AS n, round(-sum(c / n * log2(c / n)), 6) + 0 AS entropy,
      round(log2(any_value(n)), 6) AS max_entropy,
      round(coalesce(-sum(c / n * log2(c / n)) / nullif(log2(any_value(n)), 0), 0), 6) + 0 AS pct_of_uniform
    FROM (SELECT l_partkey, l_suppkey, count(*) AS c, sum(count(*)) OVER (PARTITION BY l_partkey) AS n
      FROM lineitem GROUP BY l_partkey, l_suppkey) x
    GROUP BY l_partkey
    """,
)
def group_entropy(spark, sf_dir):
    df = stats.group_entropy(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return rounded(df, "entropy", "max_entropy", "pct_of_uniform")


BINS = "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin FROM {events}"


@query(
    "js_distance",
    f"""
    WITH e AS ({plain(BINS)}),
    p AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM e WHERE event_type = 'error' GROUP BY bin),
    q AS (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM e WHERE event_type = 'purchase' GROUP BY bin),
    j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (bin)),
    d AS (SELECT CASE WHEN bool_or(p > 0 AND q = 0) THEN NULL ELSE sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END) END AS kl,
      0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) AS js FROM j)
    SELECT round(kl, 6) AS kl_divergence, round(js, 6) AS js_divergence, round(sqrt(js), 6) AS js_distance FROM d
    """,
)
def js_distance(spark, sf_dir):
    df = stats.divergence(
        bind(spark, sf_dir, BINS), "bin", F.col("event_type") == "error", F.col("event_type") == "purchase"
    )
    return rounded(df, "kl_divergence", "js_divergence", "js_distance")


@query(
    "linear_fit",
    """
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
      round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY l_returnflag
    """,
)
def linear_fit(spark, sf_dir):
    df = stats.linear_fit(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]
    )
    return rounded(rounded(df, "slope", "intercept", digits=3), "r2")


@query(
    "box_summary",
    """
    SELECT event_type, min(value) AS minimum, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
      round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS maximum
    FROM events GROUP BY event_type
    """,
)
def box_summary(spark, sf_dir):
    df = stats.box_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return rounded(df, "q1", "median", "q3")


@query(
    "histogram_bins",
    """
    WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    b AS (SELECT event_type, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, lo, hi FROM events, m)
    SELECT event_type, bin, count(*) AS n, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 20), 6) AS bin_start,
      round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 20), 6) AS bin_end
    FROM b GROUP BY event_type, bin
    """,
)
def histogram_bins(spark, sf_dir):
    df = stats.histogram(table(spark, sf_dir, "events"), "value", 20, ["event_type"])
    return rounded(df, "bin_start", "bin_end")


@query(
    "score_kde",
    """
    WITH h AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY event_type),
    g AS (SELECT i AS grid_index, i * 5.0::DOUBLE AS x FROM range(0, 41) r(i))
    SELECT e.event_type, CAST(grid_index AS INT) AS grid_index, x,
      round(sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
    FROM events e JOIN h USING (event_type), g GROUP BY e.event_type, grid_index, x
    """,
)
def score_kde(spark, sf_dir):
    grid = [i * 5.0 for i in range(41)]
    return rounded(
        stats.density(table(spark, sf_dir, "events"), "value", "event_type", grid), "density"
    )


# Three scores per event; errors, clicks and views stand for simulated entities, all others
# for observed ones, whose scores are shifted so that some lie above the null maximum.
SCORES = """
SELECT event_id, CAST(user_id % 3 AS INT) AS label, event_type,
  CAST(v % 997 AS DOUBLE) / 2000 AS oncogene_score, CAST(v % 499 AS DOUBLE) / 1000 AS tsg_score,
  CAST(v % 997 + 2 * (v % 499) AS DOUBLE) / 2000 AS driver_score
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM {events}) e
"""
SHIFTED = """
SELECT event_id, label, event_type, oncogene_score + shift AS oncogene_score, tsg_score + shift AS tsg_score,
  driver_score + shift AS driver_score
FROM (SELECT *, CASE WHEN event_type IN ('error', 'click', 'view') THEN CAST(0 AS DOUBLE) ELSE 0.0625E0 END AS shift FROM ({scores}) s) t
"""
SIMULATED = "event_type IN ('error', 'click', 'view')"
OBSERVED = "event_type NOT IN ('error', 'click', 'view')"
SCORE_NAMES = ["oncogene_score", "tsg_score", "driver_score"]


def _scores(spark, sf_dir):
    return bind(spark, sf_dir, SCORES)


def _shifted(spark, sf_dir):
    return bind(spark, sf_dir, SHIFTED.replace("{scores}", SCORES))


def _simulated(spark, sf_dir):
    return significance.unpivot_scores(_shifted(spark, sf_dir).filter(SIMULATED), SCORE_NAMES)


NULL_SQL = f"""
  scores AS ({plain(SHIFTED.replace("{scores}", SCORES))}),
  long_null AS (
    UNPIVOT (SELECT oncogene_score, tsg_score, driver_score FROM scores WHERE {SIMULATED})
    ON oncogene_score, tsg_score, driver_score INTO NAME score_type VALUE score),
  null_p AS (
    SELECT score_type, score, sum(count(*)) OVER (PARTITION BY score_type ORDER BY score DESC) / sum(count(*)) OVER (PARTITION BY score_type) AS p
    FROM long_null GROUP BY score_type, score)
"""


@query(
    "null_distribution",
    f"""
    WITH {NULL_SQL}
    SELECT score, round(max(p) FILTER (score_type = 'oncogene_score'), 9) AS oncogene_score,
      round(max(p) FILTER (score_type = 'tsg_score'), 9) AS tsg_score, round(max(p) FILTER (score_type = 'driver_score'), 9) AS driver_score
    FROM null_p GROUP BY score
    """,
)
def null_distribution(spark, sf_dir):
    null = significance.null_distribution(_simulated(spark, sf_dir))
    return rounded(significance.null_table(null, SCORE_NAMES), *SCORE_NAMES, digits=9)


LOOKUP_SQL = f"""
  {NULL_SQL},
  observed AS (
    UNPIVOT (SELECT oncogene_score, tsg_score, driver_score FROM scores WHERE {OBSERVED})
    ON oncogene_score, tsg_score, driver_score INTO NAME score_type VALUE score),
  distinct_observed AS (SELECT DISTINCT score_type, score FROM observed),
  nulls AS (SELECT score_type, max(score) AS top, count(*) AS n FROM long_null GROUP BY score_type),
  looked_up AS (
    SELECT d.score_type, d.score, CASE WHEN d.score > top THEN 0
      WHEN d.score = top THEN (SELECT p FROM null_p z WHERE z.score_type = d.score_type AND z.score = d.score)
      ELSE (SELECT max(p) FROM null_p z WHERE z.score_type = d.score_type AND z.score > d.score) END AS p
    FROM distinct_observed d JOIN nulls USING (score_type))
"""


@query(
    "pvalue_lookup",
    f"WITH {LOOKUP_SQL} SELECT score_type, score, round(p, 9) AS p FROM looked_up",
)
def pvalue_lookup(spark, sf_dir):
    null = significance.null_distribution(_simulated(spark, sf_dir))
    observed = significance.unpivot_scores(
        _shifted(spark, sf_dir).filter(OBSERVED), SCORE_NAMES
    )
    return rounded(significance.lookup_p_values(observed, null), "p", digits=9)


P_VALUES = "SELECT p_partkey, p_type, (p_size - 1) / 50 AS p FROM {part}"


@query(
    "bh_fdr",
    f"""
    WITH x AS ({plain(P_VALUES)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p, p_partkey) AS i, count(*) OVER (PARTITION BY p_type) AS n FROM x),
    a AS (SELECT p_type, p, least(1, min(n / i * p) OVER (PARTITION BY p_type ORDER BY i DESC)) AS q FROM r)
    SELECT DISTINCT p_type, p, round(q, 9) AS q FROM a
    """,
)
def bh_fdr(spark, sf_dir):
    adjusted = significance.adjust_p_values(bind(spark, sf_dir, P_VALUES), ["p_type"])
    return rounded(adjusted, "q", digits=9)


SIGNIFICANT_SQL = f"""
  {LOOKUP_SQL},
  per_row AS (SELECT o.score_type, o.score, p FROM observed o JOIN looked_up USING (score_type, score)),
  ranked AS (SELECT score_type, score, p, row_number() OVER (PARTITION BY score_type ORDER BY p) AS i, count(*) OVER (PARTITION BY score_type) AS n FROM per_row),
  adjusted AS (SELECT score_type, score, p, least(1, min(n / i * p) OVER (PARTITION BY score_type ORDER BY i DESC)) AS q FROM ranked),
  by_p AS (SELECT score_type, p, min(q) AS q FROM adjusted GROUP BY score_type, p),
  final AS (SELECT DISTINCT l.score_type, l.score, p, q FROM looked_up l JOIN by_p USING (score_type, p)),
  significant AS (
    SELECT s.*, a.p AS oncogene_score_p, a.q AS oncogene_score_q, b.p AS tsg_score_p, b.q AS tsg_score_q, c.p AS driver_score_p, c.q AS driver_score_q
    FROM scores s
    JOIN final a ON a.score_type = 'oncogene_score' AND a.score = s.oncogene_score
    JOIN final b ON b.score_type = 'tsg_score' AND b.score = s.tsg_score
    JOIN final c ON c.score_type = 'driver_score' AND c.score = s.driver_score
    WHERE {OBSERVED})
"""
_PQ = [f"{s}_{x}" for s in SCORE_NAMES for x in "pq"]


def _significant(spark, sf_dir):
    null = significance.null_distribution(_simulated(spark, sf_dir))
    results = _shifted(spark, sf_dir).filter(OBSERVED)
    return significance.significance(results, null, SCORE_NAMES)


@query(
    "driver_significance",
    f"""WITH {SIGNIFICANT_SQL} SELECT event_id, {", ".join(f"round({c}, 9) AS {c}" for c in _PQ)} FROM significant""",
)
def driver_significance(spark, sf_dir):
    return rounded(_significant(spark, sf_dir).select("event_id", *_PQ), *_PQ, digits=9)


@query(
    "score_calls",
    f"""
    WITH s AS ({plain(SCORES)}), o AS (SELECT *, 1 - (oncogene_score + tsg_score) AS other_score FROM s)
    SELECT event_id, round(other_score, 9) AS other_score, round(1 - other_score, 9) AS driver_score,
      CASE WHEN other_score >= oncogene_score AND other_score >= tsg_score THEN 0 WHEN oncogene_score >= tsg_score THEN 1 ELSE 2 END AS majority_class,
      CAST(1 - other_score > 0.5 AS INT) AS majority_driver
    FROM o
    """,
)
def score_calls(spark, sf_dir):
    df = _scores(spark, sf_dir).drop("driver_score")
    calls = significance.score_calls(df, "oncogene_score", "tsg_score").orderBy(
        F.desc("driver_score"), "event_id"
    )
    return rounded(
        calls.select("event_id", "other_score", "driver_score", "majority_class", "majority_driver"),
        "other_score", "driver_score", digits=9,
    )


@query(
    "call_lists",
    f"""
    WITH {SIGNIFICANT_SQL}, c AS (SELECT *, 1 - (oncogene_score + tsg_score) AS other_score FROM significant),
    m AS (SELECT *, CASE WHEN other_score >= oncogene_score AND other_score >= tsg_score THEN 0 WHEN oncogene_score >= tsg_score THEN 1 ELSE 2 END AS call FROM c)
    SELECT 'q' AS by, 'oncogene' AS list_name, event_id FROM m WHERE oncogene_score_q <= 0.1
    UNION ALL SELECT 'q', 'novel_oncogene', event_id FROM m WHERE oncogene_score_q <= 0.1 AND label <> 1
    UNION ALL SELECT 'q', 'tsg', event_id FROM m WHERE tsg_score_q <= 0.1
    UNION ALL SELECT 'q', 'novel_tsg', event_id FROM m WHERE tsg_score_q <= 0.1 AND label <> 2
    UNION ALL SELECT 'majority', 'oncogene', event_id FROM m WHERE call = 1
    UNION ALL SELECT 'majority', 'novel_oncogene', event_id FROM m WHERE call = 1 AND label <> 1
    UNION ALL SELECT 'majority', 'tsg', event_id FROM m WHERE call = 2
    UNION ALL SELECT 'majority', 'novel_tsg', event_id FROM m WHERE call = 2 AND label <> 2
    """,
)
def call_lists(spark, sf_dir):
    called = settle(
        significance.score_calls(
            _significant(spark, sf_dir).drop("driver_score"), "oncogene_score", "tsg_score"
        )
    )
    by_q = significance.call_lists(
        called, "event_id", q_columns=("oncogene_score_q", "tsg_score_q")
    )
    by_majority = significance.call_lists(called, "event_id")
    return by_q.withColumn("by", F.lit("q")).unionByName(
        by_majority.withColumn("by", F.lit("majority"))
    )


@query(
    "qq_points",
    f"""
    WITH x AS ({plain(P_VALUES)}), r AS (SELECT p_type, p, row_number() OVER (PARTITION BY p_type ORDER BY p) AS rank, count(*) OVER (PARTITION BY p_type) AS n FROM x)
    SELECT p_type, rank, p AS observed, round(rank / (n + 1), 9) AS expected, round(CASE WHEN p > 0 THEN -log10(p) END, 6) + 0 AS observed_log,
      round(-log10(rank / (n + 1)), 6) + 0 AS expected_log FROM r
    """,
)
def qq_points(spark, sf_dir):
    points = significance.qq_points(bind(spark, sf_dir, P_VALUES), "p", ["p_partkey"], ["p_type"])
    return rounded(rounded(points, "expected", digits=9), "observed_log", "expected_log")


@query(
    "mlfc",
    f"""
    WITH x AS ({plain(P_VALUES)} ), k AS (SELECT * FROM x WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_name = 'red widget')),
    r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n, min(CASE WHEN p > 0 THEN p END) OVER () AS least FROM k)
    SELECT round(avg(abs(log2(CASE WHEN p = 0 THEN least ELSE p END / (i / n)))), 6) AS mlfc FROM r
    """,
)
def mlfc(spark, sf_dir):
    excluded = table(spark, sf_dir, "part").filter("p_name = 'red widget'").select("p_partkey")
    return rounded(
        significance.mean_log_fold_change(
            bind(spark, sf_dir, P_VALUES), "p", ["p_partkey"], excluded, "p_partkey"
        ),
        "mlfc",
    )


METHODS = """
SELECT doc_id, quality AS label, 'length' AS method, CAST(n_chars AS DOUBLE) AS score FROM {documents} JOIN {labels} USING (doc_id)
UNION ALL
SELECT doc_id, quality, 'words', CASE WHEN doc_id % 9 = 4 THEN CAST(NULL AS DOUBLE) ELSE -CAST(floor(n_chars / 400) AS DOUBLE) END
FROM {documents} JOIN {labels} USING (doc_id)
"""
CURVE_SQL = f"""
  rows AS ({plain(METHODS)}),
  units AS (SELECT method, score AS t, sum(label) AS pos, count(*) AS c FROM rows WHERE score IS NOT NULL GROUP BY method, score),
  counts AS (
    SELECT *, sum(pos) OVER (PARTITION BY method ORDER BY t DESC) AS tp, sum(c) OVER (PARTITION BY method ORDER BY t DESC) AS n,
      sum(pos) OVER (PARTITION BY method) AS p_all, sum(c) OVER (PARTITION BY method) AS n_all FROM units),
  grid AS (SELECT CAST(i AS INT) AS grid_index, CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 99) END AS g FROM range(0, 100) r(i))
"""
PR_SQL = f"""
  {CURVE_SQL},
  points AS (
    SELECT method, tp / p_all AS x, tp / n AS p, t FROM counts WHERE tp - pos < p_all),
  levels AS (
    SELECT method, x, CASE WHEN x = 0 THEN 1 ELSE max(p) END AS pl, min(p) AS pr, CASE WHEN x = 0 THEN 1 ELSE max(t) END AS tl, min(t) AS tr FROM points GROUP BY method, x
    UNION ALL SELECT DISTINCT method, 0, 1, 1, 1, 1 FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b WHERE b.method = a.method AND b.x = 0)),
  bounds AS (
    SELECT method, grid_index, g, max(x) FILTER (x <= g) AS lo, min(x) FILTER (x > g) AS hi FROM levels, grid GROUP BY method, grid_index, g),
  pr AS (
    SELECT method, grid_index, g AS recall,
      CASE WHEN grid_index = 99 THEN l.pl ELSE l.pr + (g - lo) / (hi - lo) * (h.pl - l.pr) END AS precision,
      CASE WHEN grid_index = 99 THEN l.tl ELSE l.tr + (g - lo) / (hi - lo) * (h.tl - l.tr) END AS threshold
    FROM bounds b JOIN levels l USING (method) LEFT JOIN levels h ON h.method = b.method AND h.x = b.hi WHERE l.x = b.lo)
"""


@query(
    "pr_curve",
    f"""
    WITH {PR_SQL} SELECT method, grid_index, round(recall, 9) AS recall, round(precision, 6) AS precision, round(threshold, 4) AS threshold FROM pr
    """,
)
def pr_curve(spark, sf_dir):
    curve = evaluation.pr_curve(bind(spark, sf_dir, METHODS))
    return rounded(rounded(rounded(curve, "recall", digits=9), "precision"), "threshold", digits=4)


def _area_sql(curve: str, x: str, y: str, name: str) -> str:
    return f"""
      SELECT method, round(sum(({x} - px) * ({y} + py) / 2), 6) AS {name} FROM (
        SELECT *, lag({x}) OVER (PARTITION BY method ORDER BY grid_index) AS px, lag({y}) OVER (PARTITION BY method ORDER BY grid_index) AS py FROM {curve}) a
      GROUP BY method
    """


@query("pr_compare_methods", f"WITH {PR_SQL} {_area_sql('pr', 'recall', 'precision', 'pr_auc')}")
def pr_compare_methods(spark, sf_dir):
    curve = evaluation.pr_curve(bind(spark, sf_dir, METHODS))
    return rounded(evaluation.area(curve, "recall", "precision", ["method"], "pr_auc"), "pr_auc")


ROC_SQL = f"""
  {CURVE_SQL},
  points AS (
    SELECT method, (n - tp) / (n_all - p_all) AS x, tp / p_all AS y FROM counts UNION ALL SELECT DISTINCT method, 0, 0 FROM counts),
  levels AS (SELECT method, x, min(y) AS yl, max(y) AS yr FROM points GROUP BY method, x),
  bounds AS (
    SELECT method, grid_index, g, max(x) FILTER (x <= g) AS lo, min(x) FILTER (x > g) AS hi FROM levels, grid GROUP BY method, grid_index, g),
  roc AS (
    SELECT method, grid_index, g AS fpr, CASE WHEN grid_index = 99 THEN 1 ELSE l.yr + (g - lo) / (hi - lo) * (h.yl - l.yr) END AS tpr
    FROM bounds b JOIN levels l USING (method) LEFT JOIN levels h ON h.method = b.method AND h.x = b.hi WHERE l.x = b.lo)
"""


@query(
    "roc_curve",
    f"WITH {ROC_SQL} SELECT method, grid_index, round(fpr, 9) AS fpr, round(tpr, 6) AS tpr FROM roc",
)
def roc_curve(spark, sf_dir):
    curve = evaluation.roc_curve(bind(spark, sf_dir, METHODS))
    return rounded(rounded(curve, "fpr", digits=9), "tpr")


@query("roc_auc", f"WITH {ROC_SQL} {_area_sql('roc', 'fpr', 'tpr', 'roc_auc')}")
def roc_auc(spark, sf_dir):
    curve = evaluation.roc_curve(bind(spark, sf_dir, METHODS))
    return rounded(evaluation.area(curve, "fpr", "tpr", ["method"], "roc_auc"), "roc_auc")


PREDICTED = """
SELECT doc_id, CAST(quality + toxic AS INT) AS label,
  CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted
FROM {documents} JOIN {labels} USING (doc_id)
"""
PRF_SQL = f"""
  x AS ({plain(PREDICTED)}), k AS (SELECT DISTINCT label AS class FROM x UNION SELECT DISTINCT predicted FROM x),
  c AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (predicted = class) AS predicted_count,
    count(*) FILTER (label = class AND predicted = class) AS tp FROM k, x GROUP BY class),
  m AS (SELECT class, support, predicted_count, coalesce(tp / nullif(predicted_count, 0), 0) AS precision,
    coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted_count + support, 0), 0) AS f1 FROM c)
"""


@query(
    "prf_scores",
    f"WITH {PRF_SQL} SELECT class, support, predicted_count, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m",
)
def prf_scores(spark, sf_dir):
    df = evaluation.class_metrics(bind(spark, sf_dir, PREDICTED))
    return rounded(df, "precision", "recall", "f1", digits=9)


@query(
    "prf_macro",
    f"WITH {PRF_SQL} SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM m",
)
def prf_macro(spark, sf_dir):
    df = evaluation.macro_metrics(evaluation.class_metrics(bind(spark, sf_dir, PREDICTED)))
    return rounded(df, "precision", "recall", "f1", digits=9)
