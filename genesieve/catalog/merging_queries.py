"""Joins, merges of sources, aliases and labels."""

from pyspark.sql import functions as F

from ..operators import labels, merging
from ..operators.ordered import hashed_row_number
from .base import LABELS, bind, mutations, plain, query, table


@query(
    "hypermutator_filter",
    """
    SELECT * FROM events WHERE user_id IN (
      SELECT user_id FROM events GROUP BY user_id HAVING count(*) < 70)
    """,
)
def hypermutator_filter(spark, sf_dir):
    return merging.drop_hypermutators(table(spark, sf_dir, "events"), "user_id", 70)


BANNED = "SELECT DISTINCT s_nationkey FROM {supplier} WHERE s_acctbal > 8500"
BAN_ROWS = """
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN CAST(NULL AS INT) ELSE c_nationkey END AS sample FROM {customer}
"""


@query(
    "ban_list_filter",
    f"""
    SELECT * FROM ({plain(BAN_ROWS)}) c
    WHERE sample IS NULL OR sample NOT IN ({plain(BANNED)})
    """,
)
def ban_list_filter(spark, sf_dir):
    banned = bind(spark, sf_dir, BANNED)
    return merging.drop_banned(bind(spark, sf_dir, BAN_ROWS), "sample", banned, "s_nationkey")


ORDER_ROWS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS BIGINT) ELSE o_custkey END AS sample,
  o_totalprice, o_orderstatus FROM {orders}
"""


@query(
    "source_priority_merge",
    f"""
    WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source FROM ({plain(ORDER_ROWS)}) r)
    SELECT o_orderkey, sample, o_totalprice FROM o
    WHERE sample IS NULL OR source = (SELECT min(source) FROM o p WHERE p.sample = o.sample)
    """,
)
def source_priority_merge(spark, sf_dir):
    rows = bind(spark, sf_dir, ORDER_ROWS)
    sources = [rows.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"]
    return merging.prioritise_sources(sources, "sample")


@query(
    "merge_sources_not_in",
    f"""
    WITH o AS ({plain(ORDER_ROWS)}),
    base AS (SELECT o_orderkey, o_custkey AS sample, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    nulls AS (SELECT o_orderkey, sample, o_totalprice FROM o WHERE o_orderstatus = 'F'),
    extra AS (SELECT o_orderkey, sample FROM o WHERE o_orderstatus <> 'F')
    SELECT 'without null' AS base, o_orderkey, sample, o_totalprice FROM base
    UNION ALL SELECT 'without null', o_orderkey, sample, NULL FROM extra WHERE sample NOT IN (SELECT DISTINCT sample FROM base)
    UNION ALL SELECT 'with null', o_orderkey, sample, o_totalprice FROM nulls
    UNION ALL SELECT 'with null', o_orderkey, sample, NULL FROM extra WHERE sample NOT IN (SELECT DISTINCT sample FROM nulls)
    """,
)
def merge_sources_not_in(spark, sf_dir):
    rows = bind(spark, sf_dir, ORDER_ROWS)
    orders = table(spark, sf_dir, "orders")
    base = orders.filter(F.col("o_orderstatus") == "F").select(
        "o_orderkey", F.col("o_custkey").alias("sample"), "o_totalprice"
    )
    with_null = rows.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    extra = rows.filter(F.col("o_orderstatus") != "F").select("o_orderkey", "sample")
    return (
        merging.append_unseen(base, extra, "sample").withColumn("base", F.lit("without null"))
        .unionByName(
            merging.append_unseen(with_null, extra, "sample").withColumn("base", F.lit("with null"))
        )
    )


@query(
    "qc_filter_by_rowid",
    """
    SELECT l_partkey, l_suppkey, row_id, 'M' || CAST(row_id % 7 AS VARCHAR) AS ontology FROM (
      SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey))) AS row_id
      FROM lineitem) l
    WHERE row_id % 2 = 1
    """,
)
def qc_filter_by_rowid(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = hashed_row_number(
        table(spark, sf_dir, "lineitem").select(*keys), keys, output="row_id"
    )
    checks = rows.select(
        "row_id",
        F.when(F.col("row_id") % 2 == 0, "low mappability").alias("warning"),
        F.concat(F.lit("M"), F.col("row_id") % 7).alias("ontology"),
    )
    passing = merging.keep_passing(rows, checks, "row_id", "warning")
    return merging.attach_by_row_id(passing, checks.drop("warning"), "row_id").select(
        "l_partkey", "l_suppkey", "row_id", "ontology"
    )


SYMBOLS = """
SELECT p_partkey AS row_id, 'S' || CAST(p_partkey AS STRING) AS approved,
  CASE WHEN p_partkey % 3 = 0 THEN 'P' || CAST(CAST(floor(p_partkey / 6) AS BIGINT) AS STRING) || ', Q' || CAST(p_partkey AS STRING) END AS previous,
  CASE WHEN p_partkey % 2 = 0 THEN 'P' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) || ', Y' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING)
    || ', S' || CAST(p_partkey + 1 AS STRING) END AS synonyms
FROM {part}
"""
NAMED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS row_id,
  CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'P' || CAST(CAST(floor(l_partkey / 3) AS BIGINT) AS STRING)
    WHEN 1 THEN 'Y' || CAST(CAST(floor(l_partkey / 10) AS BIGINT) AS STRING)
    WHEN 2 THEN 'S' || CAST(l_partkey AS STRING) WHEN 3 THEN 'Q' || CAST(l_partkey AS STRING)
    ELSE CASE WHEN l_linenumber = 1 THEN 'MLL4' ELSE 'none' END END AS name
FROM {lineitem}
"""
RESOLVED = f"""
  s AS ({plain(SYMBOLS)}),
  prev AS (SELECT unnest(string_split(previous, ', ')) AS alias, approved, row_id FROM s WHERE previous IS NOT NULL),
  syn AS (SELECT unnest(string_split(synonyms, ', ')) AS alias, approved, row_id FROM s WHERE synonyms IS NOT NULL),
  p AS (SELECT alias, arg_max(approved, row_id) AS symbol FROM prev GROUP BY alias),
  y AS (SELECT alias, arg_max(approved, row_id) AS symbol FROM syn GROUP BY alias),
  named AS ({plain(NAMED)}),
  resolved AS (
    SELECT n.*, CASE WHEN a.approved IS NOT NULL THEN n.name WHEN n.name = 'MLL4' THEN 'KMT2B'
      ELSE coalesce(p.symbol, y.symbol, n.name) END AS symbol
    FROM named n LEFT JOIN s a ON n.name = a.approved LEFT JOIN p ON n.name = p.alias LEFT JOIN y ON n.name = y.alias)
"""


def _aliases(spark, sf_dir):
    return merging.alias_table(
        bind(spark, sf_dir, SYMBOLS), "approved", "previous", "synonyms", "row_id"
    )


@query(
    "alias_resolve",
    f"WITH {RESOLVED} SELECT l_orderkey, l_linenumber, l_partkey, symbol AS name FROM resolved",
)
def alias_resolve(spark, sf_dir):
    rows = bind(spark, sf_dir, NAMED).select("l_orderkey", "l_linenumber", "l_partkey", "name")
    return merging.resolve_aliases(rows, "name", _aliases(spark, sf_dir))


@query(
    "alias_resolve_nodup",
    f"""
    WITH {RESOLVED},
    first AS (SELECT symbol, arg_min(name, row_id) AS name FROM resolved WHERE symbol <> name GROUP BY symbol)
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.symbol AS name
    FROM resolved r LEFT JOIN first f ON r.symbol = f.symbol WHERE r.symbol = r.name OR r.name = f.name
    """,
)
def alias_resolve_nodup(spark, sf_dir):
    rows = bind(spark, sf_dir, NAMED)
    return merging.resolve_aliases_once(rows, "name", _aliases(spark, sf_dir), "row_id").select(
        "l_orderkey", "l_linenumber", "l_partkey", "name"
    )


@query(
    "dedupe_first",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o WHERE r = 1
    """,
)
def dedupe_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return merging.first_per_key(orders, ["o_custkey"], "o_orderkey")


STATUS_COUNTS = """
SELECT o_custkey, count(*) AS n FROM {{orders}} WHERE o_orderstatus = '{0}' GROUP BY o_custkey
"""


@query(
    "outer_align_scores",
    f"""
    SELECT o_custkey, f.n AS finished, o.n AS open, p.n AS pending
    FROM ({plain(STATUS_COUNTS.format("F"))}) f
    FULL JOIN ({plain(STATUS_COUNTS.format("O"))}) o USING (o_custkey)
    FULL JOIN ({plain(STATUS_COUNTS.format("P"))}) p USING (o_custkey)
    """,
)
def outer_align_scores(spark, sf_dir):
    tables = {
        name: bind(spark, sf_dir, STATUS_COUNTS.format(code))
        for name, code in (("finished", "F"), ("open", "O"), ("pending", "P"))
    }
    return merging.align_outer(tables, "o_custkey", "n")


@query(
    "set_ops",
    """
    WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'),
         b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus <> 'F')
    SELECT v AS value, 'both' AS part FROM (SELECT v FROM a INTERSECT SELECT v FROM b) x
    UNION ALL SELECT v, 'first only' FROM (SELECT v FROM a EXCEPT SELECT v FROM b) x
    UNION ALL SELECT v, 'second only' FROM (SELECT v FROM b EXCEPT SELECT v FROM a) x
    """,
)
def set_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return merging.compare_sets(
        orders.filter(F.col("o_orderstatus") == "F"),
        orders.filter(F.col("o_orderstatus") != "F"),
        "o_custkey",
    )


ONCOGENES = "SELECT DISTINCT 'G' || CAST(p_partkey AS STRING) AS gene FROM {part} WHERE p_type = 'ECONOMY'"
TSGS = "SELECT DISTINCT 'G' || CAST(p_partkey AS STRING) AS gene FROM {part} WHERE p_type = 'SMALL' OR p_name = 'red widget'"


@query(
    "label_entities",
    f"""
    SELECT l_orderkey, l_linenumber, gene, CASE WHEN gene IN ({plain(ONCOGENES)}) THEN 1
      WHEN gene IN ({plain(TSGS)}) THEN 2 ELSE 0 END AS label
    FROM {plain('{mutations}')}
    """,
)
def label_entities(spark, sf_dir):
    rows = mutations(spark, sf_dir).select("l_orderkey", "l_linenumber", "gene")
    return labels.label_entities(
        rows, "gene", bind(spark, sf_dir, ONCOGENES), bind(spark, sf_dir, TSGS)
    )


@query("class_guard", f"SELECT label, count(*) AS n FROM ({plain(LABELS)}) l GROUP BY label")
def class_guard(spark, sf_dir):
    df = bind(spark, sf_dir, LABELS)
    labels.check_classes(df)
    return labels.class_sizes(df)


@query(
    "class_weights",
    f"SELECT gene, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS weight FROM ({plain(LABELS)}) l",
)
def class_weights(spark, sf_dir):
    return labels.class_weights(bind(spark, sf_dir, LABELS).select("gene", "label"))


@query(
    "class_sample_sizes",
    f"""
    WITH n AS (SELECT label, count(*) AS n FROM ({plain(LABELS)}) l GROUP BY label)
    SELECT label, n, CAST(floor(CASE WHEN label = 0 THEN (SELECT sum(n * 0.7::DOUBLE) FROM n WHERE label <> 0)
      ELSE n * 0.7::DOUBLE END) AS BIGINT) AS sample_size FROM n
    """,
)
def class_sample_sizes(spark, sf_dir):
    return labels.sample_sizes(bind(spark, sf_dir, LABELS))
