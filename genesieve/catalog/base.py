"""Registration of queries, and the bindings that derive their inputs from the tables.

A binding is one SELECT over the given tables in SQL that Spark and DuckDB both
run.  It stands for the input file of an operator; the operator itself is written
once with DataFrames and once, apart from it, as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_width

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a binding in Spark; ``{name}`` stands for a table or for the mutations."""
    names = set(re.findall(r"\{(\w+)\}", text))
    frames = {n: table(spark, sf_dir, n) for n in names if n in TABLES}
    if "mutations" in names:
        frames["mutations"] = mutations(spark, sf_dir)
    return spark.sql(text, **frames)


def plain(text: str) -> str:
    """The same binding as text for another SQL engine."""
    names = {n: n for n in TABLES}
    return text.format_map(names | {"mutations": f"({MUTATIONS.format_map(names)}) mutations"})


_prepared: dict[tuple[str, str], str] = {}


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation table derived from all line items, written once per session.

    It plays the part of the cohort's mutation file: queries prune its columns and
    scan it in parallel.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _prepared:
        path = scratch_path(spark, "mutations")
        rows = bind(spark, sf_dir, MUTATIONS)
        if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            # too few splits to be read by all cores; large tables have enough, and are not shuffled
            rows = rows.repartition(shuffle_width(spark))
        rows.write.parquet(path)
        _prepared[key] = path
    return spark.read.parquet(_prepared[key])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles, whose last digits depend on the order of a sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


RESIDUE = "substr('ACDEFGHIKLMNPQRSTVWY', CAST({0} % 20 AS INT) + 1, 1)"
_REF = RESIDUE.format("l_partkey")
_ALT = RESIDUE.format("l_orderkey")
_POS = "CAST(l_suppkey % 12 + 1 AS STRING)"
_NEXT = "CAST(l_suppkey % 12 + 2 AS STRING)"
_LATER = "CAST(l_suppkey % 12 + 4 AS STRING)"

# One mutation per line item: entity, position, and change strings of all shapes.
MUTATIONS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_quantity AS BIGINT) AS quantity,
  'G' || CAST(l_partkey AS STRING) AS gene,
  CASE CAST((l_orderkey * 3 + l_linenumber * 5 + l_suppkey) % 26 AS INT)
    WHEN 8 THEN 'p.' || {_REF} || {_POS} || {_REF}
    WHEN 9 THEN 'p.' || {_REF} || {_POS} || '*'
    WHEN 10 THEN 'p.*' || {_POS} || {_ALT}
    WHEN 11 THEN 'p.K' || {_POS} || '_K' || {_NEXT} || 'insKA'
    WHEN 12 THEN 'p.K' || {_POS} || '_K' || {_NEXT} || 'delKK'
    WHEN 13 THEN 'p.' || {_REF} || {_POS} || 'fs*' || {_LATER}
    WHEN 14 THEN 'p.' || {_REF} || {_POS} || 'fs*'
    WHEN 15 THEN 'p.?'
    WHEN 16 THEN 'p.(=)'
    WHEN 17 THEN 'p.0?'
    WHEN 18 THEN 'p.?_?ins?'
    WHEN 19 THEN 'p.' || {_REF} || {_POS} || '>D*'
    WHEN 20 THEN 'junk' || {_POS}
    WHEN 21 THEN 'p.' || {_REF} || {_POS} || 'fs'
    WHEN 22 THEN 'p.*' || {_POS} || '*'
    WHEN 23 THEN 'p.' || {_REF} || {_POS} || 'AB*' || {_LATER}
    WHEN 24 THEN CAST(NULL AS STRING)
    WHEN 25 THEN 'P.' || lower({_REF}) || {_POS} || lower({_ALT})
    ELSE 'p.' || {_REF} || {_POS} || {_ALT} END AS protein_change,
  CASE CAST((l_partkey + l_orderkey * 7 + l_linenumber) % 16 AS INT)
    WHEN 5 THEN 'c.' || {_POS} || '+1G>A'
    WHEN 6 THEN 'c.' || {_POS} || '-5G>A'
    WHEN 7 THEN 'c.' || {_POS} || '_' || {_LATER} || 'delACGT'
    WHEN 8 THEN 'c.' || {_POS} || '-5_' || {_LATER} || 'delACGT'
    WHEN 9 THEN 'c.' || {_POS} || '_' || {_NEXT} || 'insA'
    WHEN 10 THEN 'c.' || {_POS} || '-1_' || {_LATER} || '-3G>T'
    WHEN 11 THEN 'c.?'
    WHEN 12 THEN 'c.(' || {_POS} || ')'
    WHEN 13 THEN 'c.' || {_POS} || 'del'
    WHEN 14 THEN 'c.?_?ins?'
    WHEN 15 THEN CASE WHEN l_suppkey % 2 = 0 THEN {_POS} || 'dup' ELSE CAST(NULL AS STRING) END
    ELSE 'c.' || {_POS} || 'A>G' END AS dna_change,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 'Splice_Site'
    ELSE 'other' END AS known_type
FROM {{lineitem}}
"""

# Training classes: entities listed as oncogene or suppressor.
LABELS = """
SELECT 'G' || CAST(p_partkey AS STRING) AS gene, p_type, p_partkey,
  CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'SMALL' THEN 2 ELSE 0 END AS label
FROM {part}
"""
