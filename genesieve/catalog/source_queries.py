"""Sources and sinks.  Files are first written by Spark from the given tables."""

from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from ..operators.merging import union_runs
from ..session import scratch_path
from ..sources import files, tables
from .base import bind, plain, query, table

CUSTOMER = StructType(
    [
        StructField("c_custkey", LongType()),
        StructField("c_name", StringType()),
        StructField("c_nationkey", IntegerType()),
        StructField("c_acctbal", DoubleType()),
        StructField("c_mktsegment", StringType()),
    ]
)


@query("tsv_roundtrip", "SELECT * FROM customer")
def tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "customer_tsv")
    files.write_tsv(table(spark, sf_dir, "customer"), path)
    return files.read_tsv(spark, path, CUSTOMER)


@query(
    "table_replace",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0",
)
def table_replace(spark, sf_dir):
    name = "genesieve_customer"
    first = tables.replace_table(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), name
    )
    return tables.replace_table(first.filter(F.col("c_acctbal") >= 0), name)


@query(
    "empty_typed_table",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL::VARCHAR AS note FROM customer",
)
def empty_typed_table(spark, sf_dir):
    schema = StructType([*CUSTOMER.fields, StructField("note", StringType())])
    empty = tables.empty_table(spark, schema)
    return empty.unionByName(table(spark, sf_dir, "customer"), allowMissingColumns=True)


VALUE_LINES = """
SELECT CASE WHEN p_size % 7 = 0 THEN '#' || p_name ELSE '  ' || p_name || ' ' END AS line,
  p_name, p_size FROM {part}
"""


@query("value_list_scan", "SELECT p_name AS value FROM part WHERE p_size % 7 <> 0")
def value_list_scan(spark, sf_dir):
    path = scratch_path(spark, "values")
    bind(spark, sf_dir, VALUE_LINES).select("line").write.text(path)
    return files.read_value_list(spark, path, comments=True)


KEYED = f"""
SELECT 'B' || CAST(l_partkey % 25 AS STRING)
    || CASE WHEN l_partkey % 25 IN (5, 9) THEN '_ENST' || CAST(l_partkey % 25 AS STRING) ELSE '' END AS key,
  CAST(floor(l_orderkey / 20000) AS INT) AS part, l_orderkey, l_linenumber,
  coalesce(protein_change, '') AS protein_change, coalesce(dna_change, '') AS dna_change,
  CASE WHEN l_linenumber = 2 THEN 'Variant of unknown origin' ELSE 'Confirmed somatic' END AS status
FROM {{mutations}}
"""


@query(
    "file_keyed_concat",
    f"""
    WITH rows AS ({plain(KEYED)})
    SELECT key, protein_change AS protein, dna_change AS dna, status, count(*) AS n
    FROM rows
    WHERE key NOT LIKE '%\\_ENST%' ESCAPE '\\' AND protein_change <> '' AND dna_change <> ''
      AND NOT (protein_change = 'p.?' AND dna_change = 'c.?') AND status NOT LIKE '%unknown%'
    GROUP BY ALL
    """,
)
def file_keyed_concat(spark, sf_dir):
    from ..functions.text import is_informative

    path = scratch_path(spark, "keyed")
    rows = bind(spark, sf_dir, KEYED)
    body = rows.select(
        "key", "part", F.lit(1).alias("order"),
        F.concat_ws("\t", "protein_change", "dna_change", "status").alias("line"),
    )
    preamble = rows.select("key", "part").distinct().select(
        "key", "part", F.lit(0).alias("order"),
        F.explode(F.array_repeat(F.lit("preamble\tline\tof file"), 8)).alias("line"),
    )
    (
        body.unionByName(preamble)
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "order")
        .select("key", "part", "line")
        .write.partitionBy("key", "part").text(path)
    )
    lines = files.read_keyed_files(spark, path, r"/key=([^/]+)/", preamble=8)
    fields = F.split("line", "\t")
    split = lines.select(
        "key", fields[0].alias("protein"), fields[1].alias("dna"), fields[2].alias("status")
    )
    kept = split.filter(is_informative(F.col("protein"), F.col("dna"), F.col("status")))
    return kept.groupBy("key", "protein", "dna", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fasta_length",
    """
    SELECT source AS key, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS length
    FROM documents GROUP BY source
    """,
)
def fasta_length(spark, sf_dir):
    path = scratch_path(spark, "sequences")
    documents = table(spark, sf_dir, "documents")
    residues = F.regexp_replace("text", "[^A-Za-z]", "")
    documents.select(
        F.concat(F.lit(">"), "doc_id", F.lit("\n"), residues).alias("entry"),
        F.col("source").alias("key"),
    ).write.partitionBy("key").text(path)
    return files.sequence_lengths(spark, path, r"/key=([^/]+)/")


@query("entity_lookup_pruned", "SELECT * FROM part WHERE p_name = 'red widget'")
def entity_lookup_pruned(spark, sf_dir):
    path = scratch_path(spark, "part_by_initial")
    tables.write_by_initial(table(spark, sf_dir, "part"), "p_name", path)
    return tables.read_entity(spark, path, "p_name", "red widget")


@query(
    "union_runs_rekey",
    """
    SELECT row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|' ||
        CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END), o_orderkey) + 1 AS row_id,
      o_custkey, o_totalprice
    FROM orders
    """,
)
def union_runs_rekey(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )
    runs = [orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"]
    return union_runs(runs, "o_orderkey")
