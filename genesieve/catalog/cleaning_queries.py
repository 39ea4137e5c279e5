"""Projections, filters and fills."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..operators import cleaning
from ..operators.ordered import hashed_row_number
from .base import bind, plain, query, rounded, table


def case_of(column: str, names: dict[str, str], default: str) -> str:
    """A SQL CASE over a fixed dictionary."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in names.items())
    return f"CASE {column} {whens} ELSE {default} END"


def pick(number: str, values: list[str | None]) -> str:
    """A SQL CASE that takes the n-th of some texts; None stands for null."""
    whens = " ".join(
        f"WHEN {i} THEN '" + v.replace("'", "''") + "'" for i, v in enumerate(values)
        if v is not None
    )
    return f"CASE CAST({number} % {len(values)} AS INT) {whens} END"


@query(
    "harmonise_columns",
    "SELECT p_type AS tumor_type, p_name AS gene, p_partkey AS start_position, p_brand AS tumor_sample FROM part",
)
def harmonise_columns(spark, sf_dir):
    names = {"p_type": "tumor_type", "p_name": "gene", "p_partkey": "start_position", "p_brand": "tumor_sample"}
    return cleaning.harmonise(
        table(spark, sf_dir, "part"), names, ["gene", "tumor_sample", "tumor_type", "start_position"]
    )


CATEGORIES = f"""
SELECT o_orderkey,
  {pick("o_custkey", [*fv.TUMOR_TYPE_CODES, "NA"])} AS code,
  {pick("o_orderkey", [*fv.TUMOR_TYPE_SPELLINGS, "Lymphoma", "Endometrial Carcinoma "])} AS spelling,
  {pick("o_custkey + o_orderkey", [*fv.EXPORT_CONSEQUENCES, "Whole gene deletion"])} AS export_class,
  {pick("o_custkey * 3 + o_orderkey", list(fv.STRICT_CONSEQUENCES))} AS strict_class
FROM {{orders}}
"""


@query(
    "recode_categories",
    f"""
    WITH c AS ({plain(CATEGORIES)})
    SELECT o_orderkey, {case_of("code", fv.TUMOR_TYPE_CODES, "code")} AS code,
      {case_of("spelling", fv.TUMOR_TYPE_SPELLINGS, "CASE WHEN spelling = 'Endometrial Carcinoma ' THEN 'Endometrial Carcinoma' ELSE spelling END")} AS spelling,
      {case_of("export_class", fv.EXPORT_CONSEQUENCES, "export_class")} AS export_class,
      {case_of("strict_class", fv.STRICT_CONSEQUENCES, "NULL")} AS strict_class
    FROM c
    """,
)
def recode_categories(spark, sf_dir):
    df = bind(spark, sf_dir, CATEGORIES)
    return df.select(
        "o_orderkey",
        text.recode(F.col("code"), fv.TUMOR_TYPE_CODES).alias("code"),
        F.rtrim(text.recode(F.col("spelling"), fv.TUMOR_TYPE_SPELLINGS)).alias("spelling"),
        text.recode(F.col("export_class"), fv.EXPORT_CONSEQUENCES).alias("export_class"),
        text.recode(F.col("strict_class"), fv.STRICT_CONSEQUENCES, strict=True).alias("strict_class"),
    )


RAW_CLASSES = [
    "Missense_Mutation", "missense", "Splice_Site_SNP", "Frame_Shift_Del", "In_Frame_Ins",
    "Synonymous", "Nonsense_Mutation", "Silent", "Nonstop_Mutation", "Translation_Start_Site",
    "De_novo_Start", "splice_site_missense",
]
CLASS_ROWS = f"""
SELECT l_orderkey, l_linenumber, {pick("l_orderkey + l_suppkey * 5 + l_linenumber", RAW_CLASSES)} AS raw_class
FROM {{lineitem}}
"""


@query(
    "substring_classify",
    f"""
    WITH r AS ({plain(CLASS_ROWS)}), l AS (SELECT *, lower(raw_class) AS s FROM r)
    SELECT l_orderkey, l_linenumber, CASE
      WHEN contains(s, 'missense') THEN 'Missense_Mutation' WHEN contains(s, 'splice_site') THEN 'Splice_Site'
      WHEN contains(s, 'frame_shift') THEN 'Frame_Shift_Indel' WHEN contains(s, 'in_frame') THEN 'In_Frame_Indel'
      WHEN contains(s, 'synonymous') THEN 'Silent' WHEN contains(s, 'nonsense') THEN 'Nonsense_Mutation'
      WHEN contains(s, 'silent') THEN 'Silent' WHEN contains(s, 'nonstop') THEN 'Nonstop_Mutation'
      WHEN contains(s, 'translation_start_site') THEN 'Translation_Start_Site' ELSE raw_class END AS class
    FROM l
    """,
)
def substring_classify(spark, sf_dir):
    df = bind(spark, sf_dir, CLASS_ROWS)
    return df.select(
        "l_orderkey", "l_linenumber",
        text.first_substring(F.col("raw_class"), fv.CONSEQUENCE_SUBSTRINGS).alias("class"),
    )


CODING_ROWS = f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN 'Unknown' WHEN l_suppkey % 11 = 1 THEN CAST(NULL AS STRING) ELSE 'S' || CAST(l_suppkey AS STRING) END AS sample,
  {pick("l_partkey + l_linenumber", ["IGR", "Missense", "5'UTR", "RNA", "3'Flank", "Intron", "Silent", "Unknown", "Non-coding_Transcript", "x5'UTR", None])} AS class
FROM {{lineitem}}
"""


@query(
    "filter_noncoding",
    f"""
    SELECT * FROM ({plain(CODING_ROWS)}) c
    WHERE coalesce(class NOT IN ('IGR', 'Unknown', 'Intron', 'RNA', 'Non-coding_Transcript')
      AND NOT (substr(class, 1, 2) IN ('3''', '5''')), true) AND coalesce(sample <> 'Unknown', true)
    """,
)
def filter_noncoding(spark, sf_dir):
    rows = bind(spark, sf_dir, CODING_ROWS)
    return rows.filter(text.is_coding(F.col("class")) & text.is_placed(F.col("sample")))


STATUS_ROWS = """
SELECT event_id, value,
  'G' || CAST(user_id AS STRING) || CASE WHEN user_id % 11 = 3 THEN '_ENST' || CAST(user_id AS STRING) ELSE '' END AS gene,
  CASE WHEN event_id % 4 = 0 THEN 'n' ELSE 'y' END AS genome_wide,
  CASE event_type WHEN 'error' THEN 'Confirmed GERMLINE variant' WHEN 'signup' THEN 'Variant of Unknown origin'
    ELSE 'Confirmed somatic variant' END AS status
FROM {events}
"""


@query(
    "filter_status",
    f"""
    SELECT * FROM ({plain(STATUS_ROWS)}) s
    WHERE genome_wide = 'y' AND position('_ENST' IN gene) = 0
      AND position('germline' IN lower(status)) = 0 AND position('unknown' IN lower(status)) = 0
    """,
)
def filter_status(spark, sf_dir):
    df = bind(spark, sf_dir, STATUS_ROWS)
    return df.filter(
        (F.col("genome_wide") == "y")
        & ~F.col("gene").contains("_ENST")
        & text.status_allowed(F.col("status"))
    )


INFORMATIVE_ROWS = f"""
SELECT l_orderkey, l_linenumber, coalesce(protein_change, '') AS protein_change,
  coalesce(dna_change, '') AS dna_change,
  CASE WHEN l_linenumber = 3 THEN 'UNKNOWN' ELSE 'Confirmed somatic' END AS status
FROM {{mutations}}
"""


@query(
    "filter_uninformative",
    f"""
    SELECT * FROM ({plain(INFORMATIVE_ROWS)}) m
    WHERE protein_change <> '' AND dna_change <> '' AND (protein_change <> 'p.?' OR dna_change <> 'c.?')
      AND lower(status) NOT LIKE '%unknown%'
    """,
)
def filter_uninformative(spark, sf_dir):
    df = bind(spark, sf_dir, INFORMATIVE_ROWS)
    return df.filter(
        text.is_informative(F.col("protein_change"), F.col("dna_change"), F.col("status"))
    )


BARCODES = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'P-' ELSE 'TCGA-' END || CAST(c_custkey AS STRING)
  || CASE WHEN c_custkey % 2 = 0 THEN '-01A' ELSE '-Tumor' END AS sample
FROM {customer}
"""


@query(
    "truncate_barcode",
    f"""
    SELECT c_custkey, CASE WHEN sample LIKE 'TCGA%' THEN regexp_replace(sample, '-[A-Za-z0-9]+$', '')
      ELSE sample END AS sample FROM ({plain(BARCODES)}) b
    """,
)
def truncate_barcode(spark, sf_dir):
    df = bind(spark, sf_dir, BARCODES)
    return df.select("c_custkey", text.truncate_barcode(F.col("sample")).alias("sample"))


@query(
    "strip_suffix",
    f"""
    SELECT c_custkey, regexp_replace(sample, '-Tumor$', '') AS sample,
      CASE WHEN lower(sample) LIKE '%tumor%' THEN trim(sample, '-Tumor') ELSE sample END AS stripped
    FROM ({plain(BARCODES)}) b
    """,
)
def strip_suffix(spark, sf_dir):
    df = bind(spark, sf_dir, BARCODES)
    return df.select(
        "c_custkey",
        text.strip_suffix(F.col("sample")).alias("sample"),
        text.strip_characters(F.col("sample")).alias("stripped"),
    )


LOCI = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN CAST(NULL AS STRING)
  ELSE CAST(l_suppkey % 24 + 1 AS STRING) || ':' || CAST(l_partkey * 10 AS STRING) || '-' || CAST(l_partkey * 10 + l_linenumber AS STRING)
  END AS locus
FROM {lineitem}
"""


@query(
    "parse_locus",
    f"""
    SELECT l_orderkey, l_linenumber, coalesce(split_part(locus, ':', 1), '') AS chromosome,
      coalesce(CAST(split_part(split_part(locus, ':', 2), '-', 1) AS BIGINT), -1) AS start_position,
      coalesce(CAST(split_part(split_part(locus, ':', 2), '-', 2) AS BIGINT), -1) AS end_position
    FROM ({plain(LOCI)}) l
    """,
)
def parse_locus(spark, sf_dir):
    df = bind(spark, sf_dir, LOCI)
    parts = text.parse_locus(F.col("locus"))
    return df.select(
        "l_orderkey", "l_linenumber", parts["chromosome"].alias("chromosome"),
        parts["start"].alias("start_position"), parts["end"].alias("end_position"),
    )


ALLELES = f"""
SELECT l_orderkey, l_linenumber, l_partkey * 10 AS start_position,
  CAST(l_suppkey % 24 + 1 AS STRING) AS chromosome,
  {pick("l_orderkey + l_linenumber", ["Missense_Mutation", "In_Frame_Del", "Frame_Shift_Del", "In_Frame_Ins", "Frame_Shift_Ins"])} AS class,
  CASE WHEN l_suppkey % 5 = 1 THEN '-' ELSE substr('ACGTACGTAC', 1, CAST(l_suppkey % 7 AS INT) + 1) END AS reference,
  CASE WHEN l_suppkey % 5 = 2 THEN '-' ELSE substr('TGCATGCATG', 1, CAST(l_partkey % 5 AS INT) + 1) END AS allele
FROM {{lineitem}}
"""


@query(
    "variant_end",
    f"""
    SELECT l_orderkey, l_linenumber,
      CASE WHEN class IN ('In_Frame_Del', 'Frame_Shift_Del') THEN start_position + length(reference) - 1
        WHEN class IN ('In_Frame_Ins', 'Frame_Shift_Ins') THEN start_position + 1 ELSE start_position END AS end_by_class,
      CASE WHEN allele = '-' THEN start_position + length(reference) - 1
        WHEN reference = '-' THEN start_position + 1 ELSE start_position END AS end_by_allele
    FROM ({plain(ALLELES)}) a
    """,
)
def variant_end(spark, sf_dir):
    df = bind(spark, sf_dir, ALLELES)
    start, ref, alt = F.col("start_position"), F.col("reference"), F.col("allele")
    return df.select(
        "l_orderkey", "l_linenumber",
        text.end_by_class(F.col("class"), start, ref).alias("end_by_class"),
        text.end_by_allele(start, ref, alt).alias("end_by_allele"),
    )


SYNTHESIS = f"""
SELECT a.*, start_position % 400 + 1 AS residue_position,
  CASE CAST((l_orderkey + l_linenumber * 3) % 11 AS INT) WHEN 0 THEN 'SY' WHEN 1 THEN 'SL' WHEN 2 THEN 'SG' WHEN 3 THEN 'MS'
    WHEN 4 THEN 'CS' WHEN 5 THEN 'II' WHEN 6 THEN 'ID' WHEN 7 THEN 'FI' WHEN 8 THEN 'FD' WHEN 9 THEN 'XX' END AS code
FROM ({ALLELES}) a
"""


@query(
    "synth_change_string",
    f"""
    SELECT l_orderkey, l_linenumber, CASE
      WHEN code IN ('SY', 'SL', 'SG', 'MS', 'CS') THEN format('p.{{}}{{}}{{}}', substr(reference, 1, 1), residue_position, substr(allele, 1, 1))
      WHEN code = 'II' THEN format('p.K{{}}_K{{}}ins{{}}', residue_position, residue_position + 1, repeat('K', (length(allele) - 1) // 3))
      WHEN code = 'ID' THEN format('p.K{{}}_K{{}}del{{}}', residue_position, residue_position + length(reference) // 3 - 1, repeat('K', length(reference) // 3))
      WHEN code IN ('FI', 'FD') THEN format('p.K{{}}fs*', residue_position)
      WHEN code IS NULL THEN 'p.?' END AS protein_change
    FROM ({plain(SYNTHESIS)}) s
    """,
)
def synth_change_string(spark, sf_dir):
    df = bind(spark, sf_dir, SYNTHESIS)
    change = text.synthesise_change(
        F.col("code"), F.col("residue_position"),
        F.substring("reference", 1, 1), F.substring("allele", 1, 1),
        F.col("reference"), F.col("allele"),
    )
    return df.select("l_orderkey", "l_linenumber", change.alias("protein_change"))


TOKENS = """
SELECT l_orderkey, l_linenumber, 'p.K' || CAST(l_suppkey AS STRING) ||
  CASE WHEN l_linenumber = 1 THEN 'In_Frame_Ins' WHEN l_linenumber = 2 THEN 'in_frame_del'
    WHEN l_linenumber = 3 THEN 'IN_FRAME_INSin_frame_del' WHEN l_linenumber = 4 THEN CAST(NULL AS STRING) ELSE 'R' END AS change
FROM {lineitem}
"""


@query(
    "fix_change_tokens",
    f"""
    SELECT l_orderkey, l_linenumber, CASE
      WHEN lower(change) LIKE '%in\\_frame\\_ins%' ESCAPE '\\' THEN regexp_replace(change, 'in_frame_ins', 'ins', 'gi')
      ELSE regexp_replace(change, 'in_frame_del', 'del', 'gi') END AS change
    FROM ({plain(TOKENS)}) t
    """,
)
def fix_change_tokens(spark, sf_dir):
    df = bind(spark, sf_dir, TOKENS)
    return df.select("l_orderkey", "l_linenumber", text.fix_change_tokens(F.col("change")).alias("change"))


@query(
    "variant_export",
    f"""
    WITH v AS (SELECT *, contains(reference, '-') OR contains(allele, '-') AS indel FROM ({plain(ALLELES)}) a)
    SELECT row_number() OVER (ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|'
        || CAST(start_position AS VARCHAR) || '|' || reference || '|' || allele)) - 1 AS row_id,
      'chr' || CASE chromosome WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE chromosome END AS chromosome,
      start_position, '+' AS strand,
      CASE WHEN indel THEN 'A' || replace(reference, '-', '') ELSE reference END AS reference_base,
      CASE WHEN indel THEN 'A' || replace(allele, '-', '') ELSE allele END AS new_base
    FROM v
    """,
)
def variant_export(spark, sf_dir):
    df = bind(spark, sf_dir, ALLELES)
    ref, alt = text.anchored_alleles(F.col("reference"), F.col("allele"))
    keys = ["l_orderkey", "l_linenumber", "start_position", "reference", "allele"]
    return hashed_row_number(df, keys, output="row_id").select(
        (F.col("row_id") - 1).alias("row_id"),
        text.chromosome_name(F.col("chromosome")).alias("chromosome"),
        "start_position", F.lit("+").alias("strand"),
        ref.alias("reference_base"), alt.alias("new_base"),
    )


# Customers with the total of their urgent finished orders; most have none.
TOTALS = """
SELECT c.c_custkey, c.c_acctbal, t.n_orders, t.total
FROM {customer} c LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
  FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey
) t ON c.c_custkey = t.o_custkey
"""


@query(
    "fill_constant",
    f"""
    SELECT c_custkey, coalesce(n_orders, -1) AS n_orders, coalesce(total, 0) AS total
    FROM ({plain(TOTALS)}) t
    """,
)
def fill_constant(spark, sf_dir):
    df = bind(spark, sf_dir, TOTALS).select("c_custkey", "n_orders", "total")
    return cleaning.fill_constant(df, {"n_orders": -1, "total": 0.0})


@query(
    "impute_mean",
    f"""
    WITH t AS ({plain(TOTALS)})
    SELECT c_custkey, round(coalesce(CAST(n_orders AS DOUBLE), (SELECT avg(n_orders) FROM t)), 6) AS n_orders,
      round(coalesce(total, (SELECT avg(total) FROM t)), 4) AS total
    FROM t
    """,
)
def impute_mean(spark, sf_dir):
    df = bind(spark, sf_dir, TOTALS).select("c_custkey", "n_orders", "total")
    filled = cleaning.impute_mean(df, ["n_orders", "total"])
    return rounded(rounded(filled, "n_orders"), "total", digits=4)


@query(
    "min_count_filter",
    f"""
    WITH t AS ({plain(TOTALS)})
    SELECT c_custkey, n_orders, total, 'at least' AS rule FROM t WHERE coalesce(n_orders, 0) + coalesce(total, 0) >= 200000
    UNION ALL
    SELECT c_custkey, n_orders, total, 'more than' AS rule FROM t WHERE coalesce(n_orders, 0) > 1
    """,
)
def min_count_filter(spark, sf_dir):
    df = bind(spark, sf_dir, TOTALS).select("c_custkey", "n_orders", "total")
    at_least = cleaning.minimum_total(df, ["n_orders", "total"], 200000)
    more = cleaning.minimum_total(df, ["n_orders"], 1, strict=True)
    return at_least.withColumn("rule", F.lit("at least")).unionByName(
        more.withColumn("rule", F.lit("more than"))
    )
