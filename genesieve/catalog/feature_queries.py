"""Annotation of changes, consequence counts, and the feature matrix."""

from pyspark.sql import functions as F

from ..functions import hgvs
from ..operators import features
from ..session import settle
from .base import bind, mutations, plain, query, rounded

# The annotation rules once more, as SQL.
PROTEIN = f"""
  mutation AS (SELECT * FROM {plain('{mutations}')}),
  body AS (
    SELECT *, CASE WHEN u LIKE 'P.%' THEN substr(u, 3) ELSE u END AS s
    FROM (SELECT *, replace(upper(protein_change), '>', '') AS u FROM mutation) x),
  form AS (
    SELECT *, CASE
      WHEN protein_change IS NULL OR position('P.' IN upper(protein_change)) = 0 THEN 'none'
      WHEN s IN ('?', '(=)', '=', '0', '0?') OR position('(' IN s) > 0 THEN 'effect'
      WHEN regexp_matches(s, '^\\*\\d+[A-Z?]+\\*?$') THEN 'lost stop'
      WHEN regexp_matches(s, '^[A-Z?]0*1[A-Z?]$') AND s[1] <> s[-1] THEN 'lost start'
      WHEN regexp_matches(s, '^[A-Z?]\\d+[A-Z?]$') THEN 'replaced'
      WHEN contains(protein_change, 'ins') THEN 'insertion'
      WHEN contains(protein_change, 'del') THEN 'deletion'
      WHEN contains(protein_change, 'fs') OR regexp_matches(protein_change, '[A-Z]\\d+[A-Z]+\\*') THEN 'shift'
      WHEN regexp_matches(s, '.\\*$') THEN 'nonsense' ELSE 'none' END AS form,
      TRY_CAST(regexp_extract(s, '[A-Z*](\\d+)', 1) AS BIGINT) AS shift_pos,
      TRY_CAST(regexp_extract(s, '\\*(\\d+)$', 1) AS BIGINT) AS shift_stop,
      CASE WHEN regexp_matches(s, '^.\\d+\\*$') THEN TRY_CAST(regexp_extract(s, '^.(\\d+)\\*$', 1) AS BIGINT) END AS nonsense_pos,
      position('?' IN s) > 0 AS question
    FROM body),
  parsed AS (
    SELECT *, form = 'shift' AND shift_pos IS NOT NULL
      AND (shift_stop IS NOT NULL OR NOT regexp_matches(s, '.\\*\\d*$')) AS shift_ok,
      form IN ('insertion', 'deletion') AND NOT question AS indel_ok
    FROM form),
  protein AS (
    SELECT *, CASE
      WHEN form = 'none' OR (form = 'nonsense' AND nonsense_pos IS NULL) THEN 'not valid'
      WHEN s IN ('?', '(=)', '=') OR position('(' IN s) > 0 THEN 'unknown effect'
      WHEN s IN ('0', '0?') THEN 'no protein'
      WHEN question OR (form = 'shift' AND NOT shift_ok) THEN 'missing'
      WHEN form = 'lost stop' THEN 'Nonstop_Mutation'
      WHEN form = 'lost start' THEN 'Translation_Start_Site'
      WHEN (form = 'replaced' AND s[1] = s[-1]) OR (form = 'nonsense' AND s[1] = '*') THEN 'Silent'
      WHEN form = 'replaced' THEN 'Missense_Mutation'
      WHEN form IN ('insertion', 'deletion') THEN 'In_Frame_Indel'
      WHEN form = 'nonsense' THEN 'Nonsense_Mutation' ELSE 'Frame_Shift_Indel' END AS protein_class,
      CASE WHEN form = 'lost stop' THEN CAST(regexp_extract(s, '^\\*(\\d+)', 1) AS BIGINT)
        WHEN form IN ('lost start', 'replaced') THEN CAST(regexp_extract(s, '\\d+') AS BIGINT)
        WHEN indel_ok THEN TRY_CAST(regexp_extract_all(s, '[A-Z](\\d+)', 1)[1] AS BIGINT)
        WHEN shift_ok THEN shift_pos WHEN form = 'nonsense' THEN nonsense_pos END AS protein_pos,
      CASE WHEN indel_ok THEN TRY_CAST(regexp_extract_all(s, '[A-Z](\\d+)', 1)[2] AS BIGINT) END AS protein_pos2,
      nullif(CASE WHEN form IN ('lost stop', 'lost start', 'replaced', 'shift', 'nonsense') THEN s[1]
        WHEN indel_ok THEN array_to_string(regexp_extract_all(s, '([A-Z])\\d+', 1)[1:2], '') END, '') AS protein_initial,
      nullif(CASE WHEN form = 'lost stop' THEN regexp_extract(s, '([A-Z?*]+)$', 1)
        WHEN form IN ('lost start', 'replaced') THEN s[-1]
        WHEN indel_ok AND form = 'insertion' THEN trim(regexp_extract(s, 'INS([A-Z0-9?*]+)', 1), '?')
        WHEN indel_ok THEN regexp_extract(s, 'DEL([A-Z]*)', 1)
        WHEN form = 'nonsense' THEN '*' END, '') AS protein_mutated,
      CASE WHEN shift_ok AND regexp_matches(s, '.\\*\\d*$') THEN shift_stop WHEN form = 'nonsense' THEN 0 END AS protein_stop_pos
    FROM parsed)
"""

DNA = f"""
  dna_body AS (
    SELECT *, CASE WHEN dna_change LIKE 'c.%' THEN substr(dna_change, 3) ELSE dna_change END AS d
    FROM {plain('{mutations}')}),
  dna_kind AS (
    SELECT *, CASE WHEN contains(d, '>') THEN 'substitution' WHEN contains(d, 'del') THEN 'deletion'
      WHEN contains(d, 'ins') THEN 'insertion' END AS kind FROM dna_body),
  dna_groups AS (
    SELECT *, CASE kind
      WHEN 'substitution' THEN regexp_extract(d, '(?:(\\d+)([+-]\\d+)?_)?(\\d+)([+-]\\d+)?([A-Z]+)>([A-Z]+)$', ['a', 'b', 'c', 'e', 'x', 'y'])
      WHEN 'deletion' THEN regexp_extract(d, '(?:([0-9?]+)([-+]\\d+)?(?:_))?([0-9?]+)([-+]\\d+)?del([A-Z?0-9]+)()$', ['a', 'b', 'c', 'e', 'x', 'y'])
      WHEN 'insertion' THEN regexp_extract(d, '(?:([0-9?]+)([-+]\\d+)?(?:_))?([0-9?]+)([-+]\\d+)?ins()([A-Z?0-9]+)$', ['a', 'b', 'c', 'e', 'x', 'y'])
      END AS g FROM dna_kind),
  dna_numbers AS (
    SELECT *, coalesce(g.a, '') <> '' AS ranged, coalesce(g.c, '') <> '' AS matched,
      TRY_CAST(g.a AS BIGINT) AS p1, TRY_CAST(g.c AS BIGINT) AS p2,
      TRY_CAST(replace(g.b, '+', '') AS BIGINT) AS i1, TRY_CAST(replace(g.e, '+', '') AS BIGINT) AS i2,
      lower(d) IN ('?', 'c.?') OR d LIKE '(%' AS unknown FROM dna_groups),
  dna AS (
    SELECT *, CASE WHEN d IS NULL OR (kind IS NULL AND NOT unknown) OR (kind = 'substitution' AND NOT matched) THEN 'not valid'
        WHEN unknown THEN 'unknown effect' WHEN contains(d, '?') THEN 'missing' ELSE kind END AS dna_class,
      CASE WHEN ranged THEN p1 ELSE p2 END AS dna_pos, CASE WHEN ranged THEN p2 END AS dna_pos2,
      CASE WHEN ranged THEN i1 ELSE i2 END AS dna_intron, CASE WHEN ranged THEN i2 END AS dna_intron2,
      nullif(g.x, '') AS dna_initial, nullif(g.y, '') AS dna_mutated,
      matched AND CASE WHEN ranged
        THEN (coalesce(i1, 0) <> 0 AND i1 BETWEEN -2 AND 2) OR (coalesce(i2, 0) <> 0 AND i2 BETWEEN -2 AND 2)
          OR (coalesce(i1, 0) = 0 AND coalesce(i2, 0) > 2) OR (coalesce(i1, 0) < -2 AND coalesce(i2, 0) = 0)
        ELSE coalesce(i2 BETWEEN -2 AND 2, false) END AS dna_splice
    FROM dna_numbers)
"""

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEY_TEXT = ", ".join(KEYS)
_PROTEIN_OUT = [f"protein_{c}" for c in ("class", "pos", "pos2", "initial", "mutated", "stop_pos")]
_DNA_OUT = [
    f"dna_{c}" for c in ("class", "pos", "pos2", "intron", "intron2", "initial", "mutated", "splice")
]


@query(
    "annotate_protein_change",
    f"WITH {PROTEIN} SELECT {_KEY_TEXT}, protein_change, {', '.join(_PROTEIN_OUT)} FROM protein",
)
def annotate_protein_change(spark, sf_dir):
    rows = mutations(spark, sf_dir).select(*KEYS, "protein_change")
    return hgvs.annotate_protein(rows, "protein_change")


@query(
    "annotate_dna_change",
    f"WITH {DNA} SELECT {_KEY_TEXT}, dna_change, {', '.join(_DNA_OUT)} FROM dna",
)
def annotate_dna_change(spark, sf_dir):
    rows = mutations(spark, sf_dir).select(*KEYS, "dna_change")
    return hgvs.annotate_dna(rows, "dna_change")


def annotated(spark, sf_dir):
    """Mutations with their consequence class and protein position."""
    rows = mutations(spark, sf_dir)
    rows = hgvs.annotate_protein(rows, "protein_change")
    rows = hgvs.annotate_dna(rows, "dna_change")
    category = hgvs.consequence(F.col("protein_class"), F.col("dna_splice"), F.col("known_type"))
    return rows.withColumn("class", category)


# A splice hit, found from the DNA change or known before, overrides the class.
ANNOTATED = f"""
  {PROTEIN}, {DNA.replace(plain('{mutations}'), 'protein')},
  annotated AS (
    SELECT *, CASE WHEN dna_splice OR known_type = 'Splice_Site' THEN 'Splice_Site' ELSE protein_class END AS class
    FROM dna)
"""


@query(
    "consequence_counts",
    f"WITH {ANNOTATED} SELECT gene, class, count(*) AS n FROM annotated GROUP BY gene, class",
)
def consequence_counts(spark, sf_dir):
    return features.class_counts(annotated(spark, sf_dir), "class", ["gene"])


@query(
    "consequence_counts_wide",
    f"""
    WITH {ANNOTATED} SELECT gene,
      count(*) FILTER (class = 'Silent') AS silent, count(*) FILTER (class = 'Nonsense_Mutation') AS nonsense,
      count(*) FILTER (class = 'Nonstop_Mutation') AS lost_stop, count(*) FILTER (class = 'Translation_Start_Site') AS lost_start,
      count(*) FILTER (class = 'Missense_Mutation') AS missense, count(*) FILTER (class = 'Splice_Site') AS splice_site,
      count(*) FILTER (class = 'In_Frame_Indel') AS inframe_indel, count(*) FILTER (class = 'Frame_Shift_Indel') AS frameshift_indel
    FROM annotated GROUP BY gene
    """,
)
def consequence_counts_wide(spark, sf_dir):
    return features.class_counts_wide(annotated(spark, sf_dir), "gene", "class")


SUMMARY = f"""
  {ANNOTATED},
  sites AS (SELECT gene, class, protein_pos, count(*) AS c FROM annotated GROUP BY ALL),
  counts AS (
    SELECT gene,
      CAST(sum(c) FILTER (class = 'Silent') AS BIGINT) AS silent, CAST(sum(c) FILTER (class = 'Nonsense_Mutation') AS BIGINT) AS nonsense,
      CAST(sum(c) FILTER (class = 'Nonstop_Mutation') AS BIGINT) AS lost_stop, CAST(sum(c) FILTER (class = 'Translation_Start_Site') AS BIGINT) AS lost_start,
      CAST(sum(c) FILTER (class = 'Missense_Mutation') AS BIGINT) AS missense, CAST(sum(c) FILTER (class = 'Splice_Site') AS BIGINT) AS splice_site,
      CAST(sum(c) FILTER (class = 'In_Frame_Indel') AS BIGINT) AS inframe_indel, CAST(sum(c) FILTER (class = 'Frame_Shift_Indel') AS BIGINT) AS frameshift_indel,
      CAST(sum(c) FILTER (class = 'Missense_Mutation' AND protein_pos IS NOT NULL AND c >= 2) AS BIGINT) AS recurrent_missense
    FROM sites GROUP BY gene),
  filled AS (SELECT gene, coalesce(COLUMNS(* EXCLUDE gene), 0) FROM counts),
  missense_sites AS (SELECT gene, protein_pos, sum(c) AS c FROM sites WHERE class = 'Missense_Mutation' AND protein_pos IS NOT NULL GROUP BY ALL),
  missense_entropy AS (
    SELECT gene, CASE WHEN n > 1 THEN h / log2(n) ELSE 0 END AS normalized_missense_position_entropy FROM (
      SELECT gene, -sum(c / n * log2(c / n)) AS h, any_value(n) AS n
      FROM (SELECT *, sum(c) OVER (PARTITION BY gene) AS n FROM missense_sites) x GROUP BY gene) y),
  all_sites AS (SELECT gene, class, protein_pos, c FROM sites WHERE protein_pos IS NOT NULL),
  all_entropy AS (
    SELECT gene, CASE WHEN n > 1 THEN h / log2(n) ELSE 0 END AS normalized_mutation_entropy FROM (
      SELECT gene, -sum(c / n * log2(c / n)) AS h, any_value(n) AS n
      FROM (SELECT *, sum(c) OVER (PARTITION BY gene) AS n FROM all_sites) x GROUP BY gene) y),
  scores AS (
    SELECT gene, CAST(sum(quantity) FILTER (class = 'Missense_Mutation') AS DOUBLE) AS total_missense_mgaentropy,
      coalesce(sum((quantity % 8) / 8) FILTER (class = 'Missense_Mutation'), 0) AS total_missense_vest_score
    FROM annotated GROUP BY gene),
  summary AS (
    SELECT f.*, nonsense + lost_stop + lost_start + missense + splice_site AS non_silent_snv,
      coalesce(normalized_missense_position_entropy, 0) AS normalized_missense_position_entropy,
      coalesce(normalized_mutation_entropy, 0) AS normalized_mutation_entropy,
      total_missense_mgaentropy, total_missense_vest_score
    FROM filled f LEFT JOIN missense_entropy USING (gene) LEFT JOIN all_entropy USING (gene) JOIN scores USING (gene))
"""
_SUMMARY_OUT = [
    *features.COUNT_COLUMNS, "non_silent_snv", "normalized_missense_position_entropy",
    "normalized_mutation_entropy", "total_missense_mgaentropy", "total_missense_vest_score",
]


def summary(spark, sf_dir):
    """The count summary of each entity, with score sums of its missense mutations."""
    rows = annotated(spark, sf_dir).select("gene", "class", "protein_pos", "quantity")
    missense = F.col("class") == "Missense_Mutation"
    sums = {
        "total_missense_mgaentropy": F.when(missense, F.col("quantity")),
        "total_missense_vest_score": F.when(missense, F.col("quantity") % 8 / 8).otherwise(0),
    }
    counted = features.summarise_entities(rows, "gene", "class", "protein_pos", sums=sums)
    return counted.withColumn("total_missense_mgaentropy", F.col("total_missense_mgaentropy").cast("double"))


@query(
    "entity_summary",
    f"""WITH {SUMMARY} SELECT gene, {", ".join(
        f"round({c}, 9) AS {c}" if "entropy" in c or "vest" in c else c for c in _SUMMARY_OUT)} FROM summary""",
)
def entity_summary(spark, sf_dir):
    return rounded(
        summary(spark, sf_dir).select("gene", *_SUMMARY_OUT),
        *[c for c in _SUMMARY_OUT if "entropy" in c or "vest" in c],
        digits=9,
    )


RATIOS = f"""
  {SUMMARY},
  totals AS (
    SELECT *, silent + nonsense + lost_stop + lost_start + (missense - recurrent_missense) + recurrent_missense
        + splice_site + inframe_indel + frameshift_indel AS t,
      CASE WHEN missense <> 0 THEN total_missense_mgaentropy / missense END AS mga FROM summary),
  ratios AS (
    SELECT gene, normalized_missense_position_entropy, normalized_mutation_entropy,
      coalesce(mga, (SELECT max(mga) FROM totals)) AS mean_missense_mgaentropy,
      (total_missense_vest_score + lost_stop + lost_start + splice_site + frameshift_indel + inframe_indel + nonsense)
        / nullif(non_silent_snv + silent + inframe_indel + frameshift_indel, 0) AS mean_vest_score,
      coalesce(lost_stop / nullif(t, 0), 0) + coalesce(lost_start / nullif(t, 0), 0) AS lost_start_and_stop,
      missense / (silent + 1) AS missense_to_silent,
      (non_silent_snv + inframe_indel + frameshift_indel) / (silent + 1) AS non_silent_to_silent,
      coalesce(silent / nullif(t, 0), 0) AS silent, coalesce(nonsense / nullif(t, 0), 0) AS nonsense,
      coalesce(missense / nullif(t, 0), 0) AS missense, coalesce(recurrent_missense / nullif(t, 0), 0) AS recurrent_missense,
      coalesce(splice_site / nullif(t, 0), 0) AS splice_site, coalesce(inframe_indel / nullif(t, 0), 0) AS inframe_indel,
      coalesce(frameshift_indel / nullif(t, 0), 0) AS frameshift_indel
    FROM totals)
"""
RATIO_COLUMNS = [
    "normalized_missense_position_entropy", "normalized_mutation_entropy", "mean_missense_mgaentropy",
    "mean_vest_score", "lost_start_and_stop", "missense_to_silent", "non_silent_to_silent",
    *features.FRACTION_COLUMNS,
]


def _rounded_list(columns, digits=9):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("feature_ratios", f"WITH {RATIOS} SELECT gene, {_rounded_list(RATIO_COLUMNS)} FROM ratios")
def feature_ratios(spark, sf_dir):
    ratios = features.ratio_features(summary(spark, sf_dir))
    return rounded(ratios.select("gene", *RATIO_COLUMNS), *RATIO_COLUMNS, digits=9)




CENTRED = list(features.CENTRED_COLUMNS)
_COHORT_TOTAL = " + ".join(features.COHORT_COLUMNS)


@query(
    "cohort_center",
    f"""
    WITH {RATIOS}, six_counts AS (SELECT *, {_COHORT_TOTAL} AS six FROM summary WHERE CAST(substr(gene, 2) AS BIGINT) % 2 = 0),
    cohort AS (SELECT {", ".join(f"coalesce({c} / nullif(six, 0), 0) AS {c}" for c in ("nonsense", "silent", "splice_site", "missense"))},
      coalesce(lost_stop / nullif(six, 0), 0) + coalesce(lost_start / nullif(six, 0), 0) AS lost_start_and_stop,
      missense / (silent + 1) AS missense_to_silent FROM six_counts)
    SELECT gene, {", ".join(f"round({c} - (SELECT avg({c}) FROM cohort), 9) AS {c}" for c in CENTRED[:-1])},
      round({CENTRED[-1]} - (SELECT avg({CENTRED[-1]}) FROM ratios), 9) AS {CENTRED[-1]} FROM ratios
    """,
)
def cohort_center(spark, sf_dir):
    counts = settle(summary(spark, sf_dir))
    ratios = settle(features.ratio_features(counts).select("gene", *CENTRED))
    cohort = counts.filter(F.substring("gene", 2, 20).cast("bigint") % 2 == 0)
    return rounded(features.centre_on_cohort(ratios, cohort), *CENTRED, digits=9)


ROLLED = ["silent", "nonsense", "lost_stop_or_start", "missense", "recurrent_missense", "splice_site",
          "inframe_indel", "frameshift_indel"]
DELETERIOUS = ["lost_stop_or_start", "nonsense", "frameshift_indel", "splice_site"]


@query(
    "rollup_normalise",
    f"""
    WITH {SUMMARY}, w AS (SELECT *, lost_stop + lost_start AS lost_stop_or_start FROM summary),
    t AS (SELECT *, {" + ".join(ROLLED)} AS total FROM w)
    SELECT gene, {", ".join(f"round({c} / nullif(total - recurrent_missense, 0), 9) AS {c}" for c in ROLLED)},
      recurrent_missense AS recurrent_count, {" + ".join(DELETERIOUS)} AS deleterious_count
    FROM t WHERE total >= 20
    """,
)
def rollup_normalise(spark, sf_dir):
    wide = summary(spark, sf_dir).withColumn(
        "lost_stop_or_start", F.col("lost_stop") + F.col("lost_start")
    )
    return rounded(
        features.roll_up(wide, "gene", ROLLED, DELETERIOUS, "recurrent_missense", 20), *ROLLED, digits=9
    )


GENE = "'G' || CAST(p_partkey AS STRING) AS gene"
LENGTHS = "SELECT 'G' || CAST(l_partkey AS STRING) AS gene, CAST(sum(l_quantity) AS BIGINT) AS gene_length FROM {lineitem} GROUP BY l_partkey"
INACTIVATING = f"SELECT {GENE}, p_size / 51 AS inactivating_p_value FROM {{part}} WHERE p_partkey % 10 <> 3"
CLUSTERING = f"""
SELECT {GENE}, (p_partkey % 97) / 97 AS entropy_p_value, (p_partkey % 89) / 89 AS vest_p_value, p_size / 60 AS combined_p_value
FROM {{part}} WHERE p_partkey % 7 <> 2
"""
COVARIATES = f"""
SELECT {GENE}, p_retailprice AS expression_ccle, CAST(p_size AS DOUBLE) AS replication_time,
  CAST(p_partkey % 50 - 25 AS DOUBLE) AS hic_compartment FROM {{part}} WHERE p_brand <> 'Brand#1'
"""
NETWORK = """
SELECT 'G' || CAST(l_partkey AS STRING) AS gene, CAST(sum(l_quantity) AS DOUBLE) / 1000 AS gene_betweeness,
  CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS gene_degree
FROM {lineitem} GROUP BY l_partkey
"""


@query(
    "covariate_table",
    f"""
    SELECT * FROM ({plain(LENGTHS)}) l LEFT JOIN ({plain(COVARIATES)}) c USING (gene) LEFT JOIN ({plain(NETWORK)}) n USING (gene)
    """,
)
def covariate_table(spark, sf_dir):
    return features.attach(
        bind(spark, sf_dir, LENGTHS), [bind(spark, sf_dir, COVARIATES), bind(spark, sf_dir, NETWORK)], "gene"
    )


ATTACHED = ["inactivating_p_value", "entropy_p_value", "vest_p_value", "combined_p_value", "expression_ccle",
            "replication_time", "hic_compartment", "gene_betweeness", "gene_degree"]
MATRIX_COLUMNS = ["gene_length", *RATIO_COLUMNS, *ATTACHED]
MATRIX = f"""
  {RATIOS},
  joined AS (
    SELECT r.*, gene_length, * EXCLUDE (gene, gene_length, gene_betweeness, gene_degree, {", ".join(RATIO_COLUMNS)}),
      coalesce(gene_betweeness, 0) AS gene_betweeness, coalesce(gene_degree, 0) AS gene_degree
    FROM ratios r LEFT JOIN ({plain(LENGTHS)}) l USING (gene) LEFT JOIN ({plain(INACTIVATING)}) i USING (gene)
      LEFT JOIN ({plain(CLUSTERING)}) c USING (gene) LEFT JOIN ({plain(COVARIATES)}) v USING (gene) LEFT JOIN ({plain(NETWORK)}) n USING (gene))
"""


def matrix(spark, sf_dir):
    """The imputed feature matrix: consequence ratios, tests, covariates, network."""
    ratios = features.ratio_features(summary(spark, sf_dir))
    tests = [bind(spark, sf_dir, t) for t in (LENGTHS, INACTIVATING, CLUSTERING)]
    return features.feature_matrix(
        ratios, "gene", tests, bind(spark, sf_dir, COVARIATES), bind(spark, sf_dir, NETWORK)
    ).select("gene", *MATRIX_COLUMNS)


@query(
    "feature_matrix",
    f"""
    WITH {MATRIX} SELECT gene, {", ".join(
        f"round(coalesce({c}, (SELECT avg({c}) FROM joined)), 9) AS {c}" for c in MATRIX_COLUMNS)} FROM joined
    """,
)
def feature_matrix(spark, sf_dir):
    return rounded(matrix(spark, sf_dir), *MATRIX_COLUMNS, digits=9)
