"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes all documents that the one before it kept and returns them as its
decisions leave them, with the columns of ``documents``; the last returns packed pieces.
Between stages the documents are written as Parquet and read again.

Rows with a null id pass the stages that compare documents and are otherwise treated like
any other.  Rows are told apart by their id and their text, so rows that share an id stay or go
each by its own text; rows equal in both share what the mix takes of them.  Empty tables pass
all stages.  Extra columns go along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genesieve.llm import line_dedup, mixing, near_duplicates, packing, quality_rules
from genesieve.llm.common import reachable, written

SHINGLE_WORDS = 5
SIMILARITY = 80  # percent


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no column of it can clash, beside its id and its text's fingerprint."""
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
    )


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the n-gram regression reject go."""
    reachable(spark)
    model = quality_rules.fit(docs, _labels(spark, sf_dir))
    return quality_rules.judge(docs, model, whole_rows=True).where("kept").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; ``n_chars`` follows the text."""
    reachable(spark)
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    reachable(spark)
    judged = near_duplicates.judge(docs, width=SHINGLE_WORDS, percent=SIMILARITY)
    gone = written(judged.where("NOT kept").select(F.col("doc_id").alias("gone"), "print").distinct(), "gone")
    rows = _rows(docs)
    same = (rows["id"] == gone["gone"]) & (rows["print"] == gone["print"])
    return rows.join(gone.hint("shuffle_hash"), same, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    reachable(spark)
    mixed = written(mixing.mix_documents(docs), "mixed")
    times = mixed.groupBy(F.col("doc_id").alias("of"), F.col("print").alias("of_print")).agg(
        F.sum(F.coalesce(F.try_divide("taken", "size"), F.lit(0))).cast("int").alias("total"), F.count("*").cast("int").alias("rows")
    )
    times = written(times.where("total > 0"), "times")
    rows = _rows(docs)
    same = rows["id"].eqNullSafe(times["of"]) & (rows["print"] == times["of_print"])
    rows = rows.join(times.hint("shuffle_hash"), same).select("row", "id", "print", "total", "rows")
    even = rows.where("total % rows = 0").select("row", (F.col("total") / F.col("rows")).cast("int").alias("times"))
    # rows equal in id and text between which the mix's edge falls: the first ones take one more
    turn = F.row_number().over(Window.partitionBy("id", "print").orderBy(F.lit(0)))
    uneven = rows.where("total % rows <> 0").withColumn("turn", turn).select(
        "row", (F.floor(F.col("total") / F.col("rows")) + F.when(F.col("turn") <= F.col("total") % F.col("rows"), 1).otherwise(0)).cast("int").alias("times")
    )
    taken = even.unionByName(uneven).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a repeated document is packed each time."""
    reachable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Calibrated scores, sketches and tokens have no SQL form; tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
