"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    line_dedup, mixing, near_duplicates, packing, pieces, quality_discriminant, quality_rules, repeated_bytes, revisits,
    secret_scan, source_divergence, spelling, top_k,
)
from .common import reachable

Run = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_discriminant.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(revisits.resolve(revisits.captures(_table(spark, sf_dir, "pages"))))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.digest(repeated_bytes.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split("text", "\n", -1))
    before = docs.select("doc_id", "text", lines.alias("n_lines"))
    after = line_dedup.dedup_lines(before)
    return after.select(
        "doc_id", "n_lines", F.length("text").cast("long").alias("n_kept"), F.md5("text").alias("kept_md5")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return pieces.digest(pieces.decode(coded))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op7, which SQL can check."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), None)
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op6, which SQL can check."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents"))).drop("spans")


QUERIES: tuple[Run, ...] = (
    op1_quality_discriminant, op2_revisits, op3_repeated_bytes, op4_best_fit_packing, op5_near_duplicates, op6_secret_scan,
    op7_quality_rules, op8_source_mixing, op9_top_k, op10_line_dedup,
    op11_source_divergence, op12_piece_ids, op13_spelling_variants, quality_rule_counts, secret_base_spans,
)
SQL: dict[str, str] = {
    "op2_revisits": revisits.SQL, "op8_source_mixing": mixing.SQL, "op9_top_k": top_k.SQL, "op10_line_dedup": line_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL, "quality_rule_counts": quality_rules.SQL, "secret_base_spans": secret_scan.SQL,
}


def queries() -> dict[str, Run]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
