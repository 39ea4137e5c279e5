"""Cohort mutation tables: clean, merge by priority, and reduce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import hgvs, text
from ..operators import merging


def clean_export(
    df: DataFrame, only_genome_wide: bool = True, use_unknown_status: bool = False
) -> DataFrame:
    """Harmonise a database export: cohort filters, positions, classes, barcodes."""
    locus = text.parse_locus(F.col("Mutation GRCh37 genome position"))
    rows = df.filter(
        ~F.col("Gene name").contains("_ENST")
        & text.status_allowed(F.col("Mutation somatic status"), use_unknown_status)
    )
    if only_genome_wide:
        rows = rows.filter(F.col("Genome-wide screen") == "y")
    return rows.select(
        F.col("Gene name").alias("Gene"),
        text.truncate_barcode(F.col("Sample name")).alias("Tumor_Sample"),
        F.col("Primary site").alias("Tumor_Type"),
        locus["chromosome"].alias("Chromosome"),
        locus["start"].alias("Start_Position"),
        locus["end"].alias("End_Position"),
        text.recode(F.col("Mutation Description"), fv.EXPORT_CONSEQUENCES).alias("Variant_Classification"),
        F.col("Mutation AA").alias("Protein_Change"),
        F.col("Mutation CDS").alias("DNA_Change"),
    )


def merge_cohorts(
    files: Sequence[DataFrame],
    export: DataFrame | None = None,
    hypermutator_limit: int | None = None,
    sample: str = "Tumor_Sample",
) -> DataFrame:
    """One mutation table from mutation files in order of priority, then an export.

    A missing DNA change becomes ``c.?``.
    """
    merged = merging.prioritise_sources(files, sample)
    if hypermutator_limit is not None:
        merged = merging.drop_hypermutators(merged, sample, hypermutator_limit)
        if export is not None:
            export = merging.drop_hypermutators(export, sample, hypermutator_limit)
    if export is not None:
        merged = merging.append_unseen(merged, export, sample)
    if "DNA_Change" not in merged.columns:
        merged = merged.withColumn("DNA_Change", F.lit(None).cast("string"))
    return merged.withColumn("DNA_Change", F.coalesce("DNA_Change", F.lit("c.?")))


def annotate(df: DataFrame, known_type: str | None = "Variant_Classification") -> DataFrame:
    """Add ``class`` and ``protein_pos`` to a mutation table."""
    rows = hgvs.annotate_protein(df, "Protein_Change")
    rows = hgvs.annotate_dna(rows, "DNA_Change")
    known = F.col(known_type) if known_type else None
    return rows.withColumn(
        "class", hgvs.consequence(F.col("protein_class"), F.col("dna_splice"), known)
    )
