"""Mutation tables of single publishers brought into the common form.

Each function takes tables as their publisher lays them out and returns the columns of
``schemas.MUTATIONS`` without the DNA change, ready for ``mutations.merge_cohorts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..operators import merging

COLUMNS = (
    "Gene", "Tumor_Sample", "Tumor_Type", "Chromosome", "Start_Position", "End_Position",
    "Variant_Classification", "Reference_Allele", "Tumor_Allele", "Protein_Change",
)


def located_table(df: DataFrame) -> DataFrame:
    """A table whose positions are one ``chromosome:start-end`` column.

    A consequence class outside the known ones is an error: it would otherwise be counted
    as nothing.
    """
    locus = text.parse_locus(F.col("`Genome.position.hg19`"))
    return df.select(
        F.col("Gene"),
        text.truncate_barcode(F.col("Tumor_Sample")).alias("Tumor_Sample"),
        F.col("Tumor_Type"),
        locus["chromosome"].alias("Chromosome"),
        locus["start"].alias("Start_Position"),
        locus["end"].alias("End_Position"),
        text.recode(F.col("Mutation_Type"), fv.STRICT_CONSEQUENCES, strict=True).alias("Variant_Classification"),
        F.col("Reference").alias("Reference_Allele"),
        F.col("Mutation").alias("Tumor_Allele"),
        text.fix_change_tokens(F.col("Protein_Change")).alias("Protein_Change"),
    )


def mappable(df: DataFrame, checks: DataFrame | None, row_id: str = "ID", warning: str = "Mappability Warning") -> DataFrame:
    """Rows of a common table that pass the quality check, tumour types and samples tidied.

    ``checks`` names rows by ``row_id``, which both tables carry; without checks all rows stay.
    """
    kept = df if checks is None else merging.keep_passing(df, checks, row_id, warning)
    return kept.withColumns({
        "Tumor_Type": text.recode(F.col("Tumor_Type"), fv.TUMOR_TYPE_SPELLINGS),
        "Tumor_Sample": text.strip_suffix(F.col("Tumor_Sample")),
    })


_PAN_CANCER = {
    "ttype": "Tumor_Type", "patient": "Tumor_Sample", "gene": "Gene", "type": "Variant_Classification",
    "chr": "Chromosome", "ref_allele": "Reference_Allele", "newbase": "Tumor_Allele", "pos": "Start_Position",
}


def _tidied(df: DataFrame, end: Column) -> DataFrame:
    """End positions from the classes or alleles as published, then classes, names and types."""
    return df.withColumn("End_Position", end.cast("bigint")).withColumns({
        "Variant_Classification": text.first_substring(F.col("Variant_Classification"), fv.CONSEQUENCE_SUBSTRINGS),
        "Chromosome": F.concat(F.lit("chr"), F.col("Chromosome").cast("string")),
        "Tumor_Type": text.recode(F.col("Tumor_Type"), fv.TUMOR_TYPE_CODES),
        "Tumor_Sample": text.strip_suffix(F.col("Tumor_Sample")),
    })


def pan_cancer_table(df: DataFrame, annotation: DataFrame, row_id: str = "ID") -> DataFrame:
    """Coding variants whose protein changes come from an annotation of the same rows.

    Both tables carry ``row_id``.  ``annotation`` has the ontology code, position, residues
    and bases that a change string is made of, and a mappability warning that drops the row.
    """
    change = text.synthesise_change(
        F.col("`Sequence Ontology`"), F.col("`Amino acid position`").cast("bigint"), F.col("`Reference amino acid(s)`"),
        F.col("`Alternate amino acid(s)`"), F.col("`Reference base`"), F.col("`Alternate base`"),
    )
    changes = annotation.filter(F.col("Mappability Warning").isNull()).select(row_id, change.alias("Protein_Change"))
    rows = df.withColumnsRenamed(_PAN_CANCER).join(changes, row_id)
    end = text.end_by_class(F.col("Variant_Classification"), F.col("Start_Position"), F.col("Reference_Allele"))
    return _tidied(rows, end).select(*COLUMNS)


def non_coding_table(df: DataFrame) -> DataFrame:
    """Variants outside genes, which have no protein change."""
    rows = df.withColumnsRenamed(_PAN_CANCER)
    end = text.end_by_allele(F.col("Start_Position"), F.col("Reference_Allele"), F.col("Tumor_Allele"))
    return _tidied(rows, end).select(*COLUMNS[:-1])
