"""Explicit table schemas: types are stated, never inferred.

Sample names made of digits have to stay text, and a file of only whole numbers
must not turn a score into an integer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType()}


def _schema(**groups: list[str]) -> StructType:
    return StructType(
        [StructField(c, _TYPES[kind.split("_")[0]]) for kind, columns in groups.items() for c in columns]
    )


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in snake case, as all operators use them."""
    return df.toDF(*[snake(c) for c in df.columns])


# Headings of the interchange files, in file order.
SUMMARY = _schema(
    string=["Gene", "ID"],
    long=["gene length", "non-silent snv", "silent snv", "nonsense", "lost stop", "splice site",
          "lost start", "missense", "recurrent missense"],
    double=["normalized missense position entropy", "frameshift indel", "inframe indel",
            "normalized mutation entropy", "Total Missense MGAEntropy", "Total Missense VEST Score"],
)
INACTIVATING_TEST = _schema(
    string=["gene"], double=["inactivating p-value"],
)
CLUSTERING_TEST = _schema(
    string=["gene"], double=["entropy p-value", "vest p-value", "combined p-value"],
)
COVARIATES = _schema(
    string=["gene"], double=["expression_CCLE", "replication_time", "HiC_compartment"],
)
NETWORK = _schema(string=["gene"], double=["gene_betweeness", "gene_degree"])
EDGES = _schema(string=["Official Symbol Interactor A", "Official Symbol Interactor B"])
FEATURES = _schema(
    string=["gene"],
    double=["gene length", "silent", "nonsense", "splice site", "missense", "recurrent missense",
            "normalized missense position entropy", "frameshift indel", "inframe indel",
            "normalized mutation entropy", "Mean Missense MGAEntropy", "Mean VEST Score",
            "lost start and stop", "missense to silent", "non-silent to silent",
            "inactivating p-value", "entropy p-value", "vest p-value", "combined p-value",
            "expression_CCLE", "replication_time", "HiC_compartment", "gene_betweeness",
            "gene_degree"],
)
NULL_TABLE = _schema(double=["score", "oncogene p-value", "tsg p-value", "driver p-value"])
MUTATIONS = StructType(
    [
        StructField(name, _TYPES[kind])
        for name, kind in (
            ("Gene", "string"), ("Tumor_Sample", "string"), ("Tumor_Type", "string"),
            ("Chromosome", "string"), ("Start_Position", "long"), ("End_Position", "long"),
            ("Variant_Classification", "string"), ("Reference_Allele", "string"),
            ("Tumor_Allele", "string"), ("Protein_Change", "string"), ("DNA_Change", "string"),
        )
    ]
)

FEATURE_NAMES = [snake(f.name) for f in FEATURES.fields[1:]]
