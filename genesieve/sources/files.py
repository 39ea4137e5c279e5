"""Text files: tables with a header, value lists, one file per key, sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_TSV = {"sep": "\t", "header": True}


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Columns of ``schema`` from tab-separated files with a header.

    Columns are matched by heading; a file may have others, in any order, and may lack
    some, which are then null where another file has them and else left out.  Files given
    as a list are read by groups of equal headings.  The files of one folder must have one
    heading: another one fails the job and never swaps columns.
    """
    known = {f.name: f for f in schema.fields}
    by_heading: dict[tuple[str, ...], list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_heading.setdefault(tuple(spark.read.options(**_TSV).csv(one).columns), []).append(one)
    parts = []
    for heading, paths in by_heading.items():
        full = StructType([known.get(c, StructField(c, StringType())) for c in heading])
        rows = spark.read.options(**_TSV, nullValue="", enforceSchema=False).schema(full).csv(paths)
        parts.append(rows.select(*[F.col(f"`{f.name}`") for f in schema.fields if f.name in heading]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*[F.col(f"`{f.name}`") for f in schema.fields if f.name in whole.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_TSV, nullValue="").csv(path)


def read_value_list(
    spark: SparkSession, path: str, column: str = "value", comments: bool = False
) -> DataFrame:
    """One value per line, white space stripped; ``#`` lines skipped if asked for."""
    lines = spark.read.text(path)
    if comments:
        lines = lines.filter(~F.col("value").startswith("#"))
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias(column))


def _without_preamble(lines: DataFrame, preamble: int) -> DataFrame:
    """``file, line`` without the first lines of every file, from ``file, block, line``.

    A scan yields the lines of a split in order and one split after the other, so counting the
    lines of a split that begins its file is enough: no line moves, and splits inside a file
    pass as they are.  A preamble lies in a file's first split.
    """

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.append(True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])))
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if (files[a], blocks[a]) != at:
                    at, seen = (files[a], blocks[a]), 0
                if blocks[a] == 0:
                    keep[a : min(b, a + max(0, preamble - seen))] = False
                seen += b - a
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(2).filter(kept)], names=["file", "line"])

    return lines.select("file", "block", "line").mapInArrow(skip, "file string, line string")


def read_keyed_files(
    spark: SparkSession,
    path: str,
    key_pattern: str = r"([^/]+)\.tsv$",
    preamble: int = 0,
    exclude: str | None = "_ENST",
    glob: str | None = None,
) -> DataFrame:
    """``(key, line)`` of all files below ``path``, the key taken from the file path.

    The first ``preamble`` lines of every file are skipped and files whose key
    contains ``exclude`` are left out.  Large files stay splittable, and files are read by
    Spark's own reader, wherever they are stored.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    if preamble:
        lines = _without_preamble(lines, preamble)
    rows = lines.select(F.regexp_extract("file", key_pattern, 1).alias("key"), "line")
    return rows.filter(~F.col("key").contains(exclude)) if exclude else rows


def sequence_lengths(
    spark: SparkSession, path: str, key_pattern: str = r"([^/]+)_protein\.[^/.]+$",
    exclude: str | None = "_ENST",
) -> DataFrame:
    """``(key, length)``: residues per sequence file, header line and breaks not counted.

    The key is cut from the file name by a suffix pattern.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True).text(path)
        .select("value", F.regexp_extract("_metadata.file_path", key_pattern, 1).alias("key"))
        .filter(F.col("key") != "")
    )
    if exclude:
        rows = rows.filter(~F.col("key").contains(exclude))
    residues = F.when(F.col("value").startswith(">"), 0).otherwise(F.length("value"))
    return rows.groupBy("key").agg(F.sum(residues).alias("length"))
