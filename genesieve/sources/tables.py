"""Named tables: replace, read, create empty, and look up one entity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new folder and point the table name at it.

    The data of a named table outlives the session's scratch folder: by default it goes
    below the warehouse.  The old files are left alone, so a table may be replaced by a
    filtered version of itself and running readers keep their data.  Where the columns
    stay the same the name is never without a table.
    """
    spark = df.sparkSession
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if spark.catalog.tableExists(name):
        if spark.table(name).dtypes == df.dtypes:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    return spark.catalog.createTable(name, path=path, source="parquet", schema=df.schema)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def initial_of(key: str):
    """Directory letter of a key: its first letter, or ``0-9``."""
    letter = F.upper(F.substring(key, 1, 1))
    return F.when(letter.rlike("^[0-9]$"), "0-9").otherwise(letter)


def write_by_initial(df: DataFrame, key: str, path: str) -> None:
    """A table partitioned by the first letter of its key."""
    df.withColumn("initial", initial_of(key)).write.mode("overwrite").partitionBy(
        "initial"
    ).parquet(path)


def read_entity(spark: SparkSession, path: str, key: str, entity: str) -> DataFrame:
    """Rows of one entity; only its letter's folder is read."""
    letter = entity[:1].upper()
    initial = "0-9" if letter.isdigit() else letter
    rows = spark.read.parquet(path)
    return rows.filter((F.col("initial") == initial) & (F.col(key) == entity)).drop("initial")
