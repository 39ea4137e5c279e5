"""Training classes of entities and quantities derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def label_entities(
    df: DataFrame, key: str, oncogenes: DataFrame, tsgs: DataFrame, output: str = "label"
) -> DataFrame:
    """Class 1 for listed oncogenes, 2 for listed suppressors, 0 otherwise.

    The lists are one-column tables; an entity on both is an oncogene.
    """
    listed = (
        oncogenes.select(F.col(oncogenes.columns[0]).alias(key), F.lit(fv.ONCOGENE).alias(output))
        .unionByName(tsgs.select(F.col(tsgs.columns[0]).alias(key), F.lit(fv.TSG).alias(output)))
        .groupBy(key)
        .agg(F.min(output).alias(output))
    )
    return df.join(listed, key, "left").withColumn(
        output, F.coalesce(F.col(output), F.lit(fv.OTHER))
    )


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def check_classes(df: DataFrame, label: str = "label", classes: int = 3, above: int = 5) -> None:
    """Raise unless at least ``classes`` classes have more than ``above`` members."""
    sufficient = class_sizes(df, label).filter(F.col("n") > above).count()
    if sufficient < classes:
        raise ValueError(
            f"only {sufficient} classes have more than {above} members, {classes} are needed"
        )


def class_size_map(df: DataFrame, label: str = "label") -> Column:
    """Class sizes as one map-valued scalar; as large as the number of classes.

    Looking sizes up in it needs no join, so the largest class is never gathered
    and the rows are not shuffled.
    """
    sizes = class_sizes(df, label)
    entries = F.collect_list(F.struct(F.col(label), F.col("n")))
    return sizes.agg(F.map_from_entries(entries)).scalar()


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = 1 / size of the row's class."""
    size = F.element_at(class_size_map(df, label), F.col(label))
    return df.withColumn("weight", F.lit(1.0) / size)


def sample_sizes(
    df: DataFrame,
    label: str = "label",
    driver_rate: float = 0.7,
    other_ratio: float = 1.0,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Per-class bootstrap sizes.

    Driver classes are scaled by ``driver_rate``; the other class gets
    ``other_ratio`` times their sum, taken before the driver sizes are truncated.
    """
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    scaled = F.col("n") * F.lit(float(driver_rate))
    drivers = F.sum(F.when(F.col(label) != fv.OTHER, scaled).otherwise(F.lit(0.0))).over(
        Window.partitionBy(*by)
    )
    size = F.when(
        F.col(label) == fv.OTHER, F.floor(F.lit(float(other_ratio)) * drivers)
    ).otherwise(F.floor(scaled))
    return sizes.withColumn("sample_size", size.cast("bigint"))
