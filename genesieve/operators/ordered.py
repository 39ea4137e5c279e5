"""Ordered computations over a whole table without a one-task window.

A window with an ORDER BY and no PARTITION BY moves every row into one task, and
one with a hot partition key moves that whole group there.  The operators here
split the order into value ranges, run the window inside each range, and add a
carry taken from a table with one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import settle, shuffle_width

RANGE = "__range"
PART_ROWS = 50_000  # rows that one task orders at once


def split_ranges(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Tag each row with the number of the value range it falls in.

    The bounds are approximate quantiles fixed in one job, with an error of a fifth of
    a range; there are more of them where the table is large.  Where they lie affects
    balance only, never results.  An empty table, or one without a number, is one
    range; null and NaN values are a range of their own.  The table is materialised
    first, since the bounds, the carries and the windows all read it; pass distinct
    values with counts, not raw rows.
    """
    df = settle(df).withColumn("__value", F.col(value).cast("double"))
    ranges = ranges or max(shuffle_width(df.sparkSession), -(-df.count() // PART_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.approxQuantile("__value", cuts, 0.2 / ranges))) if cuts else []
    if not bounds:
        return df.withColumn(RANGE, F.lit(0.0)).drop("__value")
    binner = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol="__value", outputCol=RANGE, handleInvalid="keep"
    )
    return binner.transform(df).drop("__value")


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``min`` or ``max`` of a column along the order."""

    how: str
    column: str
    descending: bool = False
    inclusive: bool = True


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(how: str, local: Column, carry: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.least(local, carry) if how == "min" else F.greatest(local, carry)


def running(
    df: DataFrame, order: str, by: Sequence[str] = (), **outputs: Running
) -> DataFrame:
    """Add running aggregates along ``order`` to a table tagged by ``split_ranges``.

    ``order`` has to be unique within ``by``: aggregate to distinct values first.
    Grouping columns must not be null.
    """
    by = list(by)
    local, totals, carried = {}, {}, {}
    for name, spec in outputs.items():
        key = F.col(order).desc() if spec.descending else F.col(order).asc()
        range_key = F.col(RANGE).desc() if spec.descending else F.col(RANGE).asc()
        last = Window.currentRow if spec.inclusive else -1
        frame = (
            Window.partitionBy(*by, RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, last)
        )
        earlier = (
            Window.partitionBy(*by).orderBy(range_key).rowsBetween(Window.unboundedPreceding, -1)
        )
        aggregate = _AGGREGATE[spec.how]
        local[f"__l_{name}"] = aggregate(spec.column).over(frame)
        totals[f"__t_{name}"] = aggregate(spec.column)
        carried[f"__c_{name}"] = aggregate(f"__t_{name}").over(earlier)
    per_range = df.groupBy(*by, RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    carry = per_range.withColumns(carried).drop(*totals)
    joined = df.withColumns(local).join(carry, [*by, RANGE], "left")
    result = joined.withColumns(
        {
            name: _combine(spec.how, F.col(f"__l_{name}"), F.col(f"__c_{name}"))
            for name, spec in outputs.items()
        }
    )
    return result.drop(*local, *carried)


def hashed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: Sequence[Column | str] = (),
    output: str = "row_number",
    digits: int | None = None,
) -> DataFrame:
    """Contiguous numbers 1..n per group, in the order of the MD5 of a unique key.

    The first hex digits of the hash split every group, also a hot one, into
    ``16 ** digits`` even parts that are numbered apart.  By default there are as many
    digits as keep a part near ``PART_ROWS`` rows; they never change the numbers.
    """
    by = list(by)
    if digits is None:
        df = settle(df)
        rows, digits = df.count(), 1
        while rows > PART_ROWS * 16**digits:
            digits += 1
    df = df.withColumn("__hash", hash_key(*keys, *seed)).withColumn(
        "__part", F.substring("__hash", 1, digits)
    )
    before = (
        Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*by, "__part")
        .agg(F.count(F.lit(1)).alias("__count"))
        .withColumn("__offset", F.coalesce(F.sum("__count").over(before), F.lit(0)))
        .drop("__count")
    )
    inside = Window.partitionBy(*by, "__part").orderBy("__hash", *keys)
    return (
        df.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*by, "__part"], "left")
        .withColumn(output, (F.col("__offset") + F.col("__inside")).cast("bigint"))
        .drop("__hash", "__part", "__inside", "__offset")
    )


def value_rank(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    by: Sequence[str] = (),
    output: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """Rank 1..n of every row by ``value``; ties are broken by a hash of the keys.

    Rows of one value are spread over ``salts`` groups, by default so many that even a
    value shared by all rows is ranked in parts of about ``PART_ROWS``.
    """
    by = list(by)
    if salts is None:
        df = settle(df)
        salts = max(16, -(-df.count() // PART_ROWS))
    salt = F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")
    df = df.withColumn("__salt", salt)
    units = settle(df.groupBy(*by, value, "__salt").agg(F.count(F.lit(1)).alias("__count")))
    values = units.groupBy(*by, value).agg(F.sum("__count").alias("__count"))
    before_value = running(
        split_ranges(values, value),
        value,
        by,
        __before=Running("sum", "__count", inclusive=False),
    ).select(*by, value, "__before")
    before_salt = (
        Window.partitionBy(*by, value)
        .orderBy("__salt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        units.withColumn("__salted", F.coalesce(F.sum("__count").over(before_salt), F.lit(0)))
        .join(before_value, [*by, value])
        .select(*by, value, "__salt", (F.col("__before") + F.col("__salted")).alias("__offset"))
    )
    inside = Window.partitionBy(*by, value, "__salt").orderBy(*keys)
    return (
        df.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*by, value, "__salt"])
        .withColumn(output, (F.col("__offset") + F.col("__inside")).cast("bigint"))
        .drop("__salt", "__inside", "__offset")
    )
