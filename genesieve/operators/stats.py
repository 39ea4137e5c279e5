"""Descriptive statistics: entropy, divergence, fits, quantiles, histograms, densities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..session import settle


def group_entropy(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Shannon entropy (bits) of an outcome per group, its maximum and their ratio.

    Counting (group, outcome) first spreads a hot group; the second aggregation
    needs only sum(c) and sum(c log2 c).
    """
    counts = (
        df.filter(F.col(outcome).isNotNull())
        .groupBy(group, outcome)
        .agg(F.count(F.lit(1)).alias("c"))
    )
    folded = counts.groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c"))).alias("w")
    )
    entropy = F.log2(F.col("n")) - F.col("w") / F.col("n")
    ceiling = F.when(F.col("n") > 0, F.log2(F.col("n"))).otherwise(F.lit(0.0))
    return folded.select(
        group,
        "n",
        entropy.alias("entropy"),
        ceiling.alias("max_entropy"),
        F.coalesce(F.try_divide(entropy, ceiling), F.lit(0.0)).alias("pct_of_uniform"),
    )


def _kl_term(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / q)).otherwise(F.lit(0.0))


def divergence(df: DataFrame, outcome: str, first: Column, second: Column) -> DataFrame:
    """KL divergence, JS divergence and JS distance of an outcome between two subsets.

    Both histograms come from one conditional count per outcome, so they are
    aligned without a join.  KL is null when the second misses an outcome of the
    first, where it would be infinite.
    """
    counts = settle(
        df.filter(first | second).groupBy(outcome).agg(
            F.count_if(first).alias("a"), F.count_if(second).alias("b")
        )
    )
    total_a, total_b = counts.agg(F.sum("a"), F.sum("b")).first()
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    shares = counts.select(
        F.try_divide("a", F.lit(total_a)).alias("p"), F.try_divide("b", F.lit(total_b)).alias("q")
    )
    result = shares.agg(
        F.count_if((p > 0) & (q == 0)).alias("missing"),
        F.sum(F.when(q > 0, _kl_term(p, q))).alias("kl"),
        F.sum((_kl_term(p, m) + _kl_term(q, m)) / 2).alias("js"),
    )
    js = F.greatest(F.col("js"), F.lit(0.0))
    return result.select(
        F.when(F.col("missing") == 0, F.col("kl")).alias("kl_divergence"),
        js.alias("js_divergence"),
        F.sqrt(js).alias("js_distance"),
    )


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R squared of a simple regression of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
    )


DIGIT = 16  # bits that one pass settles


@F.pandas_udf(LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles; both zeros are one, NaN is greatest."""
    x = values.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def _from_ordered_bits(keys: pd.Series) -> pd.Series:
    bits = keys.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def order_statistics(df: DataFrame, value: str, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (by, rank) with ``value``: the rank-th smallest value of its group, from 0.

    Radix selection: values become whole numbers in the same order, and each of four passes
    counts the next sixteen bits of the values that share a rank's bits so far.  A pass shuffles
    at most 65,536 counts for each different prefix, whatever the number of rows; nothing is
    sorted, and no rank needs more passes than another.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, _ordered_bits(F.col(value).cast("double")).alias("key"))
    rows = settle(rows)
    state = settle(wanted.select(*by, "rank", F.col("rank").alias("left"), F.lit(0).cast("bigint").alias("prefix")))
    for done in range(0, 64, DIGIT):
        shift = 64 - done - DIGIT
        ahead = F.shiftright("key", 64 - done) if done else F.lit(0).cast("bigint")
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        if not done:  # the sign's bit: negative numbers come first
            digit = F.shiftright("key", shift) + (1 << (DIGIT - 1))
        cut = rows.select(*by, ahead.alias("prefix"), digit.cast("int").alias("digit"))
        # as many prefixes as ranks at most, so Spark sends them to the rows where it measures that
        active = state.select(*by, "prefix").distinct()
        counts = cut.join(active, [*by, "prefix"], "left_semi").groupBy(*by, "prefix", "digit").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        hit = state.join(counts, [*by, "prefix"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
        low = F.col("digit").cast("bigint") - (0 if done else 1 << (DIGIT - 1))
        state = settle(hit.select(
            *by, "rank", (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"),
            (F.shiftleft("prefix", DIGIT) + low).alias("prefix"),
        ))
    return state.select(*by, "rank", _from_ordered_bits(F.col("prefix")).alias("value"))


def quantiles(
    df: DataFrame, value: str, by: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact interpolated quantiles per group, in long form ``(by, probability, quantile)``.

    Every quantile lies between two order statistics, which radix selection finds.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.col(value)).alias("n")).filter(F.col("n") > 0)
    asked = settle(sizes.select(
        *by, "n", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    ).withColumn("h", (F.col("n") - 1) * F.col("probability")))
    ends = asked.select(*by, F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("rank")).distinct()
    found = settle(order_statistics(df, value, by, ends))
    low = found.select(*by, F.col("rank").alias("low_rank"), F.col("value").alias("lo"))
    high = found.select(*by, F.col("rank").alias("high_rank"), F.col("value").alias("hi"))
    met = asked.withColumns({"low_rank": F.floor("h"), "high_rank": F.ceil("h")}).join(low, [*by, "low_rank"]).join(high, [*by, "high_rank"])
    return met.select(*by, "probability", (F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))).alias("quantile"))


FIVE_NUMBERS = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}


def box_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Five-number summary per group."""
    long = quantiles(df, value, [group], list(FIVE_NUMBERS.values()))
    return long.groupBy(group).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
            for name, p in FIVE_NUMBERS.items()
        ]
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal-width bins between minimum and maximum.

    The last bin includes the maximum.  Only non-empty bins are returned.
    """
    low, high = (
        F.lit(x).cast("double") for x in df.agg(F.min(value), F.max(value)).first()
    )
    width = (high - low) / bins
    position = F.floor(F.coalesce(F.try_divide(F.col(value) - low, width), F.lit(0.0)))
    binned = df.filter(F.col(value).isNotNull()).select(
        *by, F.least(position, F.lit(bins - 1)).cast("int").alias("bin")
    )
    return (
        binned.groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"bin_start": low + F.col("bin") * width, "bin_end": low + (F.col("bin") + 1) * width})
    )


NODES_PER_WIDTH = 1024  # grid nodes in a bandwidth
REACH = 8.5  # bandwidths beyond which the kernel is under 2e-16


def density(
    df: DataFrame, value: str, group: str, grid: Sequence[float], nodes_per_width: int = NODES_PER_WIDTH
) -> DataFrame:
    """Gaussian kernel density per group on a fixed grid, with Scott's bandwidth.

    Linear binning: a row's weight goes to the two nodes of a fine grid around its value, in
    proportion to nearness, and partial aggregates add them up, so what is shuffled follows
    groups times nodes and not rows.  Each node then reaches the grid points within ``REACH``
    bandwidths.  Against the exact sum the error is at most
    ``1 / (8 nodes_per_width ** 2)`` of the kernel's peak, 1.2e-7 of it here, since that is what a
    chord of the kernel between nodes can miss.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    # the spread comes from the rows: its running form keeps its digits for large means
    moments = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("low"))
    widths = settle(moments.select(group, "n", "low", F.nullif(F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(0.0)).alias("h")))
    step = F.col("h") / nodes_per_width
    at = (F.col("v") - F.col("low")) / step
    node = F.floor(at)
    beside = F.explode(F.array(
        F.struct(node.alias("node"), (1 - (at - node)).alias("weight")), F.struct((node + 1).alias("node"), (at - node).alias("weight")),
    ))
    nodes = rows.join(widths, group).select(group, beside.alias("b")).groupBy(group, "b.node").agg(F.sum("b.weight").alias("weight"))
    placed = nodes.join(widths, group).withColumn("__x", F.col("low") + F.col("node") * step)
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(grid)])
    near = placed.select(group, "weight", "__x", "h", F.explode(
        F.filter(points, lambda p: F.abs(p["x"] - F.col("__x")) <= REACH * F.col("h"))
    ).alias("p"))
    z = (F.col("p.x") - F.col("__x")) / F.col("h")
    sums = near.groupBy(group, F.col("p.i").alias("grid_index")).agg(F.sum(F.col("weight") * F.exp(-z * z / 2)).alias("sum"))
    every = widths.select(group, "n", "h", F.explode(points).alias("p")).select(group, "n", "h", F.col("p.i").alias("grid_index"), F.col("p.x").alias("x"))
    peak = F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi())
    return every.join(sums, [group, "grid_index"], "left").select(
        group, "grid_index", "x", (F.coalesce("sum", F.lit(0.0)) / peak).alias("density")
    )
