"""Combining tables of several publishers: bans, priorities, aliases, alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ordered import hashed_row_number


def drop_hypermutators(df: DataFrame, sample: str, limit: int) -> DataFrame:
    """Keep samples with fewer than ``limit`` rows; rows without sample go.

    The samples to drop are at most ``rows / limit`` many, so the anti join is
    against the short list rather than a semi join against the long one.
    """
    heavy = (
        df.groupBy(sample).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") >= limit)
    )
    return df.filter(F.col(sample).isNotNull()).join(heavy.select(sample), sample, "left_anti")


def drop_banned(df: DataFrame, sample: str, banned: DataFrame, banned_column: str) -> DataFrame:
    """Drop rows of banned samples; rows without sample stay."""
    names = banned.select(F.col(banned_column).alias(sample)).distinct()
    return df.join(names, sample, "left_anti")


def spread_nulls(key: str, by: Sequence[str], parts: int = 4096) -> Column:
    """``key`` as text, with nulls dealt over many values that no key has.

    In a left join such rows find nothing, as nulls do, but they do not meet in one task.
    """
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*by), F.lit(parts)).cast("string"))
    return F.coalesce(F.col(key).cast("string"), salt)


def prioritise_sources(sources: Sequence[DataFrame], sample: str) -> DataFrame:
    """Union of sources in which a sample is taken from the first that has it.

    Rows without sample are kept from every source.
    """
    tagged = [df.withColumn("__source", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    first = (
        rows.filter(F.col(sample).isNotNull())
        .groupBy(sample)
        .agg(F.min("__source").alias("__first"))
    )
    first = first.select(F.col(sample).cast("string").alias("__key"), "__first")
    return (
        rows.withColumn("__key", spread_nulls(sample, sources[0].columns))
        .join(first, "__key", "left")
        .filter(F.col(sample).isNull() | (F.col("__source") == F.col("__first")))
        .select(*sources[0].columns)
    )


def append_unseen(base: DataFrame, extra: DataFrame, sample: str) -> DataFrame:
    """Append rows of ``extra`` whose sample is NOT IN the samples of ``base``.

    SQL's three-valued logic is kept: one null sample in a base keeps everything
    out, and null samples are appended only to an empty base.  The null rules are
    settled by two counts of the base and the rest is a plain hash anti join,
    because a null-aware anti join can only run as a broadcast.
    """
    rows, nulls = base.agg(
        F.count(F.lit(1)), F.count_if(F.col(sample).isNull())
    ).first()
    unseen = extra
    if rows and nulls:
        unseen = extra.filter(F.lit(False))
    elif rows:
        seen = base.select(sample).distinct()
        known = extra.filter(F.col(sample).isNotNull())
        unseen = known.join(seen, sample, "left_anti").select(*extra.columns)
    return base.unionByName(unseen, allowMissingColumns=True)


def attach_by_row_id(df: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """Align two tables on the row id both carry; order is never relied on."""
    return df.join(other, row_id)


def keep_passing(df: DataFrame, checks: DataFrame, row_id: str, warning: str) -> DataFrame:
    """Keep rows whose entry in the quality table has no warning."""
    passing = checks.filter(F.col(warning).isNull()).select(row_id)
    return df.join(passing, row_id, "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, with map-side combine instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def alias_table(
    symbols: DataFrame,
    approved: str,
    previous: str,
    synonyms: str,
    row_id: str,
    overrides: Mapping[str, str] = fv.ALIAS_OVERRIDES,
) -> DataFrame:
    """One row ``(alias, symbol)`` per name that has to be replaced.

    A previous symbol goes before a synonym, the last definition of either wins,
    and approved symbols are never replaced.  One table means one join instead of
    three.
    """

    def exploded(column: str, level: int) -> DataFrame:
        return symbols.filter(F.col(column).isNotNull()).select(
            F.explode(F.split(F.col(column), ", ")).alias("alias"),
            F.col(approved).alias("symbol"),
            F.col(row_id).cast("bigint").alias("__row"),
            F.lit(level).alias("__level"),
        )

    names = exploded(previous, 1).unionByName(exploded(synonyms, 2))
    approved_names = symbols.select(F.col(approved).alias("alias")).distinct()
    best = names.groupBy("alias").agg(
        F.min_by("symbol", F.struct("__level", -F.col("__row"))).alias("symbol")
    )
    if overrides:
        fixed = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        listed = best.filter(~F.col("alias").isin(*overrides))
        added = symbols.sparkSession.range(1).select(F.explode(fixed).alias("alias", "symbol"))
        best = listed.unionByName(added)
    return best.join(approved_names, "alias", "left_anti").select("alias", "symbol")


def resolve_aliases(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Replace known aliases in ``name`` by their symbol."""
    found = aliases.withColumnsRenamed({"alias": name, "symbol": "__symbol"})
    columns = df.columns
    return (
        df.join(found, name, "left")
        .withColumn(name, F.coalesce("__symbol", name))
        .select(*columns)
    )


def resolve_aliases_once(
    df: DataFrame, name: str, aliases: DataFrame, row_id: str
) -> DataFrame:
    """Replace aliases, keeping for each symbol only rows of the alias seen first."""
    columns = df.columns
    found = aliases.withColumnsRenamed({"alias": name, "symbol": "__symbol"})
    rows = df.join(found, name, "left")
    changed = F.col("__symbol").isNotNull() & (F.col("__symbol") != F.col(name))
    first = (
        rows.filter(changed)
        .groupBy("__symbol")
        .agg(F.min_by(name, F.col(row_id)).alias("__first"))
    )
    return (
        rows.withColumn("__key", spread_nulls("__symbol", [row_id]))
        .join(first.withColumnRenamed("__symbol", "__key"), "__key", "left")
        .filter(~F.coalesce(changed, F.lit(False)) | (F.col(name) == F.col("__first")))
        .withColumn(name, F.coalesce("__symbol", name))
        .select(*columns)
    )


def align_outer(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer alignment of several ``(key, value)`` tables, one column each.

    Stacking and pivoting needs one shuffle, however many tables there are.
    """
    stacked = [
        df.select(F.col(key), F.col(value).alias("__value"), F.lit(name).alias("__name"))
        for name, df in tables.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), stacked)
    return rows.groupBy(key).pivot("__name", list(tables)).agg(F.first("__value"))


def compare_sets(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its part: ``both``, ``first only`` or ``second only``."""
    rows = first.select(F.col(column).alias("value"), F.lit(1).alias("__side")).unionByName(
        second.select(F.col(column).alias("value"), F.lit(2).alias("__side"))
    )
    sides = rows.groupBy("value").agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"))
    return sides.select(
        "value",
        F.when(F.col("lo") != F.col("hi"), "both")
        .when(F.col("lo") == 1, "first only")
        .otherwise("second only")
        .alias("part"),
    )


def union_runs(runs: Sequence[DataFrame], key: str, output: str = "row_id") -> DataFrame:
    """Union of simulation runs in which a running number replaces the key.

    Equal keys of different runs are different simulated entities, so they need
    new names.  Numbers start at 2, which keeps them equal to line numbers of a
    file with a header.
    """
    tagged = [df.withColumn("__run", F.lit(i)) for i, df in enumerate(runs)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    numbered = hashed_row_number(rows, [key, "__run"], output="__number")
    return numbered.select(
        (F.col("__number") + 1).alias(output), *[c for c in runs[0].columns if c != key]
    )
