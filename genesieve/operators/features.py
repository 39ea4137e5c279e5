"""From mutations to the feature matrix of entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import settle
from .cleaning import column_means, impute_mean

COUNT_COLUMNS = (
    "silent", "nonsense", "lost_stop", "lost_start", "missense", "recurrent_missense",
    "splice_site", "inframe_indel", "frameshift_indel",
)
FRACTION_COLUMNS = tuple(c for c in COUNT_COLUMNS if c not in ("lost_stop", "lost_start"))

# Count column of each consequence class.
CLASS_COUNTS = {
    fv.SILENT: "silent",
    fv.NONSENSE: "nonsense",
    fv.NONSTOP: "lost_stop",
    fv.TRANSLATION_START: "lost_start",
    fv.MISSENSE: "missense",
    fv.SPLICE: "splice_site",
    fv.IN_FRAME: "inframe_indel",
    fv.FRAME_SHIFT: "frameshift_indel",
}


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _total(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [_zero(c) for c in columns])


def class_counts(df: DataFrame, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of mutations of each class, per group if ``by`` is given."""
    return df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))


def class_counts_wide(
    df: DataFrame, entity: str, category: str, classes: Mapping[str, str] = CLASS_COUNTS
) -> DataFrame:
    """Class counts per entity, one column per class, in a single aggregation."""
    return df.groupBy(entity).agg(
        *[F.count_if(F.col(category) == c).alias(name) for c, name in classes.items()]
    )


def summarise_entities(
    df: DataFrame, entity: str, category: str, position: str, recurrent_at: int = 2,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Counts, recurrent missense and position entropies per entity, and sums of columns.

    The first aggregation is per (entity, class, position), so a hot entity is
    spread over its positions before the second one folds a much smaller table.
    Entropy needs only the running sums: H = log2 N - sum(c log2 c) / N.
    """
    sums = sums or {}
    sites = df.groupBy(entity, category, position).agg(
        F.count(F.lit(1)).alias("__c"), *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    missense = (F.col(category) == fv.MISSENSE) & F.col(position).isNotNull()
    recurrent = F.when(missense & (F.col("__c") >= recurrent_at), F.col("__c")).otherwise(0)
    placed = F.when(F.col(position).isNotNull(), F.col("__c")).otherwise(0)
    placed_missense = F.when(missense, F.col("__c")).otherwise(0)

    def weighted(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))

    rows = sites.withColumns(
        {
            "__r": recurrent, "__m": placed_missense, "__a": placed,
            "__mw": weighted(placed_missense), "__aw": weighted(placed),
        }
    )
    folded = rows.groupBy(entity).agg(
        *[
            F.sum(F.when(F.col(category) == c, F.col("__c")).otherwise(0)).alias(name)
            for c, name in CLASS_COUNTS.items()
        ],
        F.sum("__r").alias("recurrent_missense"),
        *[F.sum(c).alias(c) for c in ("__m", "__mw", "__a", "__aw", *sums)],
    )
    snv = ["nonsense", "lost_stop", "lost_start", "missense", "splice_site"]
    return folded.withColumns(
        {
            "non_silent_snv": _total(snv),
            "normalized_missense_position_entropy": normalised_entropy("__m", "__mw"),
            "normalized_mutation_entropy": normalised_entropy("__a", "__aw"),
        }
    ).drop("__m", "__mw", "__a", "__aw")


def normalised_entropy(count: str, weighted: str) -> Column:
    """Entropy over its maximum log2(n); 0 where that maximum is 0."""
    n = F.col(count)
    ceiling = F.when(n > 1, F.log2(n))
    entropy = ceiling - F.try_divide(F.col(weighted), n)
    return F.coalesce(F.try_divide(entropy, ceiling), F.lit(0.0))


def ratio_features(df: DataFrame) -> DataFrame:
    """The ratio features of a count summary, in one projection.

    The total counts recurrent missense once, as part of missense; the missense
    fraction still includes it.  Rows without mutations get fractions of 0.
    Score columns are used when present: the mean conservation falls back to the
    column maximum, the mean deleteriousness to null.
    """
    # missense without recurrent, plus recurrent, is missense again
    total = _total([c for c in COUNT_COLUMNS if c != "recurrent_missense"])
    beyond_silent = F.col("silent") + 1
    columns: dict[str, Column] = {}
    if "total_missense_mgaentropy" in df.columns:
        df = settle(df)  # read twice: by the rows and by the column maximum
        mean = F.try_divide(F.col("total_missense_mgaentropy").cast("double"), F.col("missense"))
        largest = df.agg(F.max(mean)).scalar()
        columns["mean_missense_mgaentropy"] = F.coalesce(mean, largest)
    if "total_missense_vest_score" in df.columns:
        score = _total(
            ["total_missense_vest_score", "lost_stop", "lost_start", "splice_site",
             "frameshift_indel", "inframe_indel", "nonsense"]
        )
        mutations = _total(["non_silent_snv", "silent", "inframe_indel", "frameshift_indel"])
        columns["mean_vest_score"] = F.try_divide(score.cast("double"), mutations)

    def fraction(column: str) -> Column:
        return F.coalesce(F.try_divide(F.col(column).cast("double"), total), F.lit(0.0))

    columns |= {
        "lost_start_and_stop": fraction("lost_stop") + fraction("lost_start"),
        "missense_to_silent": F.col("missense").cast("double") / beyond_silent,
        "non_silent_to_silent": (
            (F.col("non_silent_snv") + F.col("inframe_indel") + F.col("frameshift_indel"))
            .cast("double") / beyond_silent
        ),
    }
    columns |= {c: fraction(c) for c in FRACTION_COLUMNS}
    used = {
        "id", "non_silent_snv", "lost_stop", "lost_start",
        "total_missense_mgaentropy", "total_missense_vest_score",
    }
    # One projection: every expression has to see the original counts.
    kept = [F.col(c) for c in df.columns if c not in used and c not in columns]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


COHORT_COLUMNS = ("nonsense", "silent", "splice_site", "lost_stop", "missense", "lost_start")
CENTRED_COLUMNS = (
    "nonsense", "silent", "splice_site", "lost_start_and_stop", "missense", "missense_to_silent", "non_silent_to_silent",
)


def cohort_fractions(cohort: DataFrame) -> DataFrame:
    """What simulated cohorts are centred by: fractions of a total of six kinds of their own.

    A simulated cohort has no indels and no recurrence, so its total is that of the six counts
    it does have, not the total of ``ratio_features``.
    """
    total = _total(list(COHORT_COLUMNS))

    def fraction(column: str) -> Column:
        return F.coalesce(F.try_divide(F.col(column).cast("double"), total), F.lit(0.0))

    return cohort.select(
        *[fraction(c).alias(c) for c in ("nonsense", "silent", "splice_site", "missense")],
        (fraction("lost_stop") + fraction("lost_start")).alias("lost_start_and_stop"),
        (F.col("missense").cast("double") / (F.col("silent") + 1)).alias("missense_to_silent"),
    )


def centre_on_cohort(features: DataFrame, cohort: DataFrame) -> DataFrame:
    """Subtract the means of a simulated cohort's fractions from the ratio features.

    ``cohort`` is a count summary.  The ratio of non-silent to silent counts needs indels, which
    a cohort lacks, so its mean is that of the features themselves.  Two passes, one over each
    table, give seven numbers.
    """
    means = column_means(cohort_fractions(cohort), CENTRED_COLUMNS[:-1])
    means |= column_means(features, CENTRED_COLUMNS[-1:])
    return features.withColumns({c: F.col(c) - F.lit(means[c]) for c in CENTRED_COLUMNS})


def roll_up(
    df: DataFrame,
    key: str,
    counts: Sequence[str],
    deleterious: Sequence[str],
    recurrent: str,
    minimum: float = 0,
) -> DataFrame:
    """Counts normalised by (row total - recurrent), with the raw roll-ups beside them."""
    total = _total(counts)
    base = total - F.col(recurrent)
    return df.filter(total >= minimum).select(
        key,
        *[F.try_divide(F.col(c).cast("double"), base).alias(c) for c in counts],
        F.col(recurrent).alias("recurrent_count"),
        _total(deleterious).alias("deleterious_count"),
    )


def attach(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins on one key.

    No side is forced to be broadcast: Spark broadcasts below its size threshold,
    and adaptive execution splits skewed partitions of the left side otherwise.
    """
    for other in others:
        df = df.join(other, key, "left")
    return df


def feature_matrix(
    ratios: DataFrame,
    key: str,
    tests: Sequence[DataFrame] = (),
    covariates: DataFrame | None = None,
    network: DataFrame | None = None,
) -> DataFrame:
    """Join ratios with test results, covariates and network, and impute.

    Unknown network values are 0; everything else takes the column mean after all
    joins.  The joined table is materialised, as both the means and the rows read it.
    """
    others = [*tests] + [t for t in (covariates, network) if t is not None]
    df = attach(ratios, others, key)
    if network is not None:
        df = df.fillna(0, subset=[c for c in network.columns if c != key])
    df = settle(df)
    numeric = [
        c for c, t in df.dtypes
        if c != key and (t in ("int", "bigint", "double", "float") or t.startswith("decimal"))
    ]
    return impute_mean(df, numeric)
