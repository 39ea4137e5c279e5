"""Classifiers that are closed expressions over counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_rule(
    df: DataFrame,
    recurrent: str,
    deleterious: str,
    total: str,
    variant: str = "published",
    as_fraction: bool = False,
    oncogene_threshold: float = 0.2,
    tsg_threshold: float = 0.2,
    oncogene_minimum: float = 10,
    tsg_minimum: float = 7,
    minimum_total: float = 0,
    scale_to: float | None = None,
    output: str = "rule_class",
) -> DataFrame:
    """Call entities by their recurrent and deleterious shares.

    ``published`` asks for minimum counts besides the shares and lets an oncogene
    have at most 5% deleterious mutations; ``minimum`` compares the two shares.
    With ``scale_to`` the minimum counts are scaled by the number of mutations
    over that reference size.
    """
    for threshold in (oncogene_threshold, tsg_threshold):
        if not 0 < threshold < 1:
            raise ValueError("thresholds are shares between 0 and 1")
    n = F.col(total)
    if as_fraction:
        recurrent_share, deleterious_share = F.col(recurrent), F.col(deleterious)
    else:
        recurrent_share = F.try_divide(F.col(recurrent).cast("double"), n)
        deleterious_share = F.try_divide(F.col(deleterious).cast("double"), n)
    recurrent_count, deleterious_count = recurrent_share * n, deleterious_share * n
    factor: Column = F.lit(1.0)
    if scale_to:
        factor = df.agg(F.sum(total) / F.lit(float(scale_to))).scalar()
    needed_oncogene = F.lit(float(oncogene_minimum)) * factor
    needed_tsg = F.lit(float(tsg_minimum)) * factor
    too_few = (n < minimum_total) if not as_fraction or variant == "minimum" else F.lit(False)

    recurrent_high = recurrent_share >= oncogene_threshold
    deleterious_high = deleterious_share >= tsg_threshold
    if variant == "published":
        enough_deleterious = deleterious_count >= needed_tsg
        call = (
            F.when(
                recurrent_high & (recurrent_count >= needed_oncogene),
                F.when(deleterious_share <= 0.05, "oncogene")
                .when(enough_deleterious, "tsg")
                .otherwise("other"),
            )
            .when(deleterious_high & enough_deleterious, "tsg")
            .otherwise("other")
        )
    elif variant == "minimum":
        call = (
            F.when(
                recurrent_high,
                F.when(recurrent_share >= deleterious_share, "oncogene").otherwise("tsg"),
            )
            .when(deleterious_high, "tsg")
            .otherwise("other")
        )
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.withColumn(output, F.when(too_few, "other").otherwise(call))


def majority_baseline(folds: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Most frequent training class of every fold, as one-hot scores for its members.

    Training counts are the totals minus the held-out counts, so no fold has to be
    joined with the rest.
    """
    held_out = folds.groupBy("iteration", "fold", label).agg(F.count(F.lit(1)).alias("held"))
    all_folds = folds.select("iteration", "fold").distinct()
    totals = held_out.groupBy("iteration", label).agg(F.sum("held").alias("n"))
    training = (
        all_folds.join(totals, "iteration")
        .join(held_out, ["iteration", "fold", label], "left")
        .withColumn("n", F.col("n") - F.coalesce("held", F.lit(0)))
    )
    best = training.groupBy("iteration", "fold").agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("predicted")
    )
    scored = folds.join(best, ["iteration", "fold"])
    return scored.select(
        key, label, "iteration", "fold", "predicted",
        (F.col("predicted") == 1).cast("double").alias("oncogene_score"),
        (F.col("predicted") == 2).cast("double").alias("tsg_score"),
    )


def naive_bayes(
    train: DataFrame, test: DataFrame, counts: Sequence[str], label: str = "label",
    smoothing: float = 1.0,
) -> DataFrame:
    """Multinomial naive Bayes with the training shares as prior.

    The model is one row of sums per class, held as a scalar of classes x features
    numbers; scoring is an expression per row.
    """
    sums = train.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in counts]).alias("sums")
    )
    sums = sums.withColumn(
        "all", F.aggregate("sums", F.lit(0).cast("bigint"), lambda a, x: a + x)
    ).withColumn("rows", F.sum("n").over(Window.partitionBy()))
    log_shares = F.transform(
        "sums",
        lambda x: F.log((x + F.lit(smoothing)) / (F.col("all") + F.lit(smoothing * len(counts)))),
    )
    model = sums.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(label).alias("class"),
                    F.log(F.col("n") / F.col("rows")).alias("prior"),
                    log_shares.alias("weights"),
                )
            )
        )
    ).scalar()
    values = F.array(*[F.col(c).cast("double") for c in counts])
    joint = F.transform(
        F.col("__model"),
        lambda m: m["prior"]
        + F.aggregate(
            F.zip_with(m["weights"], F.col("__values"), lambda w, v: w * v),
            F.lit(0.0),
            lambda a, x: a + x,
        ),
    )
    scored = (
        test.withColumn("__values", values).withColumn("__model", model).withColumn("__joint", joint)
    )
    top = F.array_max("__joint")
    shifted = F.transform("__joint", lambda j: F.exp(j - F.array_max(F.col("__joint"))))
    norm = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    classes = F.transform("__model", lambda m: m["class"])
    return scored.select(
        *test.columns,
        F.element_at(classes, F.array_position("__joint", top).cast("int")).alias("predicted"),
        F.transform(shifted, lambda x: x / norm).alias("probabilities"),
    )
