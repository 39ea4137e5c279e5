"""The three commands: build features, train, classify.

Inputs are tab-separated files with the headings in ``sources.schemas``; outputs
are folders of such files.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, features, forest, graph, labels, merging, rules, sampling, significance
from ..operators.cleaning import impute_mean
from ..session import scratch_path, settle
from ..sources import schemas
from ..sources.files import read_tsv, read_value_list, write_tsv

NETWORK_COLUMNS = ["gene_degree", "gene_betweeness"]
SCORES = {"oncogene_score": "oncogene", "tsg_score": "tsg", "driver_score": "driver"}


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return schemas.snake_case(read_tsv(spark, path, schema))


def _with_headings(df: DataFrame) -> DataFrame:
    headings = {schemas.snake(f.name): f.name for f in schemas.FEATURES.fields}
    return df.withColumnsRenamed({c: headings[c] for c in df.columns if c in headings})


def build_network(spark: SparkSession, edges: str, output: str) -> DataFrame:
    """Degree and betweenness of every entity of an interaction file, written as a network file."""
    first, second = (f.name for f in schemas.EDGES.fields)
    pairs = settle(graph.simple_edges(read_tsv(spark, edges, schemas.EDGES), first, second))
    found = graph.node_betweenness(pairs).join(graph.node_degree(pairs), "node")
    write_tsv(found.select(
        F.col("node").alias("gene"), F.col("betweenness").alias("gene_betweeness"), F.col("degree").cast("double").alias("gene_degree")
    ), output)
    return read_tsv(spark, output, schemas.NETWORK)


def build_features(
    spark: SparkSession, summary: str, inactivating_test: str, clustering_test: str,
    covariates: str, network: str | None = None, output: str | None = None,
    permute_network: bool = False, seed: int = 0,
) -> DataFrame:
    """The feature matrix from a count summary and the tables that go with it."""
    counts = _read(spark, summary, schemas.SUMMARY).withColumnRenamed("silent_snv", "silent")
    network_table = None
    if network is not None:
        network_table = _read(spark, network, schemas.NETWORK)
        if permute_network:
            network_table = sampling.permute_columns(network_table, "gene", NETWORK_COLUMNS, seed)
    matrix = features.feature_matrix(
        features.ratio_features(counts), "gene",
        [_read(spark, inactivating_test, schemas.INACTIVATING_TEST),
         _read(spark, clustering_test, schemas.CLUSTERING_TEST)],
        _read(spark, covariates, schemas.COVARIATES), network_table,
    )
    matrix = matrix.select("gene", *[c for c in schemas.FEATURE_NAMES if c in matrix.columns])
    if output:
        write_tsv(_with_headings(matrix), output)
    return matrix


def _labelled(spark, path: str | Sequence[str], oncogenes: str, tsgs: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Raw features, imputed and labelled features, and the feature names.

    Several paths are runs of a simulation: their entities get new names, numbers in one row.
    """
    if isinstance(path, str):
        raw = _read(spark, path, schemas.FEATURES)
    else:
        runs = [_read(spark, p, schemas.FEATURES) for p in path]
        raw = merging.union_runs(runs, "gene", "gene").withColumn("gene", F.col("gene").cast("string"))
    raw = settle(raw)
    names = [c for c in raw.columns if c != "gene"]
    onco, tsg = read_value_list(spark, oncogenes), read_value_list(spark, tsgs)
    labelled = settle(labels.label_entities(impute_mean(raw, names), "gene", onco, tsg))
    return raw, labelled, names


def train(
    spark: SparkSession, features_path: str, oncogenes: str, tsgs: str, output: str,
    cv: bool = False, settings: forest.ForestSettings = forest.ForestSettings(),
    folds: int = 10, repeats: int = 5,
) -> str:
    """Fit one forest on everything, or with ``cv`` a bank of held-out forests."""
    _, matrix, names = _labelled(spark, features_path, oncogenes, tsgs)
    if cv:
        forest.train_bank(matrix, "gene", names, output, settings, folds=folds, repeats=repeats)
    else:
        forest.train_forest(matrix, "gene", names, output, settings)
    return output


def read_null(spark: SparkSession, path: str) -> DataFrame:
    """A null table in long form."""
    wide = _read(spark, path, schemas.NULL_TABLE)
    names = {f"{short}_p_value": score for score, short in SCORES.items()}
    return (
        wide.withColumnsRenamed(names)
        .unpivot(["score"], list(SCORES), "score_type", "p")
        .filter(F.col("p").isNotNull())
    )


def write_null(null: DataFrame, path: str) -> None:
    wide = significance.null_table(null, list(SCORES))
    headings = {score: f"{short} p-value" for score, short in SCORES.items()}
    write_tsv(wide.withColumnsRenamed(headings), path)


MLFC_ALARM = 0.3  # p-values further off than this are not to be trusted


def _write_diagnostics(spark: SparkSession, result: DataFrame, lists: Sequence[str], output: str) -> None:
    """Quantile points and fold changes of each score's p-values."""
    known = read_value_list(spark, lists[0]).unionByName(read_value_list(spark, lists[1]))
    points, changes = [], []
    for score, short in SCORES.items():
        kind = F.lit(short).alias("score_type")
        points.append(significance.qq_points(result.select("gene", f"{score}_p"), f"{score}_p", ["gene"]).select(kind, "*"))
        changes.append(significance.mean_log_fold_change(result.select("gene", f"{score}_p"), f"{score}_p", ["gene"], known).select(kind, "mlfc"))
    write_tsv(reduce(DataFrame.unionByName, points), os.path.join(output, "qq"))
    change = reduce(DataFrame.unionByName, changes)
    write_tsv(change.withColumn("alarm", F.coalesce(F.col("mlfc") > MLFC_ALARM, F.lit(False))), os.path.join(output, "mlfc"))


def classify(
    spark: SparkSession, features_path: str | Sequence[str], oncogenes: str, tsgs: str, output: str,
    trained: str | None = None, cv: bool = False, simulated: bool = False,
    null: str | None = None, settings: forest.ForestSettings = forest.ForestSettings(),
    folds: int = 10, repeats: int = 5,
) -> DataFrame:
    """Score entities.

    ``simulated``: the scores become a null table, written to ``output``; ``features_path`` may
    name the feature files of several runs.
    Otherwise results go to ``output/results``.  With a ``null`` table they have p- and q-values,
    ``output/qq`` the points of each score's quantile plot, and ``output/mlfc`` its mean absolute
    log2 fold change over entities on neither training list, with an alarm above ``MLFC_ALARM``.
    Without a ``trained`` forest the entities are scored out of fold, and call lists, the areas of
    the forest and of the majority baseline, the metrics of every repeat, and importance are
    written too.
    """
    raw, matrix, names = _labelled(spark, features_path, oncogenes, tsgs)
    bank = None
    if trained and not cv:
        scored = forest.score_forest(matrix, names, trained).select(
            "gene", "oncogene_score", "tsg_score"
        )
        per_repeat = None
    else:
        bank = trained
        if bank is None:
            bank = scratch_path(spark, "bank")
            forest.train_bank(matrix, "gene", names, bank, settings, folds=folds, repeats=repeats)
        per_repeat = settle(
            forest.score_bank(matrix, "gene", names, bank, repeats, average=False)
        )
        scored = per_repeat.groupBy("gene").agg(
            F.avg("oncogene_score").alias("oncogene_score"), F.avg("tsg_score").alias("tsg_score")
        )
    calls = settle(significance.score_calls(scored, "oncogene_score", "tsg_score"))
    if simulated:
        null_long = significance.null_distribution(significance.unpivot_scores(calls, list(SCORES)))
        write_null(null_long, output)
        return null_long
    result = (
        raw.fillna(0, subset=names).join(calls, "gene").join(matrix.select("gene", "label"), "gene")
    )
    if null:
        result = significance.significance(result, read_null(spark, null), list(SCORES))
    result = settle(result)
    write_tsv(_with_headings(result).orderBy(F.desc("driver_score"), "gene"), os.path.join(output, "results"))
    if null:
        _write_diagnostics(spark, result, (oncogenes, tsgs), output)
    if trained is None:
        q_columns = ("oncogene_score_q", "tsg_score_q") if null else None
        lists = significance.call_lists(result, "gene", q_columns=q_columns)
        lists.write.mode("overwrite").partitionBy("list_name").csv(os.path.join(output, "lists"))
        rows = per_repeat.withColumn(
            "driver_score", F.col("oncogene_score") + F.col("tsg_score")
        ).join(matrix.select("gene", "label"), "gene")
        rows = settle(rows)
        write_tsv(evaluation.performance(rows, "gene", "label"), os.path.join(output, "performance"))
        fold_table = settle(spark.read.parquet(os.path.join(bank, "folds")))
        guessed = rules.majority_baseline(fold_table, "gene")
        guessed = guessed.withColumn("driver_score", F.col("oncogene_score") + F.col("tsg_score"))
        write_tsv(evaluation.performance(settle(guessed), "gene", "label"), os.path.join(output, "baseline"))
        each = significance.score_calls(rows.drop("driver_score"), "oncogene_score", "tsg_score")
        write_tsv(evaluation.repeat_metrics(settle(each), "label"), os.path.join(output, "repeats"))
        # only the last fold's fit of each repeat is recorded
        rounds = forest.importance(forest.read_nodes(spark, bank), names).filter(F.col("fold") == folds)
        write_tsv(forest.importance_summary(rounds), os.path.join(output, "importance"))
    return result
