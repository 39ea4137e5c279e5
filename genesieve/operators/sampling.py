"""Folds, permutations and bootstraps that can be re-derived from keys and a seed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbered_md5 import numbered_md5
from ..session import reachable, shuffle_width
from .labels import class_size_map, sample_sizes
from .ordered import hashed_row_number

try:  # twice as fast on short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

BLOCKS_AT_ONCE = 64
DRAWS_PER_TASK = 1_000_000


def stratified_folds(
    df: DataFrame, key: str, label: str = "label", folds: int = 10, repeats: int = 5, seed: int = 0
) -> DataFrame:
    """Long fold table ``(key, label, iteration, fold)``.

    Within each repeat and class, entities in hash order are cut into ``folds``
    equal tiles.  Ranks come from a split count, so the largest class is not one
    task's work.
    """
    rows = df.select(key, label).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("iteration")
    )
    ranked = hashed_row_number(
        rows, [key], ["iteration", label], [F.lit(seed), F.col("iteration")], "__rank"
    )
    rank, n = F.col("__rank") - 1, F.col("__n")
    small, larger = F.floor(n / folds), F.col("__n") % folds
    edge = larger * (small + 1)
    fold = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(
        larger + F.floor(F.try_divide(rank - edge, small))
    )
    sized = ranked.withColumn("__n", F.element_at(class_size_map(df, label), F.col(label)))
    return sized.select(key, label, "iteration", (fold + 1).cast("int").alias("fold"))


def route_to_fold(df: DataFrame, key: str, folds: DataFrame, repeats: int) -> DataFrame:
    """For each entity and repeat, the fold whose model has not seen it.

    Known entities go to the fold that held them out, new ones to fold 1.
    """
    wanted = df.select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("iteration")
    )
    known = folds.select(key, "iteration", F.col("fold").alias("__fold"))
    return (
        wanted.join(known, [key, "iteration"], "left")
        .withColumn("fold", F.coalesce("__fold", F.lit(1)))
        .drop("__fold")
    )


def permute_columns(
    df: DataFrame, key: str, columns: Sequence[str], seed: int = 0
) -> DataFrame:
    """Give every row the listed values of another row, jointly and as a bijection.

    Row i in one hash order receives the values of row i in a second hash order.
    """
    targets = hashed_row_number(df.drop(*columns), [key], output="__i")
    donors = hashed_row_number(
        df.select(key, *columns), [key], seed=[F.lit(seed)], output="__i"
    ).drop(key)
    return targets.join(donors, "__i").select(*df.columns)


def _uniforms(texts: list[bytes]) -> np.ndarray:
    """``functions.hashing.uniform`` in a task."""
    return np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u4")[::4] / 4294967296.0


def drawn_ranks(seed: str | None, tree: int, label: object, first: int, last: int, n: int) -> np.ndarray:
    """The members, from 0, of a class of ``n`` that the draws from ``first`` to before ``last`` hit."""
    head = "".join(f"{x}|" for x in (seed, tree, label) if x is not None).encode()
    return np.floor(numbered_md5(head, first, last) / 4294967296.0 * n).astype(np.int64)


def key_uniforms(seed: int, tree: int, keys: list[str]) -> np.ndarray:
    """``uniform(hash_key(seed, tree, key))`` of every key."""
    head = f"{seed}|{tree}|".encode()
    return _uniforms([head + k.encode() for k in keys])


def stratified_bootstrap(
    df: DataFrame,
    key: str,
    label: str = "label",
    trees: int = 200,
    driver_rate: float = 0.7,
    other_ratio: float = 1.0,
    seed: int | Column = 0,
    block: int = 1024,
    by: Sequence[str] = (),
) -> DataFrame:
    """How often each entity is drawn for each tree: ``(by, tree, key, label, draws)``.

    Draws are with replacement inside each class, apart for every group of ``by``.  Trees are
    dealt out first and blocks of draws after that, so neither the draws of a class nor all
    blocks are made in one task; draws are counted before they meet the entities.
    """
    by = list(by)
    seed = F.lit(seed) if isinstance(seed, int) else seed
    sizes = sample_sizes(df, label, driver_rate, other_ratio, by=tuple(by))
    grown = sizes.filter(F.col("sample_size") > 0).select(
        *by, label, "n", "sample_size", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"),
    ).repartition(*by, label, "tree")
    blocks = grown.select("*", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("sample_size") - 1) / block))
    ).alias("__block"))
    last = F.least(F.col("sample_size"), (F.col("__block") + 1) * block)
    # the plan knows nothing of how many draws rows stand for, so tasks are asked for
    tasks = (sizes.agg(F.sum("sample_size")).first()[0] or 0) * trees // DRAWS_PER_TASK
    dealt = [tasks] if tasks > shuffle_width(df.sparkSession) else []
    draws = blocks.repartition(*dealt, *by, label, "tree", "__block").select(
        *by, label, "tree", "n", (F.col("__block") * block).alias("__first"), last.alias("__last"),
        seed.cast("string").alias("__seed"), F.col(label).cast("string").alias("__label"),
    )
    reachable(df.sparkSession)
    held = [*by, label, "tree"]

    def toss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                rows = batch.slice(at, BLOCKS_AT_ONCE)
                columns = [rows[c].to_pylist() for c in ("__seed", "tree", "__label", "__first", "__last", "n")]
                hit = [np.unique(drawn_ranks(*row), return_counts=True) for row in zip(*columns, strict=True)]
                of = pa.array(np.repeat(np.arange(len(hit)), [len(ranks) for ranks, _ in hit]))
                yield pa.RecordBatch.from_arrays(
                    [*[rows[c].take(of) for c in held], pa.array(np.concatenate([ranks for ranks, _ in hit]) + 1),
                     pa.array(np.concatenate([counts for _, counts in hit]).astype(np.int64))],
                    names=[*held, "__rank", "draws"],
                )

    schema = draws.select(*held).schema.add("__rank", "long").add("draws", "long")
    # dealt as the join asks for it, so the draws are shuffled once
    counted = (
        draws.mapInArrow(toss, schema).repartition(*by, label, "__rank")
        .groupBy(*by, "tree", label, "__rank").agg(F.sum("draws").alias("draws"))
    )
    members = hashed_row_number(df.select(*by, key, label), [key], [*by, label], output="__rank")
    # and without the hint it takes the draws for a small table, to be broadcast
    return counted.join(members.hint("shuffle_hash"), [*by, label, "__rank"]).select(*by, "tree", key, label, "draws")
