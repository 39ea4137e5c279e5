"""Exact top-k inner products: vectors by falling length, rotated, pruned by residual bounds.

Components become integers, so scores are exact.  One aggregate gives the second moments
of all vectors; their singular directions rotate every vector so that most of its length
lies in the leading components.  Candidates are dealt into blocks by falling norm.  The
first block of long vectors gives each query k scores and so a floor; a block of
candidates meets a block of queries only if the product of the block's largest norm and
the query's norm can exceed the floor.  Inside, the product of the leading components
plus the product of the residual norms bounds the score (Cauchy-Schwarz); only vectors
whose bound reaches the floor get the full integer product.  Where the leading components
leave too many, the bound takes twice as many of them, up to all.

Queries are a stated share of the rows and meet all rows in blocks of both sides; each
pair of blocks is its own row group, so neither side is ever whole in one task.  Blocks are
met in rounds, each with the floors of the round before and with copies of about two
tables at most, so scores kept and disk grow with the rows.  The partial sums do not: of
vectors of one length and no direction in common every query meets every row.

Edge cases: null vectors and those with a null or non-finite component take no part;
empty vectors and vectors shorter than the longest count as padded with zeros; ties go to
the smaller id; rows without an id take no part; repeated ids are separate candidates, but
a product beyond 64 bits is an error, never rounded; a row is never a candidate of its own id, and a repeated query id asks once, with its
greatest vector; with fewer candidates than k, all are returned; no rows in, no rows out.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts_for

K = 5
SCALE = 256
QUERY_EVERY = 50
BLOCK = 8192  # vectors in a block of candidates
QUERIES = 8192  # vectors in a block of queries
NUMBERS = 1 << 20  # components in a block of either, unless one vector has more
BANDS = 1000  # bounds of norms, at most
LEADING = 16  # rotated components in the first partial sum
SLAB = 1024  # queries that are multiplied at once
SPARSE = 256  # a bound is sharp enough if it leaves one pair in so many
REACH = 16  # a round meets blocks up to so many times those met before


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm`` with v the array of floor(scale * x), for vectors that take part."""
    x = F.col("x")
    usable = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (c != float("inf")) & (c != float("-inf"))
    )
    v = F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("bigint"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.where(usable & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", F.sqrt(square))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Whole numbers, rows padded with zeros to ``width``."""
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(column):
        rows = column.to_numpy()
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        out[np.arange(width) < sizes[:, None]] = np.concatenate(rows)
    return out


def directions(rows: DataFrame, width: int) -> np.ndarray:
    """Singular directions of all vectors, by falling singular value.

    Tasks add up products of components; the sums are one row per pair of components, a
    number fixed by the width of the vectors.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch["v"], width).astype(float)
            total += m.T @ m
        i, j = np.indices((width, width))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = rows.select("v").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = sums.toPandas()
    gram = np.zeros((width, width))
    gram[found["i"], found["j"]] = found["s"]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, np.argsort(-values)]


NONE = np.iinfo(np.int64).min  # where there is no score yet


class Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def floor(self) -> np.ndarray:
        last = self.score[:, -1]
        return np.where(last == NONE, -np.inf, last.astype(float))

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of pairs (query, id), merged into what is held."""
        which, query = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(which)), self.k), query])
        i = np.concatenate([self.id[which].ravel(), ids])
        s = np.concatenate([self.score[which].ravel(), scores.astype(np.int64)])  # whole numbers, in whatever type
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, and never overflows
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(which)))[q]
        top = rank < self.k
        self.id[which], self.score[which] = i[top].reshape(-1, self.k), s[top].reshape(-1, self.k)


def products(a: np.ndarray, b: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers.

    64-bit arithmetic wraps round, so a product that fits is exact whatever its parts are;
    ``about``, the bound of each, tells the ones that do not, and they are an error.
    """
    if (np.abs(about) >= 2.0**62).any():
        exact = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
        if any(not -(2**63) < e < 2**63 for e in exact):
            raise OverflowError("an inner product does not fit 64 bits")
    return np.einsum("ij,ij->i", a, b)


def unit(rows: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the rotated rows at length 1 (or 0)."""
    full = rows.astype(float)
    norm = np.sqrt((full**2).sum(axis=1))
    return norm, (full / np.where(norm > 0, norm, 1)[:, None]) @ axes


def partial(rotated: np.ndarray, lead: int) -> np.ndarray:
    """Leading components and the length of the rest: products of such rows bound those of whole rows."""
    part = rotated[:, :lead]
    rest = np.sqrt(np.maximum((rotated**2).sum(axis=1) - (part**2).sum(axis=1), 0))
    return np.column_stack([part, rest]).astype(np.float32)


def search(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, candidates: np.ndarray, ids: np.ndarray,
    axes: np.ndarray, k: int = K, leading: int = LEADING, chunk: int = 512,
) -> Best:
    """Best k of one block of candidates for one block of queries, above the given floors.

    Bounds are cosines in single precision; the slack is wider than their error, and the
    scores are products of whole numbers.
    """
    best = Best(len(queries), k)
    norm, turned = unit(candidates, axes)
    order = np.lexsort((ids, -norm))
    candidates, ids, norm, turned = candidates[order], ids[order], norm[order], turned[order]
    qnorm, asked = unit(queries, axes)
    width = axes.shape[1]
    leads = [min(leading, width)]
    while leads[-1] < width:
        leads.append(min(2 * leads[-1], width))
    right = {}
    slack = 1e-6 + (width + 32) * 2.0**-23
    for slab in range(0, len(queries), SLAB):
        part = slice(slab, slab + SLAB)
        left = {}
        level, a = 0, 0
        while a < len(candidates):
            b = min(a + min(chunk, max(32, a)), len(candidates))  # few at first, while floors are low
            floor = np.maximum(floors[part], best.floor()[part])
            live = np.flatnonzero(qnorm[part] * norm[a] * (1 + slack) + slack >= floor)
            if not len(live):
                break  # later vectors are shorter still
            floor, length = floor[live], qnorm[part][live]
            longest = length * np.where(floor > 0, norm[a], norm[b - 1])
            need = np.where(longest > 0, floor / np.where(longest > 0, longest, 1), -np.inf) - slack
            need = np.maximum(need, -2).astype(np.float32)[:, None]
            tried = []
            for lead in leads[level:]:
                if lead not in right:
                    right[lead] = partial(turned, lead)
                if lead not in left:
                    left[lead] = partial(asked[part], lead)
                bound = left[lead][live] @ right[lead][a:b].T
                flat = np.flatnonzero(bound >= need)
                hit, at = np.divmod(flat, b - a)
                about = length[hit] * norm[a + at]
                sharp = (bound.ravel()[flat] + slack) * about + slack >= floor[hit]
                tried.append(np.count_nonzero(sharp))
                if tried[-1] * SPARSE <= bound.size:
                    break
            level += next(i for i, n in enumerate(tried) if n <= 2 * tried[-1])
            hit, at, about = slab + live[hit[sharp]], a + at[sharp], about[sharp]
            other = query_ids[hit] != ids[at]
            hit, at, about = hit[other], at[other], about[other]
            if len(hit):
                best.add(hit, ids[at], products(queries[hit], candidates[at], about))
            a = b
    return best


def _banded(df: DataFrame, value: str, bounds: list[float], least: bool = False) -> DataFrame:
    """``df`` with ``band``: how many bounds lie below the value, or with ``least`` not above it."""
    if not bounds:
        return df.withColumn("band", F.lit(0))
    found = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=value, outputCol="band").transform(df)
    at = F.col("band").cast("int")
    if not least:  # a value that is a bound belongs below it
        edge = F.get(F.lit(bounds).cast("array<double>"), at - 1)
        at = at - F.when(F.col(value) == edge, 1).otherwise(0)
    return found.withColumn("band", at)


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
    every: int = QUERY_EVERY, block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query."""
    kept = Scratch(vectors.sparkSession)
    rows = kept.keep(integers(vectors, vec_id, embedding), "vectors")
    size = rows.agg(
        F.max(F.size("v")), F.count("*"), F.count_if(F.col("vec_id") % every == 0),
        F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))),
    ).first()
    width, total, asking = size[0] or 0, size[1], size[2]
    blank = rows.where("false").selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0L AS score")
    if not asking or total < 2:
        return blank
    axes = directions(rows, width)
    if (size[3] or 0) < 2**15:  # a fourth of the bytes in every copy
        rows = rows.withColumn("v", F.col("v").cast("array<smallint>"))
    block, queries = (max(1, min(n, NUMBERS // max(width, 1))) for n in (block, queries))

    # Blocks of candidates by falling norm, of queries by id.  The bounds are quantiles, so
    # equal norms are dealt by a hash of the id to keep a common vector from one block.  There
    # are at most BANDS of them, each cut by a hash into as many blocks as keep a block small.
    blocks = min(parts_for(total, block), BANDS)
    salts = parts_for(total, block * blocks)
    keyed = rows.withColumn("place", -F.col("norm") + F.lit(1e-9) * F.expr("pmod(xxhash64(vec_id), 1000003)") / 1000003)
    bounds = sorted(set(keyed.approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    asking_blocks = parts_for(asking, queries)
    salt = F.expr(f"pmod(xxhash64(vec_id, 'salt'), {salts})")
    dealt = _banded(keyed, "place", bounds).select("vec_id", "v", "norm", (F.col("band") * salts + salt).cast("int").alias("block"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"), F.max_by("norm", "v").alias("norm"))
    asked = asked.select(
        "vec_id", "v", "norm", F.expr(f"pmod(xxhash64(vec_id), {asking_blocks})").cast("int").alias("asked")
    )
    asked = kept.keep(asked, "asked")
    limit = k

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, ids = matrix(left["v"], width), left["vec_id"].to_numpy()
        floors = left["floor"].to_numpy(dtype=float)
        best = search(q, ids, floors, matrix(right["w"], width), right["id"].to_numpy(), axes, limit)
        row, column = np.nonzero(best.score != NONE)
        return pd.DataFrame({"query_id": ids[row], "vec_id": best.id[row, column], "score": best.score[row, column]})

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """Each planned pair of blocks is one group: bounded queries against bounded candidates."""
        right = right.select(
            *[F.col(a).alias(b) for a, b in (("asked", "to"), ("block", "of"), ("vec_id", "id"), ("v", "w"))]
        )
        groups = left.groupBy("asked", "block").cogroup(right.groupBy("to", "of"))
        return groups.applyInPandas(meet, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ends = (len(bounds) + 1) * salts
    most = max(1, 2 * total // (asking + block * asking_blocks))  # blocks in a round, by the copies that it makes
    held, begin, turn = blank, 0, 0
    while begin < ends:
        end = min(ends, max(1, begin * REACH), begin + most)
        floors = held.groupBy(F.col("query_id").alias("vec_id")).agg(
            F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor")
        )
        now = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # What a block of queries still needs: its least ratio of floor and norm.  Blocks get
        # shorter, so each block of queries meets a leading run of them.
        need = F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(float("-inf"))))
        plan = now.groupBy("asked").agg(need.alias("need"))
        # the last band whose longest vector can still matter
        plan = _banded(plan.withColumn("place", F.when(F.col("need") <= 0, F.lit(float("inf"))).otherwise((1e-6 - F.col("need")) / (1 + 1e-6))), "place", bounds, least=True)
        last = F.least(((F.col("band") + 1) * salts - 1).cast("int"), F.lit(end - 1))
        plan = plan.withColumn("last", last).where(F.col("last") >= begin)
        plan = kept.keep(plan.select("asked", F.explode(F.sequence(F.lit(begin), "last")).alias("block")), f"plan{turn}")
        if plan.isEmpty():
            break
        later = pairs(now.join(plan, "asked"), dealt.join(plan, "block"))
        found = held.drop("rank").unionByName(later).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        held = kept.keep(found.select("query_id", "rank", "vec_id", "score"), f"held{turn}")
        kept.drop(f"plan{turn}", *([f"held{turn - 1}"] if turn else []))
        begin, turn = end, turn + 1
    return held


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
