"""Mixing sources to target weights by weighted sampling with exponential keys.

Every document draws one exponential key whose rate is its quality weight; a smaller key
comes first, so good documents tend to lead.  Within a source the documents are put in
key order and their sizes summed up from the front.  A source whose target holds its
whole size gives complete epochs first; the rest of its target is filled from the front
of the order, and the document at the edge counts where that brings the sum nearer.

A source may hold a third of all rows, so no window covers a whole source: documents
fall into key ranges of a source, a window runs within a range, and the ranges' totals
carry on.  The number of ranges grows with the largest source.

Edge cases: a null or empty text has size 0 and is taken 0 times; null sources are one
source, the last; repeated rows draw the same key and are taken one after the other; ties
in the key go by id, nulls first, then size.  A source without words has target 0.
No rows in, no rows out.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all sizes, taken together
MOST = 2  # times its size a source may give
RANGE_ROWS = 50_000
RANGES = 5_000  # at most, so that the quantiles stay a small sketch


def quality_weight(size: Column, characters: Column) -> Column:
    """Between 0 and 1: how near the mean word is to five characters, spaces apart."""
    return 1.0 / (1.0 + F.abs((characters - size) / F.greatest(size, F.lit(1)) - 5.0))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that any engine derives alike from the id."""
    digest = F.md5(F.concat(F.lit("mix|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, print, source, size, key``: fingerprint of the text, size in words and exponential key."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("characters"),
        F.xxhash64(F.col(text).cast("string")).alias("print"),
    )
    return base.select(
        "doc_id", "print", "source", "size",
        (-F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("size"), F.col("characters"))).alias("key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: one row per source.

    Sources are ordered by the size they may give per weight.  As long as a source cannot
    take its part of what the full ones before it leave, it is full too; the first one that
    can sets the rate at which it and all later ones share by weight.
    The windows here run over one row per source, never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (budget - before) / after)
    full = F.col("limit") < F.col("level") * F.col("weight")
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("rate", F.first(F.when(~full, F.col("level")), ignorenulls=True).over(whole))
    target = F.least(F.col("rate") * F.col("weight"), F.col("limit").cast("double"))  # least skips a null
    return level.select("source", "source_size", "documents", target.alias("target"))


def mix(sizes: DataFrame, goals: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``sizes`` with ``source_size``, ``target`` and ``taken``; both tables are written ones."""
    ranges = min(parts_for(sizes.count(), range_rows), RANGES)
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(sizes.approxQuantile("key", cuts, 0.2 / ranges))) if cuts else []
    if bounds:
        binner = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="key", outputCol="range", handleInvalid="keep")
        split = binner.transform(sizes)
    else:
        split = sizes.withColumn("range", F.lit(0.0))
    carried = split.groupBy("source", "range").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("source", "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carry"))
    plan = carried.join(goals, carried.source.eqNullSafe(goals.source)).select(
        carried.source.alias("of"), F.col("range").alias("part"), "carry", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # one row per source and range: Spark measures it and broadcasts it where it is small
    rows = split.withColumn("upto", F.sum("size").over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("part"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    ahead = F.col("carry") + F.col("upto") - F.col("size")
    taken = F.col("size") * (epochs + F.when(ahead + F.col("size") / 2 <= rest, 1).otherwise(0))
    return rows.select("doc_id", "print", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Texts are read once, for sizes and keys; only those rows are written and dealt out."""
    sizes = written(measure(docs, doc_id, text, source), "sizes")
    return mix(sizes, written(targets(sizes), "targets"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(coalesce(length(text), 0) AS BIGINT) AS characters,
    (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + abs(CAST(characters - size AS DOUBLE) / greatest(size, 1) - 5.0::DOUBLE))) AS key
  FROM d),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM k GROUP BY source),
l AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS lim,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM t)
      - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
g AS (
  SELECT source, source_size, least(lim, weight * (
    SELECT level FROM l WHERE NOT lim < level * weight ORDER BY lim / weight, source NULLS LAST LIMIT 1)) AS target
  FROM l),
p AS (
  SELECT k.doc_id, k.source, k.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
