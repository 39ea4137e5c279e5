"""Near duplicates by banded MinHash with odd sketches, confirmed on full shingle sets.

Each document's set of word shingles gives MinHash samples.  Rows of samples form bands,
whose keys bring candidates together; all samples are folded into a parity bitmap, the
odd sketch.  The population count of two sketches' XOR estimates how many samples differ,
most precisely where few do, and so tells which candidates are worth an exact check.  A
second bitmap holds the parities of the whole set: two of them differ in at most as many bits
as the sets in shingles, so sets too far apart for the threshold are told without any loss.

Documents with equal sets are one from the start.  The least member of a bucket leads it, and
every document meets the leads it shares most bands with; what exact checks confirm becomes
links.  Only in buckets whose members are not yet in one component, members meet across
components, as sketches, and pairs that may reach the threshold are checked.  A bucket of more
than ``BLOCK`` members is dealt by size class and salt into blocks, and each pair of blocks
whose sizes may reach the threshold is a group of its own: a task holds a few blocks however
large the bucket is.  Pairs within such a bucket are still all looked at, so where a family
just under the threshold grows with the corpus, the work grows with its square and its copies
of sketches with the square over ``BLOCK``, spread over all tasks; what goes on to a full check
does not, as long as the parities tell the pairs apart.

Recall: with 72 bands of 8 rows a pair at similarity 0.8 shares no band with probability
2e-6, and its estimate falls under the margin with about 1e-5; closer pairs less.  Pairs at
0.3, which common passages make in numbers, meet in a band with probability 0.005.

Edge cases: without words, or with a null text, the set is empty, the size 0 and the
document its own component; with fewer words than a shingle has, the whole sequence is one
shingle; rows with a null id are returned with a null component and kept; rows that share
an id are judged each by its own text, which a fingerprint names; repeated rows get equal
results.  Only the named columns are read.

Shingles are compared by strong 64-bit hashes: within a pair of documents of a thousand
shingles two different ones agree with probability 1e-13.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, U, column, mix, slices, written
from .components import components
from .text_statistics import Words

BANDS, ROWS = 72, 8
SAMPLES = BANDS * ROWS
BITS = 4096
PARITIES = 2048  # bits of the whole set's parities
WORDS = BITS // 64  # of a sketch, before the parities
MARGIN = 0.07  # over four standard errors of the estimate
SURE = 0.88  # four standard errors above 0.8
BLOCK = 4096  # members of a bucket that are compared together
LEADS = 8  # leads that a document meets before components are drawn
PAIRS = 200_000  # pairs that a task holds before it passes them on
_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U))
_XOR, _TIMES = _SEEDS[:SAMPLES].astype(np.uint32), _SEEDS[SAMPLES:].astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles, sorted within each text, and the bounds of each text."""
    lower = texts.data.copy()
    lower[(lower >= 65) & (lower <= 90)] |= 32
    texts.data = lower
    words = Words(texts)
    h, owner, n = words.hash, words.owner, texts.n
    count = words.counts()
    m = max(0, len(h) - width + 1)
    key = np.full(m, 0x2545F4914F6CDD1D, dtype=U)
    for k in range(width):
        key = mix(key * U(3) ^ h[k : k + m])
    whole = owner[:m] == owner[width - 1 :][:m] if m else np.zeros(0, bool)
    key, who = key[whole], owner[:m][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.full(len(short), 0x9E6C63D0876A3F6B, dtype=U)
        for k in range(width - 1):
            there = k < count[short]
            extra[there] = mix(extra[there] * U(3) ^ h[first[there] + k])
        key, who = np.concatenate([key, extra]), np.concatenate([who, short])
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who = key[new], who[new]
    return key, np.searchsorted(who, np.arange(n + 1))


def _signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, odd sketches with the sets' parities behind them, and fingerprints of non-empty sets."""
    start = bounds[:-1]
    sample = np.empty((len(start), SAMPLES), dtype=U)
    narrow = (sets >> U(32)).astype(np.uint32)
    for k in range(SAMPLES):
        sample[:, k] = np.minimum.reduceat((narrow ^ _XOR[k]) * _TIMES[k], start)
    folded = mix(sample + np.arange(SAMPLES, dtype=U) * U(0xD6E8FEB86659FD93))
    bands = np.full((len(start), BANDS), 0, dtype=U)
    for r in range(ROWS):
        bands = mix(bands ^ folded[:, r::ROWS])
    bit = (folded % U(BITS)).astype(np.int64)
    hits = np.bincount((np.arange(len(start))[:, None] * BITS + bit).ravel(), minlength=len(start) * BITS)
    sketch = np.packbits((hits & 1).astype(np.uint8).reshape(len(start), BITS), axis=1).view(np.int64)
    at = np.repeat(np.arange(len(start)), np.diff(bounds)) * PARITIES + (mix(sets + U(3)) % U(PARITIES)).astype(np.int64)
    hits = np.bincount(at, minlength=len(start) * PARITIES)
    whole = np.packbits((hits & 1).astype(np.uint8).reshape(len(start), PARITIES), axis=1).view(np.int64)
    sketch = np.hstack([sketch, whole])
    print_ = np.column_stack([np.add.reduceat(mix(sets + U(k)), start) for k in (1, 2)])
    return bands, sketch, print_


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.select("doc_id", F.xxhash64("text").alias("print"), "text")


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``doc_id, print, n, p1, p2, bands, sketch``: the text's and the set's fingerprint, size, band keys, odd sketch."""
    source = _source(docs, doc_id, text)
    schema = source.selectExpr("doc_id", "print", "0L AS n", "0L AS p1", "0L AS p2", "array(0L) AS bands", "array(0L) AS sketch").schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(Texts(column(batch, "text")), width)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            prints = np.zeros((len(size), 2), dtype=U)
            lists = []
            if len(full):
                bands, sketch, prints[full] = _signatures(sets, np.append(bounds[:-1][full], len(sets)))
            else:
                bands, sketch = np.zeros((0, BANDS), U), np.zeros((0, WORDS + PARITIES // 64), np.int64)
            for made in (bands.view(np.int64), sketch):
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, made.shape[1], 0))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(at, pa.array(made.ravel())))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "print"), pa.array(size.astype(np.int64)), pa.array(prints[:, 0].view(np.int64).copy()
                 if len(size) else np.zeros(0, np.int64)),
                 pa.array(prints[:, 1].copy().view(np.int64)), *lists],
                names=schema.names,
            )

    return source.mapInArrow(sign, schema)


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the population count of two odd sketches' XOR."""
    differing = _differing(F.slice(a, 1, WORDS), F.slice(b, 1, WORDS))
    return 1 + BITS / (4.0 * SAMPLES) * F.log(F.greatest(1 - 2.0 * differing / BITS, F.lit(1e-9)))


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold.

    Texts of nodes in a pair are found by a hash join that keeps the text side
    unsorted; only their sets go on.
    """
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = asked.join(nodes.select("node", "doc", F.col("print").alias("of")), "node")
    needed = written(needed, "needed")
    source = _source(docs, doc_id, text)
    source = source.join(needed.hint("shuffle_hash"), (source["doc_id"] == needed["doc"]) & (source["print"] == needed["of"]))
    source = source.select("node", "text")
    schema = source.selectExpr("node", "array(0L) AS shingles").schema

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(Texts(column(batch, "text")), width)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "node"), pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(sets.view(np.int64)))],
                names=schema.names,
            )

    # rows repeated in full give one set
    sets = written(source.mapInArrow(collect, schema).dropDuplicates(["node"]), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave the threshold possible."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    met = pairs.join(left, "a").join(right, "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    apart = _differing(*[F.slice(k, WORDS + 1, PARITIES // 64) for k in ("ka", "kb")])
    sizes &= apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
    return met.where(sizes & (estimate(F.col("ka"), F.col("kb")) >= percent / 100 - MARGIN)).select("a", "b")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within groups, found on sketches, streamed group by group.

    ``rows``: key, side, node, component, n, sketch, as ``_divided`` gives them.  A pair that
    is surely similar joins its two components within the group, so later members of both no
    longer meet each other and a large family gives a star, not all its pairs.
    """
    least = percent / 100

    def bucket(side: np.ndarray, node: np.ndarray, part: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
        """Plausible partners of one member after the other, as rows (a, b)."""
        order = np.lexsort((node, n))
        side, node, part, n, sketch = side[order], node[order], part[order], n[order], sketch[order]
        ends = np.searchsorted(n * percent, n * 100, side="right")  # sizes that may reach the threshold
        for i in range(len(node) - 1):
            later = slice(i + 1, ends[i])
            rest = np.flatnonzero((part[later] != part[i]) & ((side[later] == 0) | (side[later] != side[i]))) + i + 1
            if not len(rest):
                continue
            apart = np.bitwise_count(sketch[rest, WORDS:] ^ sketch[i, WORDS:]).sum(axis=1, dtype=np.int64)
            rest = rest[apart * (100 + percent) <= (100 - percent) * (n[rest] + n[i])]
            if not len(rest):
                continue
            differing = np.bitwise_count(sketch[rest, :WORDS] ^ sketch[i, :WORDS]).sum(axis=1, dtype=np.int64)
            close = 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / BITS, 1e-9))
            hit = rest[close >= least - MARGIN]
            joined = np.unique(part[rest[close >= SURE]])
            if len(joined):
                part[np.isin(part, joined)] = part[i]
            yield np.column_stack([np.full(len(hit), node[i]), node[hit]])

    def settle(table: pa.Table) -> Iterator[np.ndarray]:
        keys = table["key"].to_numpy()
        side, node, part, n = (table[c].to_numpy() for c in ("side", "node", "component", "n"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(U).reshape(len(keys), -1)
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield from bucket(side[i:j], node[i:j], part[i:j], n[i:j], sketch[i:j])

    def passed_on(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs in batches of bounded size, each pair once in a batch."""
        held, count = [], 0
        for pairs in found:
            held.append(pairs)
            count += len(pairs)
            if count >= PAIRS:
                yield batch_of(np.concatenate(held))
                held, count = [], 0
        if count:
            yield batch_of(np.concatenate(held))

    def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[new, 0]), pa.array(pairs[new, 1])], names=["a", "b"])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = column(batch, "key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from passed_on(pairs for table in tables(batches) for pairs in settle(table))

    ordered = rows.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(stream, "a long, b long").distinct()


def _divided(members: DataFrame, found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members, with components and sketches, of buckets that hold several components.

    ``key`` is the bucket, or a pair of blocks of a crowded bucket; ``side`` tells the two
    blocks of a pair apart and is 0 where all members meet.
    """
    placed = members.select("key", "node").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    split = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    ).where("low <> high")
    split = written(split.select("key", "size"), "split")
    crowded = split.where(F.col("size") > BLOCK).select("key")
    sketched = nodes.select("node", "n", "sketch")
    if not crowded.limit(1).count():
        rest = placed.join(split.select("key"), "key").join(sketched, "node")
        return rest.select("key", F.lit(0).alias("side"), "node", "component", "n", "sketch")

    # sizes that may reach the threshold together are in one class or in neighbouring ones
    step = max(math.log(100 / max(percent, 1)), 0.01) * (1 + 1e-9)
    kind = F.floor(F.log("n") / step)
    counts = placed.join(crowded, "key").join(nodes.select("node", "n"), "node").groupBy("key", kind.alias("kind")).count()
    blocks = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(
        F.struct("kind", F.ceil(F.col("count") / BLOCK).alias("n"))
    )).alias("blocks"))
    split = split.select("key").join(blocks, "key", "left")
    rest = placed.join(split, "key").join(sketched, "node").withColumn("kind", kind)
    own = F.struct("kind", F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("kind")]).alias("salt"))
    near = F.filter(F.array(*[F.col("kind") + d for d in (-1, 0, 1)]), lambda k: F.map_contains_key("blocks", k))
    others = F.flatten(F.transform(near, lambda k: F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks")[k] - 1), lambda t: F.struct(k.alias("kind"), t.alias("salt"))
    )))
    met = F.transform(others, lambda o: F.struct(
        F.xxhash64("key", F.least("own", o), F.greatest("own", o)).alias("key"),
        F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2).alias("side"),
    ))
    alone = F.array(F.struct("key", F.lit(0).alias("side")))
    rest = rest.withColumn("own", F.when(F.col("blocks").isNotNull(), own))
    rest = rest.withColumn("group", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(met)))
    return rest.select("group.key", "group.side", "node", "component", "n", "sketch")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return judge(docs, doc_id, text, width, percent).drop("print")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The same with ``print``, the fingerprint of the row's text, for rows that share an id."""
    signed = written(signatures(docs, doc_id, text, width), "signed")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    equal = ["n", "p1", "p2"]
    # a node is a different set; its number is the least id that has it, or where that id has
    # several sets, a number of its own for all but one
    classes = full.groupBy(*equal).agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc"), "print")).alias("first"))
    classes = classes.select(*equal, "first.*")
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("print"))
    own = F.when(turn == 1, F.col("doc")).otherwise(-1 - F.abs(F.shiftright(F.xxhash64(*equal, "doc", "print"), 1)))
    classes = written(classes.withColumn("node", own), "classes")
    firsts = classes.select(*[F.col(c).alias(f"of_{c}") for c in equal], "doc", F.col("print").alias("of_print"), "node")
    same = [F.col(c) == F.col(f"of_{c}") for c in equal]
    nodes = full.join(firsts, [*same, F.col("doc_id") == F.col("doc"), F.col("print") == F.col("of_print")])
    nodes = written(nodes.select("node", "doc", "print", "n", "sketch", "bands").dropDuplicates(["node"]), "nodes")

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = written(keyed.join(buckets, "key"), "buckets")
    # each member first meets the leads that it shares most bands with; whatever that
    # leaves in several components is settled bucket by bucket below
    shared = members.where("node <> lead").groupBy("lead", "node").agg(F.count("*").alias("bands"))
    nearest = Window.partitionBy("node").orderBy(F.desc("bands"), "lead")
    stars = shared.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= LEADS)
    stars = stars.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = written(_plausible(stars, nodes, percent), "pairs")
    links = written(_confirm(docs, nodes, pairs, doc_id, text, width, percent), "links")
    found = written(components(links), "components")

    more = written(_across(_divided(members, found, nodes, percent), percent), "pairs")
    if more.limit(1).count():
        links = written(links.unionByName(_confirm(docs, nodes, more, doc_id, text, width, percent)), "links")
        found = written(components(links), "components")

    placed = classes.join(found, "node", "left").select(*equal, "doc", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc").alias("least"))
    of_class = placed.join(least, "component").select(*equal, "least")
    out = signed.select("doc_id", "print", *equal).join(of_class, equal, "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"),
        F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept"), "print",
    )
