"""Random forests grown level by level from histograms and kept as tables of nodes.

Features are cut into bins once.  All trees of all models grow together: the sample of a
tree is the rows that its class-stratified bootstrap drew, with how often.  Models of at most
``WHOLE_BYTES`` of bins are dealt out in batches of trees: a group gets the model's bins once,
draws the sample of each of its trees and grows it.  Larger models grow by levels.  While a node
has many rows, one aggregate per level counts draws by (tree, node, feature, bin, class), the best
split comes from cumulative counts, and rows move to the children.  A node with at most
``subtree_rows`` rows is finished in one bounded group.  The rule is the same everywhere, and so
are the trees.

A node tries ``floor(sqrt(features))`` features, drawn by a hash of seed, tree and node.  A split
is judged by the class-weighted Gini impurity, weights being 1 / sample size of the class.
Counts are whole numbers and ties have an order, so a rerun grows the same trees.

A model is a table of nodes ``(iteration, fold, tree, node, feature, threshold, class, gain,
draws)``: node 1 is the root, ``2 n`` the child for values below the threshold and ``2 n + 1``
the other; missing values go there as well.  Leaves have no feature.  A forest is one model, with
iteration and fold 0; a bank holds one per repeat and held-out fold.  On disk the nodes of a tree
are arrays in one row or a few.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import fixed_values as fv
from ..functions.hashing import hash_key, uniform
from ..session import reachable, settle, shuffle_width
from .labels import check_classes, sample_sizes
from .ordered import hashed_row_number
from .sampling import drawn_ranks, key_uniforms, route_to_fold, stratified_bootstrap, stratified_folds

MODEL = ["iteration", "fold"]
TREE = [*MODEL, "tree"]
CLASSES = (fv.OTHER, fv.ONCOGENE, fv.TSG)
WHOLE_BYTES = 256 << 20  # bins of one model that a group may hold
TREE_BYTES = 32 << 20  # of trees that are read at a time
PACKED_ROWS = 16_384  # rows of a model that travel together
GROUPS = 400  # groups that all trees are dealt to, unless they are fewer than LEAST_TREES each
LEAST_TREES = 4
ROWS_PER_TASK = 1_000_000  # rows of all trees that are worth a task
SPREAD = 4  # tasks for each such group, so that few meet in one
ROUTED_ROWS = 500_000  # rows that one group scores with one batch of trees
ROUTED_NODES = 20_000_000  # nodes of such a batch
ROUTED_STEPS = 1 << 23  # pairs of row and tree of such a group
ROUTED_AT_ONCE = 16_384  # rows that move together
BETTER = 1 + 1e-9  # a split has to be better than none by more than rounding
NEAR = np.float32(1 - 1e-5)  # of the best score, what rounding to single precision may come to and more
ROWS_AT_ONCE = 32_768  # rows of a tree that are split together
MANY_ROWS = 4  # rows for each bin from which a node's draws are counted and not sorted
LONG_ROWS = 1_200  # rows of a node that are worth a count of their own


@dataclass(frozen=True)
class ForestSettings:
    """How forests are grown; ``trees`` is the size of one forest.

    ``plain`` draws from all rows alike, with weights 1 / class size, instead of by class.
    """

    trees: int = 200
    driver_rate: float = 0.7
    other_ratio: float = 1.0
    max_depth: int = 30
    max_bins: int = 64
    seed: int = 71
    plain: bool = False
    subtree_rows: int = 20_000

    def tried(self, features: int) -> int:
        return max(1, math.isqrt(features))


# --- bins -----------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Values at the quantiles of each feature, without repeats: at most ``max_bins - 1``."""
    at = [i / max_bins for i in range(1, max_bins)]
    number = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(str(i)) for i, c in enumerate(number)]).first()
    return [sorted(set(row[str(i)] or [])) for i in range(len(features))]


def binned(df: DataFrame, features: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """``df`` with ``bins``: how many edges are not above each feature."""
    cut = [i for i in range(len(features)) if edges[i]]
    columns = [F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)]
    wide = df.select("*", *columns)
    if cut:
        wide = Bucketizer(
            inputCols=[f"__f{i}" for i in cut], outputCols=[f"__b{i}" for i in cut], handleInvalid="keep",
            splitsArray=[[float("-inf"), *edges[i], float("inf")] for i in cut],
        ).transform(wide)
    bins = [F.col(f"__b{i}") if edges[i] else F.lit(0) for i in range(len(features))]
    return wide.select(*df.columns, F.array(*[b.cast("smallint") for b in bins]).alias("bins"))


# --- samples --------------------------------------------------------------------------------


def _seed(settings: ForestSettings) -> Column:
    return F.lit(settings.seed) + 100 * F.col("iteration") + F.col("fold")


def _poisson_bounds(terms: int = 12) -> list[float]:
    """Bounds of u for 0, 1, ... draws: what n draws of n rows come to, without counting rows."""
    bound, share, bounds = 0.0, math.exp(-1.0), []
    for k in range(terms):
        bound += share
        bounds.append(bound)
        share /= k + 1
    return bounds


POISSON = _poisson_bounds()


def draw_samples(members: DataFrame, key: str, label: str, settings: ForestSettings) -> DataFrame:
    """``iteration, fold, tree, key, label, draws`` and the sample sizes ``s0, s1, s2`` of the classes.

    ``members``: iteration, fold, key and label of every model's training rows.
    """
    if settings.plain:
        sizes = members.groupBy(*MODEL, label).agg(F.count("*").alias("sample_size"))
        tree = F.explode(F.sequence(F.lit(1), F.lit(settings.trees))).alias("tree")
        u = uniform(hash_key(_seed(settings), "tree", key))
        draws = F.lit(len(POISSON))
        for k, bound in reversed(list(enumerate(POISSON))):
            draws = F.when(u < bound, k).otherwise(draws)
        drawn = members.select(*MODEL, key, label, tree).withColumn("draws", draws.cast("bigint")).where("draws > 0")
    else:
        sizes = sample_sizes(members, label, settings.driver_rate, settings.other_ratio, by=tuple(MODEL))
        drawn = stratified_bootstrap(
            members, key, label, settings.trees, settings.driver_rate, settings.other_ratio, _seed(settings), by=MODEL
        )
    return drawn.join(_of_class(sizes, label, "sample_size", "s"), MODEL)


def _of_class(sizes: DataFrame, label: str, column: str, prefix: str) -> DataFrame:
    """One row per model, with ``column`` of each class."""
    return sizes.groupBy(*MODEL).agg(
        *[F.coalesce(F.max(F.when(F.col(label) == c, F.col(column))), F.lit(0)).alias(f"{prefix}{c}") for c in CLASSES]
    )


# --- one level, as one aggregate ------------------------------------------------------------


_LOW = (1 << 32) - 1


def _mixed(x: Column) -> Column:
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)).bitwiseAND(F.lit(_LOW))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mixed(x: np.ndarray) -> np.ndarray:
    """The same in a task, as numbers of 32 bits."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(73244475)
    return x ^ (x >> np.uint32(16))


def tried_features(seed: Column, features: int, tried: int) -> Column:
    """The features a node tries, in the order of their hashes."""
    h = _mixed(seed.cast("bigint").bitwiseAND(F.lit(_LOW)))
    for part in ("tree", "node"):
        h = _mixed((h + F.col(part)).bitwiseAND(F.lit(_LOW)))
    each = F.transform(
        F.sequence(F.lit(0), F.lit(features - 1)),
        lambda f: F.struct(_mixed((h + f).bitwiseAND(F.lit(_LOW))).alias("h"), f.alias("f")),
    )
    return F.transform(F.slice(F.array_sort(each), 1, tried), lambda s: s["f"])


def draw_features(seed: int, tree: int, nodes: np.ndarray, features: int, tried: int) -> np.ndarray:
    """The same in a task, one row per node."""
    h = mixed(np.array([seed & _LOW], dtype=np.uint32))
    h = mixed(h + np.uint32(tree & _LOW))
    h = mixed(h + (nodes & _LOW).astype(np.uint32))
    each = np.arange(features, dtype=np.uint32)
    h = np.sort(mixed(h[:, None] + each).astype(np.uint64) << np.uint64(32) | each, axis=1)
    return (h[:, :tried] & np.uint64(_LOW)).astype(np.int64)


def _impurity(n: Sequence[Column]) -> Column:
    """Sum of squared class weights over their sum; counts enter as doubles."""
    w = [F.when(F.col(f"s{c}") > 0, x.cast("double") / F.col(f"s{c}").cast("double")).otherwise(F.lit(0.0)) for c, x in zip(CLASSES, n, strict=True)]
    total = w[0] + w[1] + w[2]
    return F.try_divide(w[0] * w[0] + w[1] * w[1] + w[2] * w[2], total)


def level_nodes(active: DataFrame, features: int, settings: ForestSettings) -> DataFrame:
    """One row for every node of ``active``: the best split, or none, with class and gain.

    ``active``: iteration, fold, tree, node, label, draws, bins, s0, s1, s2.
    """
    node, sizes = [*TREE, "node"], [f"s{c}" for c in CLASSES]
    drawn = [F.sum(F.when(F.col("label") == c, F.col("draws")).otherwise(0)).alias(f"n{c}") for c in CLASSES]
    chosen = tried_features(_seed(settings), features, settings.tried(features))
    tried = active.select(*node, *sizes, "label", "draws", "bins", F.posexplode(chosen).alias("turn", "feature"))
    cells = tried.groupBy(*node, *sizes, "turn", "feature", F.element_at("bins", F.col("feature") + 1).alias("bin")).agg(*drawn)
    whole = Window.partitionBy(*node, "turn")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({f"l{c}": F.sum(f"n{c}").over(upto) for c in CLASSES})
    cells = cells.withColumns({f"a{c}": F.sum(f"n{c}").over(whole) for c in CLASSES})
    right = [F.col(f"a{c}") - F.col(f"l{c}") for c in CLASSES]
    left_score, right_score = _impurity([F.col(f"l{c}") for c in CLASSES]), _impurity(right)
    own = _impurity([F.col(f"a{c}") for c in CLASSES])
    apart = right[0] + right[1] + right[2] > 0
    mixed_ = F.when(F.col("a0") > 0, 1).otherwise(0) + F.when(F.col("a1") > 0, 1).otherwise(0) + F.when(F.col("a2") > 0, 1).otherwise(0) > 1
    cells = cells.withColumn("own", own).withColumn("score", F.when(apart & mixed_, left_score + right_score))
    cells = cells.withColumn("score", F.when(F.col("score") > F.col("own") * BETTER, F.col("score")))
    order = F.struct(F.col("score"), -F.col("turn"), -F.col("bin"))
    best = cells.groupBy(*node, *sizes).agg(
        F.max_by(F.struct("feature", "bin", "score"), F.when(F.col("score").isNotNull(), order)).alias("best"),
        F.max("own").alias("own"), *[F.max(f"a{c}").alias(f"a{c}") for c in CLASSES],
    )
    w = [F.when(F.col(f"s{c}") > 0, F.col(f"a{c}") / F.col(f"s{c}")).otherwise(F.lit(0.0)) for c in CLASSES]
    most = F.when((w[0] >= w[1]) & (w[0] >= w[2]), 0).when(w[1] >= w[2], 1).otherwise(2)
    depth = F.floor(F.log2(F.col("node").cast("double")))
    best = best.withColumn("best", F.when(depth < settings.max_depth, F.col("best")))
    return best.select(
        *node, F.col("best.feature").cast("int").alias("feature"), F.col("best.bin").cast("int").alias("bin"),
        most.alias("class"), F.coalesce(F.col("best.score") - F.col("own"), F.lit(0.0)).alias("gain"),
        (F.col("a0") + F.col("a1") + F.col("a2")).alias("draws"),
    )


def move_rows(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of split nodes, one level down."""
    node = [*TREE, "node"]
    split = nodes.where("feature IS NOT NULL").select(*node, "feature", "bin")
    moved = active.join(split, node)
    below = F.element_at("bins", F.col("feature") + 1) <= F.col("bin")
    moved = moved.withColumn("node", 2 * F.col("node") + F.when(below, 0).otherwise(1))
    return moved.drop("feature", "bin")


# --- small nodes, in bounded groups ---------------------------------------------------------


@dataclass(frozen=True)
class _Weights:
    """Class weights, 1 / sample size, and the impurity of counts under them."""

    divisor: np.ndarray
    there: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> _Weights:
        # divisions in the order of the aggregate's, so that both round alike
        divisor, there = np.where(sizes > 0, sizes, 1).astype(float), (sizes > 0).astype(float)
        return cls(divisor, there, (there / divisor).astype(np.float32))

    def kinds(self, counts: np.ndarray) -> np.ndarray:
        return np.argmax(counts / self.divisor * self.there, axis=1)

    def impurity(self, counts: np.ndarray) -> np.ndarray:
        w = [counts[:, c] / self.divisor[c] * self.there[c] for c in CLASSES]
        return (w[0] * w[0] + w[1] * w[1] + w[2] * w[2]) / (w[0] + w[1] + w[2])

    def near_impurity(self, counts: Sequence[np.ndarray]) -> np.ndarray:
        """The same in single precision, off by less than a millionth of it."""
        total = square = np.float32(0)
        for c, n in enumerate(counts):
            w = n.astype(np.float32)
            w *= self.near[c]
            total = total + w
            w *= w
            square = square + w
        return square / total


def grow_subtree(
    bins: np.ndarray, label: np.ndarray, draws: np.ndarray, sizes: np.ndarray, seed: int, tree: int,
    node: int, tried: int, max_depth: int,
) -> tuple[np.ndarray, ...]:
    """``node, feature (or -1), bin, class, gain, draws`` of a node and everything below it, by node.

    Open nodes wait in piles, each with its rows one after the other, and some ``ROWS_AT_ONCE``
    rows are split together.  Draws of nodes with many rows are counted by (node, bin, class); rows of
    the others are sorted by node and bin, so that the counts left of every cut are running sums.
    Cuts are judged in single precision first, and those near the best again in double precision.
    """
    if len(label) and (label.min() < 0 or label.max() > 2):
        raise ValueError("classes are 0, 1 and 2")
    weights, features, width = _Weights.of(sizes), bins.shape[1], int(bins.max(initial=0)) + 1
    large, small, made = [], [], []

    def keep(nodes: np.ndarray, counts: np.ndarray, lengths: np.ndarray, bins: np.ndarray, code: np.ndarray, order: np.ndarray) -> None:
        """Make leaves of nodes that cannot split; the others wait with their rows."""
        split = ((counts > 0).sum(axis=1) > 1) & (nodes < 1 << max_depth)
        if not split.all():
            leaf, none = counts[~split], np.zeros(len(nodes) - split.sum(), np.int64)
            made.append((nodes[~split], none - 1, none, weights.kinds(leaf), none.astype(float), leaf.sum(axis=1)))
        many = lengths >= MANY_ROWS * width
        for pile, kept in ((large, split & many), (small, split & ~many)):
            if kept.any():
                rows = order if kept.all() else order[np.repeat(kept, lengths)]
                pile.append((nodes[kept], counts[kept], lengths[kept], bins.take(rows, axis=0), code.take(rows)))

    total = np.bincount(label, weights=draws, minlength=3).astype(np.int64).reshape(1, 3)
    code = draws.astype(np.int64) << 2 | label
    keep(np.array([node], np.int64), total, np.array([len(label)]), bins, code, np.arange(len(label)))
    while large or small:
        pile = large or small
        parts = [pile.pop()]
        while pile and sum(len(p[-1]) for p in parts) < ROWS_AT_ONCE:
            parts.append(pile.pop())
        part = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        if len(part[-1]) > 2 * ROWS_AT_ONCE and len(part[0]) > 1:
            ends = np.cumsum(part[2])
            here = min(max(1, int(np.searchsorted(ends, ROWS_AT_ONCE, side="right"))), len(ends) - 1)
            cut = [here] * 3 + [ends[here - 1]] * 2
            pile.append(tuple(x[c:] for x, c in zip(part, cut, strict=True)))
            part = tuple(x[:c] for x, c in zip(part, cut, strict=True))
        nodes, counts, lengths, bins, code = part
        chosen, start = draw_features(seed, tree, nodes, features, tried), np.arange(0, bins.size, features)
        of, turn, last, left = (_counted_cuts if pile is large else _sorted_cuts)(bins, start, code, chosen, lengths, counts, width, weights)
        score = weights.impurity(left.astype(float)) + weights.impurity((counts[of] - left).astype(float))
        own, best = weights.impurity(counts.astype(float)), np.full(len(nodes), -np.inf)
        np.maximum.at(best, of, score)
        hit = np.flatnonzero((score == best[of]) & (score > (own * BETTER)[of]))
        split, lead = np.unique(of[hit], return_index=True)
        hit = hit[lead]
        feature, cut, gain = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
        feature[split], cut[split], gain[split] = chosen[split, turn[hit]], last[hit], score[hit] - own[split]
        made.append((nodes, feature, cut, weights.kinds(counts), gain, counts.sum(axis=1)))
        if not len(split):
            continue
        # rows of split nodes, those of a left child before those of its sibling
        of_row, rows, lengths = np.repeat(feature, lengths), None, lengths[split]
        if len(split) < len(nodes):
            rows = np.flatnonzero(of_row >= 0)
            of_row, start = of_row[rows], start[rows]
        above = bins.ravel().take(start + of_row) > np.repeat(cut[split].astype(bins.dtype), lengths)
        number = np.uint8 if len(split) <= 1 << 7 else np.uint16 if len(split) <= 1 << 15 else np.int64  # short ones are sorted by radix
        order = np.argsort(np.repeat(np.arange(0, 2 * len(split), 2, dtype=number), lengths) + above, kind="stable")
        right = np.add.reduceat(above, np.cumsum(lengths) - lengths, dtype=np.int64)
        keep(
            np.column_stack([2 * nodes[split], 2 * nodes[split] + 1]).ravel(), np.stack([left[hit], counts[split] - left[hit]], axis=1).reshape(-1, 3),
            np.column_stack([lengths - right, right]).ravel(), bins, code, order if rows is None else rows[order],
        )
    found = [np.concatenate([m[i] for m in made]) for i in range(6)]
    order = np.argsort(found[0])
    return tuple(x[order] for x in found)


def _fields(most: int) -> tuple[list[list[int]], int]:
    """Classes whose counts, of at most ``most``, go into one number that a double holds, and bits of each."""
    bits = max(1, most.bit_length())
    together = max(1, min(len(CLASSES), 53 // bits))
    return [list(CLASSES[i : i + together]) for i in range(0, len(CLASSES), together)], bits


def _counted_cuts(
    bins: np.ndarray, start: np.ndarray, code: np.ndarray, chosen: np.ndarray, lengths: np.ndarray, counts: np.ndarray, width: int, weights: _Weights,
) -> tuple[np.ndarray, ...]:
    """Node, turn, last bin on the left and counts on the left of the cuts near the best of a node, from counts by (node, bin).

    Cuts of a node come in the order of turns and bins.  ``code`` is four times the draws of a row, plus its class.
    """
    n, tried = chosen.shape
    fields, bits = _fields(int(counts.max()))
    draws, label = code >> 2, code & 3
    held = []
    for classes in fields:
        place = np.zeros(4)
        place[classes] = [1 << bits * k for k in range(len(classes))]
        held.append(draws * place[label])
    long, flat = len(code) >= LONG_ROWS * n, bins.ravel()
    ends = np.cumsum(lengths)
    spans = [slice(a, b) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
    cell = None if long else np.repeat(np.arange(0, n * width, width), lengths)
    scores, lefts = [], []
    for turn in range(tried):
        feature, left = chosen[:, turn], []
        if not long:
            key = flat.take(start + np.repeat(feature, lengths)).astype(np.int64)
            key += cell
        for classes, w in zip(fields, held, strict=True):
            if long:
                cells = np.concatenate([np.bincount(bins[s, f], weights=w[s], minlength=width) for s, f in zip(spans, feature.tolist(), strict=True)])
            else:
                cells = np.bincount(key, weights=w, minlength=n * width)
            upto = cells.reshape(n, width).cumsum(axis=1).astype(np.int64)
            left += [upto >> bits * k & (1 << bits) - 1 for k in range(len(classes))]
        right = [counts[:, [c]] - left[c] for c in CLASSES]
        with np.errstate(invalid="ignore"):
            score = weights.near_impurity(left) + weights.near_impurity(right)
        scores.append(np.where(np.isnan(score), np.float32(-1), score))  # one side is empty
        lefts.append(left)
    score = np.stack(scores, axis=1)
    best = score.max(axis=(1, 2))
    of, turn, last = np.nonzero(score >= np.where(best > 0, best * NEAR, np.float32(np.inf))[:, None, None])
    left = np.stack([np.stack([one[c] for one in lefts], axis=1)[of, turn, last] for c in CLASSES], axis=1)
    return of, turn, last, left


def _sorted_cuts(
    bins: np.ndarray, start: np.ndarray, code: np.ndarray, chosen: np.ndarray, lengths: np.ndarray, counts: np.ndarray, width: int, weights: _Weights,
) -> tuple[np.ndarray, ...]:
    """The same from rows in order: numbers of node, bin and code are sorted, one turn after the other."""
    n, tried = chosen.shape
    value_bits, code_bits = (width - 1).bit_length(), int(code.max()).bit_length()
    number = np.uint32 if (n - 1).bit_length() + value_bits + code_bits <= 32 else np.uint64
    row = np.repeat(np.arange(n).astype(number) << number(value_bits + code_bits), lengths) | code.astype(number)
    first, flat, bits = np.cumsum(lengths) - lengths, bins.ravel(), 21
    packed = int(counts.sum(axis=0).max()) < 1 << bits
    if packed:
        whole = counts[:, 0] | counts[:, 1] << bits | counts[:, 2] << 2 * bits
        weight = np.arange(1 << code_bits) if code_bits <= 16 else None
        weight = None if weight is None else weight >> 2 << bits * (weight & 3) % 63
    found, best = [], np.zeros(n, np.float32)
    for turn in range(tried):
        key = flat.take(start + np.repeat(chosen[:, turn], lengths)).astype(number)
        key <<= number(code_bits)
        key |= row
        key.sort()
        code = key & number((1 << code_bits) - 1)
        key >>= number(code_bits)
        step = key[1:] ^ key[:-1]
        step -= number(1)  # the largest number, if there is no step
        at = np.flatnonzero(step < number((1 << value_bits) - 1))
        key = key[at].astype(np.int64)
        of = key >> value_bits
        if packed:
            upto = np.zeros(len(code) + 1, np.int64)
            np.cumsum(weight.take(code) if weight is not None else (code >> number(2)).astype(np.int64) << bits * (code & number(3)).astype(np.int64), out=upto[1:])
            run = upto[1:].take(at) - upto.take(first).take(of)
            rest = whole.take(of) - run
            left, right = ([x >> bits * c & (1 << bits) - 1 for c in CLASSES] for x in (run, rest))
        else:
            left = []
            for c in CLASSES:
                upto = np.concatenate([[0], np.cumsum(np.where(code & number(3) == c, code >> number(2), number(0)).astype(np.int64))])
                left.append(upto[1:].take(at) - upto.take(first).take(of))
            right = [counts[of, c] - left[c] for c in CLASSES]
        if len(at):
            score = weights.near_impurity(left) + weights.near_impurity(right)
            ahead = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best[of[ahead]] = np.maximum(best[of[ahead]], np.maximum.reduceat(score, ahead))
            found.append((turn, of, key, left, score))
    near, parts = best * NEAR, []
    for turn, of, key, left, score in found:
        hit = np.flatnonzero(score >= near.take(of))
        parts.append((of[hit], np.full(len(hit), turn), key[hit] & (1 << value_bits) - 1, np.stack([x[hit] for x in left], axis=1)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.reshape(0, 3)
    of, turn, last, left = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], turn[order], last[order], left[order]


_NODES = "iteration int, fold int, tree int, node bigint, feature int, bin int, class int, gain double, draws bigint"


def _small_nodes(active: DataFrame, features: int, settings: ForestSettings) -> DataFrame:
    reachable(active.sparkSession)
    tried, max_depth, seed = settings.tried(features), settings.max_depth, settings.seed

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        iteration, fold, tree, node = (k.as_py() for k in key)
        bins = table["bins"].combine_chunks()
        bins = (bins.chunk(0) if isinstance(bins, pa.ChunkedArray) else bins).flatten().to_numpy().reshape(-1, features)
        label, draws = table["label"].to_numpy().astype(np.int64), table["draws"].to_numpy()
        sizes = np.array([table[f"s{c}"][0].as_py() for c in CLASSES])
        made = grow_subtree(bins, label, draws, sizes, seed + 100 * iteration + fold, tree, node, tried, max_depth)
        leaf = made[1] < 0
        n = len(leaf)
        return pa.table({
            "iteration": np.full(n, iteration, np.int32), "fold": np.full(n, fold, np.int32), "tree": np.full(n, tree, np.int32),
            "node": made[0], "feature": pa.array(made[1].astype(np.int32), mask=leaf), "bin": pa.array(made[2].astype(np.int32), mask=leaf),
            "class": made[3].astype(np.int32), "gain": made[4], "draws": made[5],
        })

    return active.groupBy(*TREE, "node").applyInArrow(build, _NODES)


# --- forests --------------------------------------------------------------------------------


def grow(sample: DataFrame, features: int, settings: ForestSettings) -> DataFrame:
    """Nodes, with bins instead of thresholds, of all trees in ``sample``.

    ``sample``: iteration, fold, tree, label, draws, bins, s0, s1, s2.
    """
    active = settle(sample.withColumn("node", F.lit(1).cast("bigint")))
    made = []
    node = [*TREE, "node"]
    while True:
        large = active.groupBy(*node).count().where(F.col("count") > settings.subtree_rows).select(*node)
        large = settle(large)
        if not large.limit(1).count():
            made.append(_small_nodes(active, features, settings))
            break
        made.append(settle(_small_nodes(active.join(large, node, "left_anti"), features, settings)))
        active = active.join(large, node)
        level = settle(level_nodes(active, features, settings))
        made.append(level)
        active = settle(move_rows(active, level))
    nodes = made[0]
    for table in made[1:]:
        nodes = nodes.unionByName(table)
    return nodes


# --- whole trees, in batches ----------------------------------------------------------------


_PACKED = "iteration int, label int, chunk bigint, flags binary, held binary, bins binary, keys array<string>"
_TREES = """iteration int, fold int, tree int, node array<bigint>, feature array<int>, threshold array<double>,
  class array<int>, gain array<double>, draws array<bigint>"""
_FIRST, _BINNED = 1, 2  # flags of a packed row: the first one of a member, and whether it has bins


def _lists(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """All values of lists, one after the other."""
    return np.concatenate([c.flatten().to_numpy() for c in getattr(column, "chunks", [column])] or [np.zeros(0)])


def _packed(held: DataFrame, rows: DataFrame, key: str, label: str, models: Sequence[int], rows_at_most: int, features: int, settings: ForestSettings) -> DataFrame:
    """Held-out folds and bins of a class's rows in the order of their hashes, many in one row.

    Members without bins are kept, as they count in the numbering; members that share a key share its
    rows.  Plain forests draw by key instead and need no order.
    """
    reachable(held.sparkSession)
    plain, byte, fold = settings.plain, np.uint8 if settings.max_bins < 255 else np.int16, np.min_scalar_type(max(models) + 1)
    if plain:
        held = held.where(F.col(label).isNotNull())
        placed = held.withColumn("__place", F.lit(0).cast("bigint"))
        chunk = F.pmod(F.xxhash64(key), F.lit(-(-rows_at_most // PACKED_ROWS)))
    else:
        held = held.where(F.col(label).isin(*CLASSES))
        placed = hashed_row_number(held, [key], ["iteration", label], output="__place")
        chunk = F.floor((F.col("__place") - 1) / PACKED_ROWS)
    joined = placed.join(rows, key, "left").select(
        F.col("iteration").cast("int").alias("iteration"), F.col(label).cast("int").alias("label"), F.col("fold").cast("int").alias("held"),
        F.col("__place").alias("place"), "bins", (F.col(key) if plain else F.lit(None)).cast("string").alias("key"), chunk.alias("chunk"),
    )

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        order = np.argsort(place, kind="stable")
        table, place = table.take(pa.array(order)), place[order]
        first, there = np.concatenate([[True], place[1:] != place[:-1]]), pc.is_valid(table["bins"]).to_numpy()
        bins = _lists(table["bins"]).astype(byte)
        if len(bins) != there.sum() * features:
            raise ValueError("every row has a bin for each feature")
        return pa.table({
            **{name: pa.array([k.as_py()], kind) for name, k, kind in zip(("iteration", "label", "chunk"), key, (pa.int32(), pa.int32(), pa.int64()), strict=True)},
            "flags": pa.array([(first * _FIRST + there * _BINNED).astype(np.uint8).tobytes()], pa.binary()),
            "held": pa.array([table["held"].to_numpy().astype(fold).tobytes()], pa.binary()),
            "bins": pa.array([bins.tobytes()], pa.binary()),
            "keys": pa.array([table["key"].to_pylist() if plain else []], pa.list_(pa.string())),
        })

    return joined.groupBy("iteration", "label", "chunk").applyInArrow(pack, _PACKED)


def _whole_trees(
    held: DataFrame, members: DataFrame, rows: DataFrame, key: str, label: str, models: Sequence[int], edges: list[list[float]], rows_at_most: int, forests: int, settings: ForestSettings,
) -> DataFrame:
    """The nodes of every tree as arrays, each tree grown in one group on its own draws.

    A group gets the rows of a repeat once for a batch of trees of one model, and leaves out those that
    the model holds out; it draws what ``draw_samples`` draws.
    """
    spark, features = held.sparkSession, len(edges)
    packed = settle(_packed(held, rows, key, label, models, rows_at_most, features, settings))
    if settings.plain:
        sizes = members.groupBy(*MODEL, label).agg(F.count("*").alias("n")).withColumn("sample_size", F.col("n"))
    else:
        sizes = sample_sizes(members, label, settings.driver_rate, settings.other_ratio, by=tuple(MODEL))
    sizes = settle(sizes)
    plan = _of_class(sizes, label, "n", "n").join(_of_class(sizes, label, "sample_size", "s"), MODEL)
    plan = plan.select(*[F.col(c).cast("int").alias(c) for c in MODEL], *[f"{p}{c}" for p in "ns" for c in CLASSES])
    at_once = min(settings.trees, max(LEAST_TREES, -(-settings.trees * forests // GROUPS)))
    batch = F.explode(F.sequence(F.lit(0), F.lit(-(-settings.trees // at_once) - 1))).alias("batch")
    dealt = packed.join(F.broadcast(plan), "iteration").select("*", batch)
    tasks = min(forests * -(-settings.trees // at_once), rows_at_most * forests * settings.trees // ROWS_PER_TASK)
    if tasks > shuffle_width(spark):  # little data for a shuffle, much work for a task
        dealt = dealt.repartition(tasks * SPREAD, *MODEL, "batch")
    tried, settings_ = settings.tried(features), settings
    byte, fold_type = np.uint8 if settings.max_bins < 255 else np.int16, np.min_scalar_type(max(models) + 1)
    longest = max((len(e) for e in edges), default=0)
    thresholds = np.full((features, longest + 1), np.nan)
    for i, e in enumerate(edges):
        thresholds[i, : len(e)] = e
    known = np.array([len(e) for e in edges])

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iteration, fold, number = (k.as_py() for k in key)
        parts = pa.Table.from_batches(list(batches))
        order = np.lexsort((parts["chunk"].to_numpy(), parts["label"].to_numpy())).tolist()

        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(parts[name][i].as_buffer(), kind) for i in order])

        flags, bins = joined("flags", np.uint8), joined("bins", byte).reshape(-1, features)
        member = joined("held", fold_type) != fold
        label = np.repeat(parts["label"].to_numpy()[order].astype(np.int8), [len(parts["flags"][i].as_buffer()) for i in order])
        # members are numbered class after class; a row without bins is a number only
        place = np.cumsum((flags & _FIRST > 0) & member) - 1
        there = flags & _BINNED > 0
        used = np.flatnonzero(member & there)
        at, place, label = (np.cumsum(there) - 1)[used], place[used], label[used]
        keys = [k for i in order for k in parts["keys"][i].as_py()]
        keys = [keys[i] for i in used] if keys else []
        sizes = np.array([parts[f"s{c}"][0].as_py() for c in CLASSES])
        members_of = [parts[f"n{c}"][0].as_py() for c in CLASSES]
        del parts, flags, member, there, used
        seed = settings_.seed + 100 * iteration + fold
        for tree in range(number * at_once + 1, min(settings_.trees, (number + 1) * at_once) + 1):
            if settings_.plain:
                draws = np.searchsorted(POISSON, key_uniforms(seed, tree, keys), side="right")
            else:
                hits = [
                    np.bincount(drawn_ranks(str(seed), tree, c, 0, int(sizes[c]), members_of[c]), minlength=members_of[c]) if sizes[c] > 0 else np.zeros(members_of[c], np.int64)
                    for c in CLASSES
                ]
                draws = np.concatenate(hits).take(place)
            taken = np.flatnonzero(draws)
            if not len(taken):
                continue
            node, feature, cut, kind, gain, drawn = grow_subtree(
                bins.take(at[taken], axis=0), label[taken], draws[taken], sizes, seed, tree, 1, tried, settings_.max_depth
            )
            leaf = feature < 0
            above = np.minimum(cut, longest)
            arrays = {
                "node": pa.array(node), "feature": pa.array(feature.astype(np.int32), mask=leaf),
                "threshold": pa.array(thresholds[feature, above], mask=leaf | (cut >= known[feature])),
                "class": pa.array(kind.astype(np.int32)), "gain": pa.array(gain), "draws": pa.array(drawn),
            }
            yield pa.RecordBatch.from_pydict({
                "iteration": pa.array([iteration], pa.int32()), "fold": pa.array([fold], pa.int32()), "tree": pa.array([tree], pa.int32()),
                **{name: pa.ListArray.from_arrays(pa.array([0, len(node)], pa.int32()), x) for name, x in arrays.items()},
            })

    return dealt.groupBy(*MODEL, "batch").applyInArrow(build, _TREES)


_FIELDS = ("node", "feature", "threshold", "class", "gain", "draws")


def _as_arrays(nodes: DataFrame) -> DataFrame:
    """Nodes of a tree as arrays, in parts of a hash."""
    part = F.pmod(F.xxhash64("node"), F.lit(64)).alias("__part")
    fields = [c for c in _FIELDS if c in nodes.columns]
    held = nodes.groupBy(*TREE, part).agg(F.collect_list(F.struct(*fields)).alias("__n"))
    return held.select(*TREE, *[F.col("__n")[c].alias(c) for c in fields])


def _fit(df: DataFrame, held: DataFrame, models: Sequence[int], key: str, features: Sequence[str], path: str, settings: ForestSettings, label: str) -> None:
    """``held``: iteration, fold, key and label; a model of ``models`` has the rows of other folds, in every iteration."""
    spark = df.sparkSession
    edges = bin_edges(df, features, settings.max_bins)
    rows = binned(df, features, edges).select(key, "bins")
    others = F.array_remove(F.array(*[F.lit(m) for m in models]), F.col("fold"))
    members = held.select("iteration", F.explode(others).alias("fold"), key, label)
    sizes = members.groupBy(*MODEL).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    if (sizes[0] or 0) * len(features) <= WHOLE_BYTES:
        trees = _whole_trees(held, members, rows, key, label, models, edges, sizes[0] or 1, sizes[1], settings)
    else:
        # as a plan samples look small, and must not be broadcast
        sample = draw_samples(members, key, label, settings).join(rows.hint("shuffle_hash"), key)
        sample = sample.select(*[F.col(c).cast("int").alias(c) for c in TREE], F.col(label).cast("int").alias("label"), "draws", "bins", "s0", "s1", "s2")
        nodes = grow(sample, len(features), settings)
        # as many numbers as features times bins
        table = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], "feature int, edges array<double>")
        trees = _as_arrays(nodes.join(F.broadcast(table), "feature", "left").select(
            *TREE, "node", "feature", F.get("edges", F.col("bin")).alias("threshold"), "class", "gain", "draws"
        ))
    # a row may be a large tree, so sizes are looked at after each one
    trees.write.mode("overwrite").options(**{"parquet.page.size.row.check.min": 1, "parquet.block.size": TREE_BYTES}).parquet(os.path.join(path, "nodes"))


def train_forest(
    df: DataFrame, key: str, features: Sequence[str], path: str,
    settings: ForestSettings = ForestSettings(), label: str = "label",
) -> str:
    """Fit a forest on all rows and save its nodes below ``path``."""
    check_classes(df, label)
    held = df.select(F.lit(0).alias("iteration"), F.lit(1).alias("fold"), key, label)
    _fit(df, held, [0], key, features, path, settings, label)
    return path


def train_bank(
    df: DataFrame, key: str, features: Sequence[str], path: str,
    settings: ForestSettings = ForestSettings(), label: str = "label",
    folds: int = 10, repeats: int = 5,
) -> DataFrame:
    """Fit one forest per repeat and held-out fold, all at once, and return the fold table.

    The fold table is saved beside the nodes: scoring needs it to route known
    entities to a model that has not seen them.
    """
    check_classes(df, label)
    table = os.path.join(path, "folds")
    stratified_folds(df, key, label, folds, repeats, settings.seed).write.mode("overwrite").parquet(table)
    fold_table = df.sparkSession.read.parquet(table)
    _fit(df, fold_table, range(1, folds + 1), key, features, path, settings, label)
    return fold_table


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes as arrays, one row or a few per tree."""
    return spark.read.parquet(os.path.join(path, "nodes"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per node."""
    return read_trees(spark, path).select(*TREE, F.inline(F.arrays_zip(*_FIELDS)))


# --- votes ----------------------------------------------------------------------------------


_COMPACT = "iteration int, fold int, tree int, size bigint, depth int, node binary, feature binary, cut binary, cuts binary, class binary"


def _short(most: int) -> type:
    return np.uint16 if most < 65_535 else np.int64


def _children(node: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Where the left child of every node stands, its sibling behind it, in nodes by number; a leaf stands for itself."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, np.arange(len(inner)))


def _compact(trees: DataFrame) -> DataFrame:
    """Trees as bytes: by node, with places in a list of thresholds, and without numbers of nodes where a row is a whole tree."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {name: batch.column(name)[i].values for name in ("node", "feature", "threshold", "class")}
                node, feature = lists["node"].to_numpy(), lists["feature"].fill_null(-1).to_numpy().astype(np.int32)
                coded = lists["threshold"].fill_null(0.0).dictionary_encode()
                cut, class_ = coded.indices.to_numpy().astype(_short(len(coded.dictionary))), lists["class"].to_numpy().astype(np.int8)
                if (node[1:] < node[:-1]).any():
                    order = np.argsort(node)
                    node, feature, cut, class_ = node[order], feature[order], cut[order], class_[order]
                below = _children(node, feature)
                inner = feature >= 0
                left = below[inner]
                whole = len(node) and node[0] == 1 and len(node) == 2 * len(left) + 1 and np.array_equal(node[left], 2 * node[inner]) and np.array_equal(node[left + 1], 2 * node[inner] + 1)
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).slice(i, 1) for c in TREE}, "size": pa.array([len(node)], pa.int64()),
                    "depth": pa.array([int(node.max(initial=1)).bit_length() - 1], pa.int32()),
                    **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (
                        ("node", node[:0] if whole else node), ("feature", feature), ("cut", cut), ("cuts", coded.dictionary.to_numpy()), ("class", class_)
                    )},
                })

    return trees.select(*TREE, "node", "feature", "threshold", "class").mapInArrow(pack, _COMPACT)


def _merged(parts: list[dict], cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Feature, cut as a place in ``cuts``, class and left child of a tree's nodes by number, from its rows."""
    found = []
    for part in parts:
        own = np.frombuffer(part["cuts"], np.float64)
        place = np.searchsorted(cuts, own)
        cut = place[np.frombuffer(part["cut"], _short(len(own)))]
        found.append((np.frombuffer(part["node"], np.int64), np.frombuffer(part["feature"], np.int32), cut, np.frombuffer(part["class"], np.int8)))
    node, feature, cut, class_ = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(node):
        order = np.argsort(node)
        node, feature, cut, class_ = (x[order] for x in (node, feature, cut, class_))
    leaf = feature < 0
    return np.where(leaf, 0, feature), np.where(leaf, len(cuts), cut).astype(_short(len(cuts))), class_, _children(node, feature)


def route(ranks: np.ndarray, feature: np.ndarray, cut: np.ndarray, class_: np.ndarray, child: np.ndarray, depth: int, votes: np.ndarray) -> None:
    """Add a tree's vote for every row to ``votes``; ``ranks``: how many thresholds are not above each value.

    Some rows at a time stand at the root at first and move down a level at a time; at a leaf they stay.
    """
    features, flat = ranks.shape[1], ranks.ravel()
    for a in range(0, len(ranks), ROUTED_AT_ONCE):
        row = np.arange(a, min(a + ROUTED_AT_ONCE, len(ranks)))
        at, live, start = np.zeros(len(row), np.int64), np.arange(len(row)), row * features
        leaf = np.zeros(len(row), np.int64)
        for level in range(1, depth + 1):
            right = flat.take(start + feature.take(at)) > cut.take(at)
            at = child.take(at)
            at += right
            if level % 4 == 0:
                moving = child.take(at) > at
                if moving.sum() < 0.8 * len(at):
                    leaf[live] = at
                    live, at, start = live[moving], at[moving], start[moving]
        leaf[live] = at
        votes[row, class_.take(leaf)] += 1


def score_models(df: DataFrame, features: Sequence[str], nodes: DataFrame, rows_per_part: int = ROUTED_ROWS) -> DataFrame:
    """``df`` with the share of votes for each driver class.

    ``df`` has iteration and fold of the model that judges each row; ``nodes`` has a row per node
    or is the table of ``read_trees``.  A part of a model's rows meets a batch of the model's trees
    in one group, and votes are added up over batches.  Neither rows nor trees pass through the
    driver; a model's rows are spread by a hash over as many parts as they need, and its trees over as
    many batches as their nodes and steps need.
    """
    spark = df.sparkSession
    reachable(spark)
    columns = df.columns
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    whole = F.struct(*[F.col(c).alias(c) for c in columns])
    rows = settle(df.select(
        F.col("iteration").cast("int").alias("i"), F.col("fold").cast("int").alias("j"), whole.alias("row"),
        values.alias("values"), F.monotonically_increasing_id().alias("id"),
    ))
    trees = nodes if isinstance(nodes.schema["node"].dataType, ArrayType) else settle(_as_arrays(nodes))
    trees = settle(_compact(trees)).withColumnsRenamed({"iteration": "i", "fold": "j"})
    sizes = rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / rows_per_part).cast("int"))
    models = trees.groupBy("i", "j").agg(F.sum("size").alias("nodes"), F.max("tree").alias("trees"))
    needed = F.greatest(F.col("nodes") / ROUTED_NODES, F.col("n") / F.col("parts") * F.col("trees") / ROUTED_STEPS)
    meets = settle(sizes.join(models, ["i", "j"]).select("i", "j", "parts", F.least(F.ceil(needed), F.col("trees")).cast("int").alias("batches")))
    batch = F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch")
    asked = rows.join(F.broadcast(meets), ["i", "j"]).select(
        "i", "j", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), batch, "id", "values"
    )
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    models = trees.join(F.broadcast(meets), ["i", "j"]).select(
        "i", "j", part, F.pmod("tree", "batches").cast("int").alias("batch"), "tree", "depth", "node", "feature", "cut", "cuts", "class"
    )

    def vote(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), **{f"v{c}": pa.array([], pa.int64()) for c in CLASSES}})
        ids, matrix = left["id"], _lists(left["values"]).reshape(len(left), -1)
        cuts = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in right["cuts"]]))
        ranks = np.empty(matrix.shape, _short(len(cuts)))
        for f in range(matrix.shape[1]):  # missing values stand behind all thresholds
            ranks[:, f] = np.searchsorted(cuts, matrix[:, f], side="right")
        del left, matrix
        votes = np.zeros((len(ranks), len(CLASSES)), dtype=np.int64)
        rows_of: dict[int, list[int]] = {}
        for i, tree in enumerate(right["tree"].to_pylist()):
            rows_of.setdefault(tree, []).append(i)
        for at in rows_of.values():
            parts = [{name: right[name][i].as_buffer() for name in ("node", "feature", "cut", "cuts", "class")} for i in at]
            route(ranks, *_merged(parts, cuts), max(right["depth"][i].as_py() for i in at), votes)
        return pa.table({"id": ids, **{f"v{c}": votes[:, c] for c in CLASSES}})

    schema = "id bigint, " + ", ".join(f"v{c} bigint" for c in CLASSES)
    keys = ("i", "j", "part", "batch")
    cast = asked.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInArrow(vote, schema)
    cast = cast.groupBy("id").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in CLASSES])
    total = F.greatest(F.col("v0") + F.col("v1") + F.col("v2"), F.lit(1))
    return rows.join(cast, "id", "left").select(
        *[F.col("row")[c].alias(c) for c in columns],
        F.coalesce(F.col(f"v{fv.ONCOGENE}") / total, F.lit(0.0)).alias("oncogene_score"),
        F.coalesce(F.col(f"v{fv.TSG}") / total, F.lit(0.0)).alias("tsg_score"),
    )


def score_forest(df: DataFrame, features: Sequence[str], path: str) -> DataFrame:
    """Add ``oncogene_score`` and ``tsg_score``: the share of trees voting for each class.

    A tree votes for the class of the leaf that the row falls in.
    """
    placed = df.withColumns({"iteration": F.lit(0), "fold": F.lit(0)})
    return score_models(placed, features, read_trees(df.sparkSession, path)).drop(*MODEL)


def score_bank(
    df: DataFrame, key: str, features: Sequence[str], path: str, repeats: int = 5, average: bool = True,
) -> DataFrame:
    """Scores from a bank: known entities by the model that held them out, new ones by fold 1.

    Averaged over repeats; with ``average=False`` one row per entity and repeat.
    """
    spark = df.sparkSession
    fold_table = spark.read.parquet(os.path.join(path, "folds"))
    routed = route_to_fold(df.select(key, *features), key, fold_table, repeats)
    scored = score_models(routed, features, read_trees(spark, path)).select(key, "iteration", "oncogene_score", "tsg_score")
    if not average:
        return scored
    return scored.groupBy(key).agg(
        F.avg("oncogene_score").alias("oncogene_score"), F.avg("tsg_score").alias("tsg_score")
    )


# --- importance -----------------------------------------------------------------------------


def importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``iteration, fold, feature, importance``: the mean over trees of the impurity that splits take away."""
    trees = nodes.groupBy(*MODEL).agg(F.count(F.when(F.col("node") == 1, 1)).alias("trees"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "at int, feature string")
    taken = nodes.where("feature IS NOT NULL").groupBy(*MODEL, F.col("feature").alias("at")).agg(F.sum("gain").alias("gain"))
    every = trees.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    return every.join(taken, [*MODEL, "at"], "left").join(names, "at").select(
        *MODEL, "feature", (F.coalesce("gain", F.lit(0.0)) / F.col("trees")).alias("importance")
    )


def importance_summary(rounds: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each feature's importance over rounds."""
    return rounds.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"),
        F.stddev_samp("importance").alias("std_importance"),
    )
