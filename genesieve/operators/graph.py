"""Degree and betweenness of an undirected simple graph given as an edge list."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable, settle
from .ordered import PART_ROWS


def simple_edges(df: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct undirected edges ``(a, b)`` with a <= b; rows with a null end go."""
    return (
        df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
        .select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
        .distinct()
    )


def node_degree(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


PAIRS_PER_BATCH = 50_000_000  # pairs of source and node that one batch may reach
WHOLE_CORE = 1_000  # a core of at most so many nodes is not worth taking apart
HUB_LINKS = (32, 4)  # nodes of more links are left out, in turn, to see what pieces the core falls into
PIECE_STEPS = 2_000_000  # nodes times links of a piece that one task may search
PILE_LINKS = 200_000  # links of the pieces that go to a task together


def node_betweenness(
    edges: DataFrame, batches: int | None = None, whole_core: int = WHOLE_CORE, piece_steps: int = PIECE_STEPS
) -> DataFrame:
    """Exact normalised betweenness ``(node, betweenness)``.

    Pendant trees are folded into the nodes they hang from, round by round.  From a core of
    more than ``whole_core`` nodes, small pieces that hang from one node are folded likewise;
    a piece of at most ``piece_steps`` nodes times links is searched by one task, which gets a
    pile of them.  What is left of a large core is taken apart into its biconnected blocks, and
    only inside a block is anything searched: a node of a block stands for all nodes that hang
    from it outside the block.  What passes through a node between its blocks and what was
    folded into it follows from their sizes alone.  A smaller core is searched by connected
    components, which gives the same numbers.

    In a block all sources of a batch search breadth-first together, one join with the
    adjacency per level, carrying the number of shortest paths; dependencies, weighted by the
    nodes that a target stands for, are accumulated from the deepest level back.  In an
    undirected graph the neighbours of a level lie in it, the one before or the one after, so
    two levels are enough to recognise visited nodes.  Every level is written.  A batch reaches
    at most ``PAIRS_PER_BATCH`` pairs; by default there are as many batches as that asks for.
    """
    edges = settle(edges)
    names = settle(edges.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    # a few bits of a hash in front of the row's number: no order of the names is kept
    names = settle(names.select(
        "name", (F.shiftleft(F.pmod(F.xxhash64("name"), F.lit(4096)), 51) + F.monotonically_increasing_id()).alias("node")
    ))
    numbered = (
        edges.filter(F.col("a") != F.col("b")).join(names.select(F.col("name").alias("a"), F.col("node").alias("first")), "a")
        .join(names.select(F.col("name").alias("b"), F.col("node").alias("second")), "b")
    )
    adjacency = settle(numbered.select(F.explode(F.array(
        F.struct(F.col("first").alias("node"), F.col("second").alias("next")),
        F.struct(F.col("second").alias("node"), F.col("first").alias("next")),
    )).alias("link")).select("link.node", "link.next"))
    n = names.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    core, adjacency, folded = _fold_pendants(_unfolded(names), adjacency)
    for links in HUB_LINKS:
        if core.count() <= whole_core:
            break
        core, adjacency, pieces = _fold_pieces(core, adjacency, links, piece_steps)
        if pieces:
            core, adjacency, more = _fold_pendants(core, adjacency)
            folded += [pieces, *more]
    members, links = (_connected_parts if core.count() <= whole_core else _blocks)(core, adjacency)
    # nothing lies between two nodes of a block without others
    wide = members.groupBy("block").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 2")
    pairs = wide.agg(F.sum(F.col("nodes") * F.col("nodes"))).first()[0] or 0
    batches = (batches or -(-pairs // PAIRS_PER_BATCH)) if pairs else 0
    place = F.struct("block", "node").alias("node")
    searched = settle(members.join(wide.select("block"), "block").select(place, "weight"))
    near = settle(links.select(place, F.struct("block", F.col("next").alias("node")).alias("next")).join(
        searched.select(F.col("node").alias("next"), F.col("weight").alias("next_weight")), "next"
    ))
    through = core.select("node", F.lit(0.0).alias("delta"))
    for batch in range(batches):
        sources = searched.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == batch)
        deltas = _dependencies(sources, near).select(F.col("node.node").alias("node"), "delta")
        through = settle(through.unionByName(deltas).groupBy("node").agg(F.sum("delta").alias("delta")))
    outside = members.groupBy("node").agg(
        F.sum(_square(F.col("total") - F.col("weight"))).alias("outside"), F.max("total").alias("total")
    )
    known = settle(core.join(through, "node").join(outside, "node", "left").select(
        "node", "weight", "squares", "delta", F.coalesce("outside", F.lit(0.0)).alias("outside"),
        F.coalesce("total", "weight").alias("total"),
    ))
    # what was folded last hangs from nodes that are known; a subtree's component is its parent's
    for fold in reversed(folded):
        if isinstance(fold, Pieces):
            known = _unfold_pieces(known, fold)
            continue
        parents = known.select(F.col("node").alias("parent"), "total")
        below = fold.join(parents, "parent").select(
            "node", "weight", "squares", F.lit(0.0).alias("delta"),
            _square(F.col("total") - F.col("weight")).alias("outside"), "total",
        )
        known = settle(known.unionByName(below))
    between = _square(F.col("total") - 1) - F.col("squares") - F.col("outside")
    return known.join(names, "node").select(F.col("name").alias("node"), ((F.col("delta") + between) * scale).alias("betweenness"))


def _square(x):
    return x.cast("double") * x.cast("double")


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of undirected ``(a, b)``: the least node that can be reached.

    Every node takes the name of its least neighbour's least neighbour, or of a node in between
    that is itself less than its neighbours.  What has got one name is one node for the next
    round, until no link is left; every round has a fraction of the links of the one before,
    unless nodes are numbered along paths.
    """
    links = settle(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not links.isEmpty():
        both = links.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next"))
        )).alias("link")).select("link.node", "link.next")
        least = settle(both.groupBy("node").agg(F.min("next").alias("least")).select("node", F.least("node", "least").alias("least")))
        named = settle(least.join(least.select(F.col("node").alias("least"), F.col("least").alias("name")), "least").select("node", "name"))
        rounds.append(named)
        for end in ("a", "b"):
            links = links.join(named.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("name", end)
        links = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for named in reversed(rounds):
        later = found.withColumnRenamed("node", "name")
        found = settle(named.join(later, "name", "left").select("node", F.coalesce("component", "name").alias("component")))
    return found


def _connected_parts(core: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connected components in the form of ``_blocks``."""
    part = components(adjacency.select(F.col("node").alias("a"), F.col("next").alias("b"))).withColumnRenamed("component", "block")
    own = settle(part.join(core.select("node", "weight"), "node"))
    totals = own.groupBy("block").agg(F.sum("weight").alias("total"))
    return settle(own.join(totals, "block")), adjacency.join(part, "node")


def _blocks(core: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Biconnected blocks: ``(block, node, weight, total)`` and both directions of their edges
    ``(block, node, next)``.

    ``weight`` counts the nodes that hang from a node outside the block, itself included,
    ``total`` the nodes of its component.

    Each edge of a breadth-first forest is named by its lower node.  Two of them lie in one
    block if an edge outside the forest joins their lower nodes, or if one follows the other
    and such an edge leads from below both to beyond the upper one; nodes are numbered in
    preorder, so beyond means outside an interval.  Blocks are the components of that relation.
    """
    roots = components(adjacency.select(F.col("node").alias("a"), F.col("next").alias("b"))).filter("node = component")
    none = F.lit(None).cast(adjacency.schema["node"].dataType)
    levels = [settle(roots.select("node", none.alias("parent"), F.col("node").alias("root")))]
    while True:
        found = levels[-1].select("node", "root").join(adjacency, "node").groupBy(F.col("next").alias("name")).agg(
            F.min("node").alias("parent"), F.min("root").alias("root")
        ).withColumnRenamed("name", "node")
        for level in levels[-2:]:
            found = found.join(level.select("node"), "node", "left_anti")
        found = settle(found)
        if found.isEmpty():
            break
        levels.append(found)

    # from the deepest level up: nodes of a subtree, and what they stand for
    sized: list[DataFrame] = []
    for level in reversed(levels):
        rows = level.join(core.select("node", "weight"), "node").select(
            *level.columns, F.lit(1).cast("bigint").alias("size"), F.col("weight").alias("heavy")
        )
        if sized:
            below = sized[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"), F.sum("heavy").alias("more_heavy"))
            rows = rows.join(below, "node", "left").select(
                *level.columns, (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
                (F.col("heavy") + F.coalesce("more_heavy", F.lit(0))).alias("heavy"),
            )
        sized.append(settle(rows))
    sized.reverse()

    # from the roots down: preorder numbers; the children of a hub are summed in parts
    tree = _stacked(sized)
    children = tree.filter("parent IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(tree.count() // PART_ROWS + 1)))
    inside = Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_part = children.groupBy("parent", "part").agg(F.sum("size").alias("own")).select(
        "parent", "part", (F.sum("own").over(ahead) - F.col("own")).alias("ahead")
    )
    shifts = settle(children.withColumn("upto", F.sum("size").over(inside)).join(of_part, ["parent", "part"]).select(
        "node", (F.col("ahead") + F.col("upto") - F.col("size") + 1).alias("shift")
    ))
    nothing = F.lit(None).cast("bigint")
    placed = [settle(sized[0].select("*", F.lit(0).cast("bigint").alias("at"), nothing.alias("above"), nothing.alias("above_end")))]
    for level in sized[1:]:
        parents = placed[-1].select(F.col("node").alias("parent"), F.col("at").alias("above"), (F.col("at") + F.col("size")).alias("above_end"))
        placed.append(settle(level.join(shifts, "node").join(parents, "parent").select(
            *level.columns, (F.col("above") + F.col("shift")).alias("at"), "above", "above_end"
        )))

    up = tree.select("node", "parent")
    rising = up.select(F.col("node").alias("next"), F.col("parent").alias("next_parent"))
    sides = settle(adjacency.join(up, "node").join(rising, "next").select(
        "node", "next", F.coalesce(F.col("parent") == F.col("next"), F.lit(False)).alias("rises"),
        F.coalesce(F.col("next_parent") == F.col("node"), F.lit(False)).alias("falls"),
    ))
    across = sides.filter("NOT rises AND NOT falls").select("node", "next")
    spots = _stacked(placed).select(F.col("node").alias("next"), "at")
    reach = settle(across.join(spots, "next").groupBy("node").agg(F.min("at").alias("low"), F.max("at").alias("high")))
    ranges: list[DataFrame] = []
    for level in reversed(placed):
        rows = level.join(reach, "node", "left").select(
            "node", "parent", "at", "above", "above_end", F.least("at", "low").alias("low"), F.greatest("at", "high").alias("high")
        )
        if ranges:
            below = ranges[-1].groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("lower"), F.max("high").alias("higher"))
            rows = rows.join(below, "node", "left").select(
                "node", "parent", "at", "above", "above_end",
                F.least("low", "lower").alias("low"), F.greatest("high", "higher").alias("high"),
            )
        ranges.append(settle(rows))
    # nothing lies beyond a root
    follows = _stacked(ranges).filter("low < above OR high >= above_end").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    same = components(across.select(F.col("node").alias("a"), F.col("next").alias("b")).unionByName(follows))

    lower = settle(tree.filter("parent IS NOT NULL").join(same, "node", "left").select(
        "node", "parent", "root", "heavy", F.coalesce("component", "node").alias("block")
    ))
    below = lower.groupBy("block", F.col("parent").alias("name")).agg(
        F.sum("heavy").alias("below"), F.min("root").alias("top_root")
    ).withColumnRenamed("name", "node")
    totals = sized[0].select("root", F.col("heavy").alias("total"))
    members = lower.select("block", "node", "heavy", "root").join(below, ["block", "node"], "full").select(
        "block", "node", "heavy", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("root", "top_root").alias("root")
    ).join(totals, "root")
    members = settle(members.select("block", "node", (F.coalesce("heavy", "total") - F.col("below")).alias("weight"), "total"))
    mine = lower.select("node", F.col("block").alias("mine"))
    theirs = lower.select(F.col("node").alias("next"), F.col("block").alias("theirs"))
    links = sides.join(mine, "node", "left").join(theirs, "next", "left").select(
        F.when(F.col("falls"), F.col("theirs")).otherwise(F.col("mine")).alias("block"), "node", "next"
    )
    return members, links


def _stacked(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _unfolded(names: DataFrame) -> DataFrame:
    """Nodes that stand for themselves alone."""
    return settle(names.select("node", F.lit(1).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("squares")))


def _fold_pendants(core: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The core ``(node, weight, squares)``, its adjacency, and what each round folded.

    ``weight`` counts the nodes that a node stands for, itself included, ``squares`` sums the
    squared weights of what was folded into it.  Of two nodes that only have each other the
    lesser one stays.  There are as many rounds as the deepest tree has levels.
    """
    folded = []
    while True:
        single = settle(
            adjacency.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("next").alias("parent"))
            .filter("c = 1").select("node", "parent")
        )
        mutual = single.select(F.col("node").alias("parent"), F.lit(True).alias("mutual"))
        leaves = single.join(mutual, "parent", "left").filter(F.col("mutual").isNull() | (F.col("node") > F.col("parent")))
        leaves = settle(leaves.select("node", "parent").join(core, "node"))
        if leaves.isEmpty():
            return core, adjacency, folded
        folded.append(leaves)
        gained = leaves.groupBy(F.col("parent").alias("node")).agg(
            F.sum("weight").alias("more"), F.sum(F.col("weight") * F.col("weight")).alias("more_squares")
        )
        gone = leaves.select("node")
        core = _without(core, gone, gained)
        adjacency = settle(
            adjacency.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "next"), "next", "left_anti")
            .select("node", "next")
        )


def _without(core: DataFrame, gone: DataFrame, gained: DataFrame) -> DataFrame:
    return settle(core.join(gone, "node", "left_anti").join(gained, "node", "left").select(
        "node", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"),
        (F.col("squares") + F.coalesce("more_squares", F.lit(0))).alias("squares"),
    ))


@dataclass
class Pieces:
    """What one call of ``_fold_pieces`` took from the core.

    ``nodes``: piece, node, weight, squares.  ``links``: piece, node, weight, next; links back
    from the node that a piece hangs from are left out.  ``sizes``: piece, parent, heavy (the
    nodes that the whole piece stands for); a piece that is a component has no parent.
    """

    nodes: DataFrame
    links: DataFrame
    sizes: DataFrame


def _fold_pieces(core: DataFrame, adjacency: DataFrame, hub_links: int, steps: int) -> tuple[DataFrame, DataFrame, Pieces | None]:
    """Core and adjacency without the small pieces that hang from one node, and these pieces.

    Pieces are the components without the nodes of more than ``hub_links`` links.  Nothing but
    its one hub joins such a piece to other nodes, so it is folded like a leaf.  Pieces between
    several hubs, or too large for one task, stay.
    """
    hubs = settle(adjacency.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hub_links).select("node"))
    next_hubs = hubs.withColumnRenamed("node", "next")
    inner = adjacency.filter("node < next").join(hubs, "node", "left_anti").join(next_hubs, "next", "left_anti")
    part = components(inner.select(F.col("node").alias("a"), F.col("next").alias("b"))).withColumnRenamed("component", "piece")
    nodes = settle(part.join(core, "node").select("piece", "node", "weight", "squares"))
    links = settle(
        adjacency.join(nodes.select("node", "piece", "weight"), "node")
        .join(next_hubs.withColumn("hub", F.col("next")), "next", "left").select("piece", "node", "weight", "next", "hub")
    )
    hanging = links.groupBy("piece").agg(F.count(F.lit(1)).alias("links"), F.min("hub").alias("parent"), F.max("hub").alias("other"))
    sizes = nodes.groupBy("piece").agg(F.count(F.lit(1)).alias("nodes"), F.sum("weight").alias("heavy")).join(hanging, "piece")
    sizes = settle(
        sizes.filter(F.col("parent").eqNullSafe(F.col("other")) & (F.col("nodes") * F.col("links") <= steps)).select("piece", "parent", "heavy")
    )
    if sizes.isEmpty():
        return core, adjacency, None
    found = Pieces(
        settle(nodes.join(sizes.select("piece"), "piece")),
        settle(links.select("piece", "node", "weight", "next").join(sizes.select("piece"), "piece")), sizes,
    )
    gained = sizes.groupBy(F.col("parent").alias("node")).agg(
        F.sum("heavy").alias("more"), F.sum(F.col("heavy") * F.col("heavy")).alias("more_squares")
    )
    gone = found.nodes.select("node")
    core = _without(core, gone, gained)
    kept = adjacency.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "next"), "next", "left_anti")
    return core, settle(kept.select("node", "next")), found


def _unfold_pieces(known: DataFrame, pieces: Pieces) -> DataFrame:
    """``known`` with the nodes of the pieces, and what the pieces add to the nodes they hang from."""
    parents = known.select(F.col("node").alias("parent"), "total")
    sizes = settle(pieces.sizes.join(parents, "parent", "left").select(
        "piece", (F.coalesce("total", "heavy") - F.col("heavy")).alias("rest"), F.coalesce("total", "heavy").alias("total")
    ))
    piles = F.pmod(F.xxhash64("piece"), F.lit(pieces.links.count() // PILE_LINKS + 1))
    searched = pieces.links.join(sizes.select("piece", "rest"), "piece").withColumn("pile", piles)
    reachable(known.sparkSession)
    deltas = searched.groupBy("pile").applyInArrow(_search_pile, "node bigint, delta double")
    deltas = settle(deltas.groupBy("node").agg(F.sum("delta").alias("more")))
    below = pieces.nodes.join(sizes.select("piece", "total"), "piece").select(
        "node", "weight", "squares", F.lit(0.0).alias("delta"), _square(F.col("total") - F.col("weight")).alias("outside"), "total"
    )
    return settle(known.unionByName(below).join(deltas, "node", "left").select(
        "node", "weight", "squares", (F.col("delta") + F.coalesce("more", F.lit(0.0))).alias("delta"), "outside", "total"
    ))


def _search_pile(table: pa.Table) -> pa.Table:
    """``(node, delta)`` of the pieces of a pile, a few of them at a time."""
    piece, node, weight, next_, rest = (table[c].to_numpy() for c in ("piece", "node", "weight", "next", "rest"))
    order = np.argsort(piece, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0])
    ends = np.r_[starts[1:], len(order)]
    # a piece has no more nodes than links
    steps = np.cumsum((ends - starts).astype(float) ** 2) // PIECE_STEPS
    cuts = np.flatnonzero(np.r_[True, np.diff(steps) != 0, True])
    made = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[starts[i] : ends[j - 1]]
        made.append(_search_pieces(piece[rows], node[rows], weight[rows], next_[rows], rest[rows]))
    return pa.table({"node": np.concatenate([m[0] for m in made]), "delta": np.concatenate([m[1] for m in made])})


def _search_pieces(piece: np.ndarray, node: np.ndarray, weight: np.ndarray, next_: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted dependencies of the nodes of some pieces, and of the nodes they hang from.

    Rows are links, by piece.  All sources of all pieces search together, as in
    ``_dependencies``; the node that a piece hangs from stands for ``rest`` nodes.
    """
    _, piece = np.unique(piece, return_inverse=True)
    # places: the nodes of each piece in turn, the one it hangs from among them
    ends = np.stack([np.r_[piece, piece], np.r_[node, next_]])
    order = np.lexsort(ends[::-1])
    new = np.r_[True, (np.diff(ends[:, order]) != 0).any(axis=0)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    of, name = ends[:, order[new]]
    tail, head = place[: len(piece)], place[len(piece) :]
    heavy = np.full(len(name), -1.0)
    heavy[tail] = weight
    hub = heavy < 0
    back = hub[head]
    heavy[head[back]] = rest[back]
    tail, head = np.r_[tail, head[back]], np.r_[head, tail[back]]
    by = np.argsort(tail, kind="stable")
    tail, head = tail[by], head[by]
    degree = np.bincount(tail, minlength=len(name))
    first_link = np.cumsum(degree) - degree

    size = np.bincount(of)
    first = np.cumsum(size) - size
    own = size[of]
    source = np.repeat(np.arange(len(name)), own)  # of each pair of places in one piece
    row = np.cumsum(own) - own
    target = np.arange(len(source)) - row[source] + first[of[source]]
    at = row - first[of]  # the pair of a source and a place is at[source] + place
    paths, depth = np.zeros(len(source)), np.full(len(source), -1)
    here = at + np.arange(len(name))
    paths[here], depth[here] = 1.0, 0
    levels = []
    while len(here):
        counts = degree[target[here]]
        before = np.repeat(here, counts)
        link = np.arange(len(before)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_link[target[here]], counts)
        after = at[source[before]] + head[link]
        fresh = depth[after] < 0
        before, after = before[fresh], after[fresh]
        np.add.at(paths, after, paths[before])
        depth[after] = len(levels) + 1
        levels.append((before, after))
        here = np.unique(after)
    delta = np.zeros(len(source))
    for before, after in reversed(levels):
        np.add.at(delta, before, paths[before] * (heavy[target[after]] + delta[after]) / paths[after])
    delta[source == target] = 0.0
    return name, np.bincount(target, heavy[source] * delta, len(name))


def _dependencies(sources: DataFrame, near: DataFrame) -> DataFrame:
    """Weighted dependencies ``(node, delta)`` of the given sources, stacked over levels.

    ``near``: node, next, next_weight.
    """
    key = ["source", "source_weight"]
    start = settle(sources.select(
        F.col("node").alias("source"), F.col("weight").alias("source_weight"), "node", "weight", F.lit(1.0).alias("paths")
    ))
    levels = [start]
    while True:
        reached = (
            levels[-1].drop("weight").join(near, "node")
            .groupBy(*key, F.col("next").alias("node"), F.col("next_weight").alias("weight"))
            .agg(F.sum("paths").alias("paths"))
        )
        for level in levels[-2:]:
            reached = reached.join(level.select("source", "node"), ["source", "node"], "left_anti")
        reached = settle(reached.select(*key, "node", "weight", "paths"))
        if reached.isEmpty():
            break
        levels.append(reached)

    # The deepest level depends on nothing, and sources do not count for themselves.
    stacked = sources.select("node", F.lit(0.0).alias("delta"))
    deeper = levels[-1].withColumn("delta", F.lit(0.0))
    for level in reversed(levels[1:-1]):
        deeper = settle(_step_back(level, deeper, near))
        stacked = stacked.unionByName(deeper.select("node", (F.col("source_weight") * F.col("delta")).alias("delta")))
    return stacked


def _step_back(level: DataFrame, deeper: DataFrame, near: DataFrame) -> DataFrame:
    """Dependencies of one level from those of the level behind it."""
    behind = deeper.select(
        "source", "node", ((F.col("weight") + F.col("delta")) / F.col("paths")).alias("share")
    )
    shares = (
        behind.join(near.select("node", "next"), "node")
        .groupBy("source", F.col("next").alias("node"))
        .agg(F.sum("share").alias("share"))
    )
    return (
        level.join(shares, ["source", "node"], "left")
        .withColumn("delta", F.col("paths") * F.coalesce("share", F.lit(0.0)))
        .select("source", "source_weight", "node", "weight", "paths", "delta")
    )
