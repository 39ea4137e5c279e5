"""SQL that grows the forests again, from the matrix to votes, for the queries to be checked against.

Trees grow in one recursive query: every step holds the rows of a level, and the next level's
rows carry the split that moved them.  Counts are whole numbers and ties have an order, so the
nodes have to agree one by one.
"""

from __future__ import annotations

import math

from ..operators.forest import BETTER, CLASSES, ForestSettings

_LOW = (1 << 32) - 1
_ID = "iteration, fold, tree"


def _mix(name: str, start: str) -> str:
    """Columns that mix ``start`` into ``name``, step by step."""
    steps, x = [f"({start}) & {_LOW} AS {name}_0"], f"{name}_0"
    for k in (1, 2):
        steps.append(f"(xor({x}, {x} >> 16) * 73244475) & {_LOW} AS {name}_{k}")
        x = f"{name}_{k}"
    return ", ".join([*steps, f"xor({x}, {x} >> 16) AS {name}"])


def _score(side: str) -> str:
    """Squared class weights over their sum, of the counts ``{side}0`` and so on."""
    w = [f"(CASE WHEN s{c} > 0 THEN {side}{c}::DOUBLE / s{c}::DOUBLE ELSE 0 END)" for c in CLASSES]
    return f"(({' + '.join(f'{x} * {x}' for x in w)}) / ({' + '.join(w)}))"


def training(matrix: str, features: list[str], members: str, settings: ForestSettings) -> str:
    """CTEs up to ``nodes``: iteration, fold, tree, node, feature, threshold, class, gain, draws.

    ``matrix`` selects gene, label and the features; ``members`` selects iteration, fold, gene
    and label of every training row.
    """
    bins = settings.max_bins
    at = ", ".join(f"{i / bins}::DOUBLE" for i in range(1, bins))
    f, m = len(features), settings.tried(len(features))
    if settings.plain:
        bound, share, steps = 0.0, math.exp(-1.0), ""
        for term in range(12):
            bound += share
            steps += f" WHEN u < {bound!r}::DOUBLE THEN {term}"
            share /= term + 1
        drawn = f"""
  sizes AS (SELECT iteration, fold, label, count(*) AS n, count(*) AS s FROM members GROUP BY ALL),
  drawn AS (SELECT {_ID}, gene, label, CASE{steps} ELSE 12 END AS draws FROM (
    SELECT *, ('0x' || substr(md5(concat_ws('|', {settings.seed} + 100 * iteration + fold, tree, gene)), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
    FROM members, range(1, {settings.trees + 1}) t(tree)) z),
  sample AS MATERIALIZED (SELECT {_ID}, label, draws, bins FROM drawn JOIN binned USING (gene) WHERE draws > 0),"""
    else:
        rate, ratio = f"{settings.driver_rate}::DOUBLE", f"{settings.other_ratio}::DOUBLE"
        drawn = f"""
  ranked AS (SELECT *, row_number() OVER (PARTITION BY iteration, fold, label ORDER BY md5(gene), gene) AS rank FROM members),
  counted AS (SELECT iteration, fold, label, count(*) AS n FROM members GROUP BY ALL),
  sizes AS (SELECT *, CAST(CASE WHEN label = 0
      THEN floor({ratio} * sum(CASE WHEN label <> 0 THEN n * {rate} ELSE 0 END) OVER (PARTITION BY iteration, fold))
      ELSE floor(n * {rate}) END AS BIGINT) AS s FROM counted),
  tossed AS (SELECT iteration, fold, label, n, tree, unnest(range(0, s)) AS draw FROM sizes, range(1, {settings.trees + 1}) t(tree)),
  drawn AS (SELECT {_ID}, label, CAST(floor(('0x' || substr(md5(concat_ws('|', {settings.seed} + 100 * iteration + fold, tree, label, draw)), 1, 8))::BIGINT
      / 4294967296::DOUBLE * n) AS BIGINT) + 1 AS rank, count(*) AS draws FROM tossed GROUP BY ALL),
  sample AS MATERIALIZED (SELECT {_ID}, label, draws, bins FROM drawn JOIN ranked USING (iteration, fold, label, rank) JOIN binned USING (gene)),"""
    counts = ", ".join(f"sum(CASE WHEN label = {c} THEN draws ELSE 0 END)::BIGINT AS n{c}" for c in CLASSES)
    upto = ", ".join(f"sum(n{c}) OVER (w ORDER BY bin)::BIGINT AS l{c}, sum(n{c}) OVER (w)::BIGINT AS a{c}" for c in CLASSES)
    rest = ", ".join(f"a{c} - l{c} AS r{c}" for c in CLASSES)
    weight = [f"(CASE WHEN s{c} > 0 THEN a{c}::DOUBLE / s{c}::DOUBLE ELSE 0 END)" for c in CLASSES]
    return f"""
  x AS MATERIALIZED (SELECT gene, label, [{", ".join(f"{c}::DOUBLE" for c in features)}] AS v FROM ({matrix}) m),
  long AS (SELECT gene, unnest(v) AS v, unnest(range(0, {f})) AS f FROM x),
  edges AS MATERIALIZED (SELECT f, list_sort(list_distinct(quantile_disc(v, [{at}]))) AS e FROM long GROUP BY f),
  binned AS MATERIALIZED (SELECT gene, list(len(list_filter(e, lambda t: t <= v)) ORDER BY f) AS bins FROM long JOIN edges USING (f) GROUP BY gene),
  members AS MATERIALIZED ({members}),{drawn}
  sz AS MATERIALIZED (SELECT iteration, fold, {", ".join(f"coalesce(max(s) FILTER (label = {c}), 0) AS s{c}" for c in CLASSES)} FROM sizes GROUP BY ALL),
  grow AS (
    SELECT {_ID}, 1::BIGINT AS node, 0 AS depth, label, draws, bins, NULL::INT AS feature, NULL::INT AS cut, NULL::DOUBLE AS gain FROM sample
    UNION ALL
    SELECT * FROM (
      WITH n AS (SELECT DISTINCT {_ID}, node FROM grow WHERE depth < {settings.max_depth}),
      h AS (SELECT {_ID}, node, f, {_mix("hs", f"{settings.seed} + 100 * iteration + fold")}, {_mix("ht", "hs + tree")},
        {_mix("hn", "ht + node")}, {_mix("hf", "hn + f")} FROM n, range(0, {f}) r(f)),
      chosen AS (SELECT {_ID}, node, f, row_number() OVER (PARTITION BY {_ID}, node ORDER BY hf, f) AS turn FROM h QUALIFY turn <= {m}),
      cells AS (SELECT {_ID}, node, f, turn, g.bins[f + 1] AS bin, {counts} FROM grow g JOIN chosen USING ({_ID}, node) GROUP BY ALL),
      sums AS (SELECT {_ID}, node, f, turn, bin, {upto} FROM cells WINDOW w AS (PARTITION BY {_ID}, node, turn)),
      sides AS (SELECT *, {rest} FROM sums JOIN sz USING (iteration, fold)),
      scored AS (SELECT {_ID}, node, f, turn, bin, {_score("l")} + {_score("r")} AS score, {_score("a")} AS own FROM sides
        WHERE r0 + r1 + r2 > 0 AND (a0 > 0)::INT + (a1 > 0)::INT + (a2 > 0)::INT > 1),
      best AS (SELECT * FROM scored WHERE score > own * {BETTER!r}::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY {_ID}, node ORDER BY score DESC, turn, bin) = 1)
      SELECT {_ID}, 2 * node + (g.bins[f + 1] > bin)::INT, depth + 1, label, draws, bins, f::INT, bin::INT, score - own
      FROM grow g JOIN best USING ({_ID}, node))),
  splits AS (SELECT DISTINCT {_ID}, node // 2 AS node, feature, cut, gain FROM grow WHERE node > 1),
  class_counts AS (SELECT {_ID}, node, {", ".join(f"sum(CASE WHEN label = {c} THEN draws ELSE 0 END)::BIGINT AS a{c}" for c in CLASSES)} FROM grow GROUP BY ALL),
  nodes AS MATERIALIZED (
    SELECT {_ID}, node, feature, e[cut + 1] AS threshold,
      CASE WHEN {weight[0]} >= {weight[1]} AND {weight[0]} >= {weight[2]} THEN 0 WHEN {weight[1]} >= {weight[2]} THEN 1 ELSE 2 END AS class,
      coalesce(gain, 0) AS gain, a0 + a1 + a2 AS draws
    FROM class_counts JOIN sz USING (iteration, fold) LEFT JOIN splits USING ({_ID}, node) LEFT JOIN edges ON edges.f = feature)"""


def votes(rows: str) -> str:
    """CTEs up to ``scored``: gene, iteration, fold and the two scores.

    ``rows`` selects gene, iteration, fold and the values ``v`` of everything to be scored.
    """
    return f"""
  asked AS MATERIALIZED ({rows}),
  walk AS (
    SELECT gene, {_ID}, v, node, feature, threshold, class FROM asked JOIN nodes USING (iteration, fold) WHERE node = 1
    UNION ALL
    SELECT w.gene, {", ".join(f"w.{c}" for c in _ID.split(", "))}, w.v, t.node, t.feature, t.threshold, t.class FROM walk w JOIN nodes t
      ON t.iteration = w.iteration AND t.fold = w.fold AND t.tree = w.tree
      AND t.node = 2 * w.node + (CASE WHEN w.v[w.feature + 1] < w.threshold THEN 0 ELSE 1 END)
    WHERE w.feature IS NOT NULL),
  scored AS MATERIALIZED (
    SELECT gene, iteration, fold, sum((class = 1)::INT) / count(*) AS oncogene_score, sum((class = 2)::INT) / count(*) AS tsg_score
    FROM walk WHERE feature IS NULL GROUP BY ALL)"""
