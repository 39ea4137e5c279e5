"""Divergence between the sources of a language, over run-length encoded count columns.

Terms are runs of letters and characters beyond ASCII, with A-Z lowered.  A language's
vocabulary holds the terms of at least ``min_docs`` of its documents; each source has a
column of counts over it.  Terms with the same counts in all sources are one row with a
multiplicity.  Rows are sorted into blocks by their counts, and a block orders its rows by
the columns with the fewest different counts first, so equal counts stand together.  Each
column is then run-length encoded, and two columns meet run by run: the bounds of both are
merged and the difference of shares is multiplied by the number of terms between bounds.
Blocks add up, so no task holds a vocabulary.

Shares are ``p = 1 + floor(10**9 * (count + 5) / (N + 5 V))`` in whole numbers.  A group's
``pair`` rows name each other source of its language and the sum of all differences; its
``term`` rows name the terms it uses more than its language does, the ``top`` first.

The result has a row for every two sources of a language, so sources are taken to be few
enough for that; terms, documents and occurrences are not bounded.

Edge cases: null text, lang and source read as ''; a text without terms only makes its
group occur; without kept terms all pairs are 0 and there are no term rows; a lone source
has no pairs; repeated rows count each; no rows in, no rows out.  Only the named columns
are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, column, distinct_runs, parts_for, slices, written

MIN_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5
BLOCK_ROWS = 50_000  # different rows of counts in a block, about
ORDERED_BY = 16  # columns that order a block's rows
SLICE = 4 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def distinct_spans(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First span of every different content, and each span's content number."""
    key, second = texts.span_hash(start, end), texts.span_hash(start, end, salt=1)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    if (second != second[first][back]).any():
        _, first, back = np.unique(np.column_stack([key, second]), axis=0, return_index=True, return_inverse=True)
    return first, back.ravel()


def _codes(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First row of every different group of values, and each row's group."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        coded = c.dictionary_encode()
        code = code * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    return first, back


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, one row or more for each group's term."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = Texts(column(batch, "text"))
            lower = texts.data.copy()
            lower[(lower >= 65) & (lower <= 90)] |= 32
            texts.data = lower
            start, end, owner = texts.runs(_LETTER[lower])
            if not len(start):
                continue
            first, term = distinct_spans(texts, start, end)
            raw = lower.tobytes()
            terms = pa.array([raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.string())
            row, group = _codes(column(batch, "lang"), column(batch, "source"))
            # occurrences by document, then by group
            in_doc, times = np.unique(owner * len(first) + term, return_counts=True)
            key = group[in_doc // len(first)] * len(first) + in_doc % len(first)
            order, new = distinct_runs(key)
            at = np.flatnonzero(new)
            key = key[order][at]
            rows = pa.array(row[key // len(first)])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "lang").take(rows), column(batch, "source").take(rows), terms.take(pa.array(key % len(first))),
                 pa.array(np.add.reduceat(times[order], at)), pa.array(np.diff(np.append(at, len(order))))],
                names=["lang", "source", "term", "n", "docs"],
            )

    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, n, counts``: kept terms with their occurrences, in all and by source."""
    by_source = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    return by_term.where(F.col("docs") >= min_docs).select("lang", "term", "n", "counts")


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exactly, digit by digit."""
    whole = total + PRIOR * terms
    rest = count + PRIOR
    if whole >= 1 << 53:
        rest = rest.astype(object)
    out = np.zeros(len(count), dtype=np.int64)
    for _ in range(3):  # UNIT is 1000 ** 3
        rest = rest * 1000
        out = out * 1000 + (rest // whole).astype(np.int64)
        rest = rest % whole
    return out + 1


def order_rows(row: np.ndarray, place: np.ndarray, count: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """An order of a block's rows that brings equal counts together.

    Rows are sorted by the columns with the fewest different counts first.
    """
    kinds = np.bincount(np.unique(np.column_stack([place, count]), axis=0)[:, 0], minlength=columns)
    keys = []
    for c in np.argsort(kinds, kind="stable")[:ORDERED_BY]:
        dense = np.zeros(rows, dtype=np.int64)
        dense[row[place == c]] = count[place == c]
        keys.append(dense)
    return np.lexsort(keys[::-1])


def encode(column_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, column_[1:] != column_[:-1]))


def run_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], until: np.ndarray) -> int:
    """Sum of |difference| x terms over the runs that two columns' bounds cut together.

    A column is the starts of its runs and their values; ``until[i]`` terms stand before row i.
    """
    bounds = np.union1d(a[0], b[0])
    values = [v[np.searchsorted(s, bounds, side="right") - 1] for s, v in (a, b)]
    terms = until[np.append(bounds[1:], len(until) - 1)] - until[bounds]
    return int((np.abs(values[0] - values[1]) * terms).sum())


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of differences over one block of rows, for every two sources of its language."""
    sources = right["source"].combine_chunks()
    total, terms = right["source_n"].to_numpy(), int(right["terms"][0].as_py())
    lists = left["counts"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = pc.index_in(flat.field("source"), value_set=sources).to_numpy()
    count = flat.field("n").to_numpy()
    order = order_rows(row, place, count, len(lists), len(sources))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    until = np.concatenate([[0], np.cumsum(left["times"].to_numpy()[order])])
    by_place = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[by_place], np.arange(len(sources) + 1))
    columns = []
    for c in range(len(sources)):
        own = by_place[cut[c] : cut[c + 1]]
        dense = np.zeros(len(lists), dtype=np.int64)
        dense[rank[row[own]]] = count[own]
        starts = encode(dense)
        columns.append((starts, share(dense[starts], int(total[c]), terms)))
    names = sources.to_pylist()
    made = [(names[i], names[j], run_sum(columns[i], columns[j], until)) for i in range(len(names)) for j in range(i)]
    return pa.table({
        "a": pa.array([m[0] for m in made], pa.string()), "b": pa.array([m[1] for m in made], pa.string()),
        "value": pa.array([m[2] for m in made], pa.int64()),
    }).add_column(0, "lang", pa.array([left["lang"][0].as_py()] * len(made), pa.string()))


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two sources of a language with kept terms, each pair once.

    ``groups``: lang, source, source_n, terms.
    """
    rows = kept.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    rows = written(rows, "rows")
    n = parts_for(rows.count(), BLOCK_ROWS)
    rows = rows.repartitionByRange(n, "lang", "counts").withColumn("block", F.spark_partition_id())
    rows = written(rows, "blocks")
    blocks = rows.select(F.col("lang").alias("of"), F.col("block").alias("part")).distinct()
    wanted = blocks.join(groups.withColumnRenamed("lang", "of"), "of")
    sums = rows.groupBy("lang", "block").cogroup(wanted.groupBy("of", "part")).applyInArrow(_block, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(n: str, total: str) -> str:
    return f"1 + ({UNIT} * CAST({n} + {PRIOR} AS DECIMAL(20,0))) div CAST({total} + {PRIOR} * terms AS DECIMAL(20,0))"


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of language and source."""
    kept = written(vocabulary(term_counts(docs, text, lang, source), min_docs), "kept")
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    by_source = kept.select("lang", "n", F.explode("counts").alias("c"), "term").select("lang", "c.source", "c.n", F.col("n").alias("all"), "term")
    of_source = by_source.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    groups = occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["source_n", "terms", "lang_n"]), "groups")

    sums = pair_sums(kept, groups.where("terms > 0").select("lang", "source", "source_n", "terms"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    scored = by_source.join(groups, ["lang", "source"]).where("n > 0").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr(f"({_share('n', 'source_n')}) - ({_share('all', 'lang_n')})").alias("value"),
    ).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM groups LEFT JOIN counts c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.n + {PRIOR} * l.terms) AS p,
    1 + ({UNIT}::HUGEINT * (k.n + {PRIOR})) // (l.n + {PRIOR} * l.terms) AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
