"""Line de-duplication within an edit distance of one, by a deletion-neighbourhood join.

A line goes if an equal line, or one at edit distance 1, stands earlier: in a document
with a smaller id, or further up in the same document.  Lines are judged as they stand in
the input.  A line's place is its id, its number and a fingerprint of its row's text, so rows
that share an id are judged each by its own text.  Lines shorter than ``min_chars`` are left alone.

Equal lines are one from the start, told apart by 128 bits.  Every different line then
emits the hashed keys of its deletion neighbourhood: itself, and itself without one
character, with the place of that character.  Two lines at distance 1 meet either in one
key with one place (a substitution) or as a line and a line without a character (an
insertion).  Each member of a key meets the earliest member of its place, and the line
that is the key itself: never all pairs.  What met is verified by its edit distance.

Two lines within one edit agree on their first or their last half.  So lines whose halves
occur in no other line emit nothing, and the others only delete where a partner can
differ; that loses no pair.

Edge cases: null and empty texts stay as they are, also where another row has their id;
repeated rows count as one occurrence, so they lose and keep the same lines; rows that share
an id and differ in text are ordered by line number, then fingerprint; rows with a null id
stay as they are; the lines that stay are joined by line feeds again, so a text without any is
empty.  Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ModularHash, Texts, U, column, mix, slices, written

MIN_CHARS = 20
STEP = 8  # bytes in a length class
CHAR_BYTES = 4  # the most bytes that one edit touches
PLACE = ("doc_id", "line", "print")  # in this order, the earlier line first


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and number of every line."""
    breaks = np.flatnonzero(texts.data == 10)
    after = np.searchsorted(breaks, texts.bounds)  # line feeds before each text
    count = np.diff(after) + 1
    owner = np.repeat(np.arange(texts.n), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = texts.bounds[:-1][owner]
    start = np.where(number == 0, first, breaks[np.minimum(after[owner] + number - 1, max(len(breaks) - 1, 0))] + 1 if len(breaks) else first)
    last = number == count[owner] - 1
    end = np.where(last, texts.bounds[1:][owner], breaks[np.minimum(after[owner] + number, max(len(breaks) - 1, 0))] if len(breaks) else 0)
    return start, end, owner, number


def _characters(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return total[end] - total[start]


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows that can have lines: ``doc_id, print, text``."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("print"), "text")


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``doc_id, line, print, h1, h2, halves`` of every line long enough.

    ``halves`` holds hashes of the first and the last half for the line's length class,
    and again for the class below where a shorter partner may be in it (else null).
    """
    source = _source(docs, doc_id, text)
    names = ("f0", "l0", "f1", "l1")
    schema = source.selectExpr("doc_id", "0 AS line", "print", "0L AS h1", "0L AS h2", *[f"CAST(NULL AS BIGINT) AS {n}" for n in names]).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(column(batch, "text"))
            start, end, owner, number = _lines(texts)
            long = _characters(texts, start, end) >= min_chars
            start, end, owner, number = start[long], end[long], owner[long], number[long]
            second = texts.span_hash(start, end, salt=1)
            size = end - start
            made = []
            for below in (0, 1):
                kind = size // STEP - below
                half = STEP // 2 * kind - CHAR_BYTES // 2
                use = half > 0
                if below:
                    use &= size - CHAR_BYTES < STEP * (kind + 1)
                half = np.where(use, half, 0)
                tag = mix((kind.astype(np.int64) * 2).view(U) + U(7))
                first = texts.span_hash(start, start + half) ^ tag
                last = texts.span_hash(end - half, end) ^ mix(tag)
                made += [pa.array(k.view(np.int64), mask=~use) for k in (first, last)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)),
                 column(batch, "print").take(pa.array(owner)),
                 pa.array(texts.span_hash(start, end).view(np.int64)), pa.array(second.view(np.int64)), *made],
                names=schema.names,
            )

    return source.mapInArrow(find, schema)


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, line, print`` of every line that an earlier one makes redundant."""
    found = written(occurrences(docs, doc_id, text, min_chars), "lines")
    at = F.struct(*PLACE).alias("at")
    # all occurrences of a line meet in a partial aggregate first
    halves = ("f0", "l0", "f1", "l1")
    distinct = written(
        found.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in halves]),
        "distinct",
    )
    copies = found.join(distinct.where("n > 1").select("h1", "h2", "at"), ["h1", "h2"]).where(
        F.struct(*PLACE) > F.col("at")
    ).select(*PLACE)

    keyed = distinct.select("at", F.explode(F.array(*[
        F.struct(F.col(c).alias("key"), F.lit(c[0] == "f").alias("front")) for c in halves
    ])).alias("k")).select("at", "k.*").where("key IS NOT NULL")
    shared = keyed.groupBy("key", "front").agg(F.count("*").alias("n")).where("n > 1").select("key", "front")
    partners = keyed.join(shared, ["key", "front"]).groupBy("at").agg(
        F.max("front").alias("front"), F.max(~F.col("front")).alias("back")
    )
    asked = partners.groupBy(F.col("at.doc_id").alias("doc"), F.col("at.print").alias("of")).agg(
        F.collect_list(F.struct(F.col("at.line").alias("line"), "front", "back")).alias("asked")
    )
    source = _source(docs, doc_id, text)
    rows = source.join(asked.hint("shuffle_hash"), (source.doc_id == asked.doc) & (source.print == asked.of))
    rows = rows.select("doc_id", "print", "text", "asked")
    schema = "doc_id long, line int, print long, front boolean, back boolean, content string"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {"doc_id": [], "line": [], "print": [], "front": [], "back": [], "content": []}
            of_row = (column(batch, c).to_pylist() for c in ("doc_id", "print", "text", "asked"))
            for doc, print_, whole, wanted in zip(*of_row, strict=True):
                lines = whole.split("\n")
                for w in wanted:
                    out["doc_id"].append(doc)
                    out["print"].append(print_)
                    out["content"].append(lines[w["line"]])
                    for c in ("line", "front", "back"):
                        out[c].append(w[c])
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    content = written(rows.mapInArrow(take, schema).dropDuplicates(list(PLACE)), "content")

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 1 << 18):
            texts = Texts(column(batch, "content"))
            hashes = ModularHash(texts.data)
            points = np.flatnonzero((texts.data & 0xC0) != 0x80)
            ends = np.append(points[1:], len(texts.data))
            at = np.searchsorted(points, texts.bounds)  # characters before each line
            front, back = (column(batch, c).to_numpy(zero_copy_only=False).astype(bool) for c in ("front", "back"))
            start, end = texts.bounds[:-1], texts.bounds[1:]
            # an agreeing first half leaves the edit behind it, and the other way round
            half = np.maximum(0, STEP // 2 * ((end - start) // STEP - 1) - CHAR_BYTES // 2)
            low = np.where(front & ~back, np.searchsorted(ends, start + half, side="right"), at[:-1])
            high = np.where(back & ~front, np.searchsorted(points, end - half), at[1:])
            low = np.maximum(low, at[:-1])
            count = np.maximum(high - low, 0)
            row = np.repeat(np.arange(texts.n), count)
            cut = np.arange(len(row)) + (low - (np.cumsum(count) - count))[row]
            made = hashes.without(start[row], end[row], points[cut], ends[cut])
            keys = np.concatenate([hashes.spans(start, end), made])
            places = np.concatenate([np.full(texts.n, -1), cut - at[row]])
            row = pa.array(np.concatenate([np.arange(texts.n), row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32)), *[column(batch, c).take(row) for c in PLACE]],
                names=["key", "place", *PLACE],
            )

    variants = content.select(*PLACE, "front", "back", "content").mapInArrow(
        vary, "key long, place int, doc_id long, line int, print long"
    )
    # keys of one line only meet nobody
    who = F.xxhash64(*PLACE)
    shared = variants.groupBy("key").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select("key")
    meeting = written(variants.join(shared, "key").select("key", "place", at), "variants")
    # the earliest member of each place of a key; the line that is the key, and its earliest member
    first = meeting.groupBy("key", "place").agg(F.min("at").alias("first"))
    of_key = first.groupBy("key").agg(
        F.min(F.when(F.col("place") == -1, F.col("first"))).alias("itself"),
        F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("any"),
    )
    met = meeting.join(first, ["key", "place"]).join(of_key, "key").select("at", F.explode(F.array(
        "first", F.when(F.col("place") >= 0, F.col("itself")), F.when(F.col("place") == -1, F.col("any"))
    )).alias("earlier")).where("earlier < at").distinct()
    left = content.select(at, F.col("content").alias("x"))
    right = content.select(F.struct(*PLACE).alias("earlier"), F.col("content").alias("y"))
    near = met.join(left, "at").join(right, "earlier").where(F.levenshtein("x", "y", 1) >= 0).select("at").distinct()
    # that is the first occurrence; the later ones go as its copies
    return copies.unionByName(near.select("at.*")).distinct()


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("line", pa.int32()), ("print", pa.int64()), ("front", pa.bool_()), ("back", pa.bool_()), ("content", pa.string()),
])


def without_lines(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the named lines taken out of their texts; the same columns.

    The row goes along as one struct, so no column of it can clash.
    """
    lists = gone.groupBy(F.col("doc_id").alias("doc"), F.col("print").alias("of")).agg(F.collect_list("line").alias("gone"))
    whole = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole).alias("print"), whole.alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"),
    )
    joined = rows.join(lists.hint("shuffle_hash"), (F.col("id") == F.col("doc")) & (F.col("print") == F.col("of")), "left")
    # numbers of the lines that stay, by a hashed difference; then the lines, split once
    lines = F.split("text", "\n", -1)
    parts = F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone").alias("stay"))
    left = F.transform(F.array(parts), lambda p: F.array_join(F.transform(p["stay"], lambda i: F.get(p["lines"], i)), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return joined.select(*[kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without redundant lines."""
    return without_lines(docs, written(removed_lines(docs, doc_id, text, min_chars), "gone"), doc_id, text)


# The digest of every document, for ids that are not shared.  Lines meet where one is the other
# without a character, or where both are alike without the character at one place.
SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
long AS (SELECT *, doc_id * 10000000 + i AS spot FROM l WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, min(spot) AS lead FROM long GROUP BY line),
keys AS (
  SELECT line, lead, 0 AS place, line AS key FROM firsts
  UNION ALL SELECT line, lead, k, substr(line, 1, k - 1) || substr(line, k + 1) FROM (SELECT *, unnest(range(1, length(line) + 1)) AS k FROM firsts)),
near AS (SELECT DISTINCT a.line FROM keys a JOIN keys b USING (key) WHERE b.lead < a.lead AND (a.place = b.place OR a.place = 0 OR b.place = 0)),
gone AS (SELECT doc_id, i FROM long JOIN firsts USING (line) WHERE spot > lead OR line IN (SELECT line FROM near)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS INT) AS n_lines, CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept.text, '')) END AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS kept_md5
FROM d LEFT JOIN kept USING (doc_id)
"""
