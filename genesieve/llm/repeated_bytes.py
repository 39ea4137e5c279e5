"""Removal of every byte inside a 100-byte string that also starts earlier.

Any two equal windows of 100 bytes choose the same smallest hash among their 32-byte
substrings, their seed, at the same place.  So windows fall into runs that share one
occurrence of a seed, at most 69 each, and only runs whose seed occurs twice can hold a
repeat.  Equal runs are one from the start: later copies go
whole.  The different runs of a seed become the strings of a shard; shards get their
Burrows-Wheeler transforms, which are merged by interleave refinement, and the repeated
intervals of the merged transform, with common prefixes of 100 bytes or more, are the
repeated windows.  Each window but the earliest of its interval is marked.

A window is read as ten symbols of ten bytes, in ten phases, so a common prefix of ten
symbols is one of 100 bytes and ten rounds settle it.

A seed with more than ``hot`` different runs is split: each of its windows becomes a run
with its own content as its seed, so its equal windows meet by that and are counted in
partial aggregates first.

Rows are told apart by their id and a fingerprint of their text, and ordered by both.  Runs are
shuffled once, to the seeds that occur twice; texts move twice, to the runs that are merged and
to the spans that are cut.  Every table between is dropped when its last reader is done.

Edge cases: a null or empty text has no bytes and nothing is removed; texts under 100
bytes stay; repeated rows (id and text) count as one document, so they get equal results and do
not remove each other; rows that share an id and differ in text are documents of their own;
rows with a null id are not compared and stay as they are; no rows in, no rows out.  Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import Scratch, Texts, U, column, rolling_hash, slices

WINDOW = 100
SEED = 32
SYMBOL = 10  # bytes; WINDOW is a multiple of it
HOT = 2000  # different runs of a seed that one merge takes
MERGE_BYTES = 60_000  # bytes merged at once, whole seeds at least
SHARDS = 4


def _runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, start (in ``data``), number of windows and text of every run of windows."""
    windows = np.maximum(texts.sizes - WINDOW + 1, 0)
    if not windows.sum():
        return (np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    gram = rolling_hash(texts.data, SEED)
    span, reach = WINDOW - SEED + 1, 1
    least = gram
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(gram) - span + 1], least[span - reach :][: len(gram) - span + 1])
    owner = np.repeat(np.arange(texts.n), windows)
    first = np.repeat(texts.bounds[:-1] - (np.cumsum(windows) - windows), windows)
    at = first + np.arange(len(owner))
    seed = least[at]
    new = np.ones(len(at), dtype=bool)
    # a window that begins with its seed is the last one to hold that occurrence
    new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1]) | (gram[at[:-1]] == seed[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    return seed[begin], at[begin], count, owner[begin]


AT = ("doc_id", "print", "start")  # in this order, the earlier place first


def runs(docs: DataFrame, details: bool = True) -> DataFrame:
    """``seed`` and, with details, ``content, doc_id, print, start, windows`` of every run.

    ``docs`` has ``doc_id``, ``print`` and ``text``.
    """
    kinds = ["seed long", *(["content long", "doc_id long", "print long", "start int", "windows int"] if details else [])]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(column(batch, "text"))
            seed, start, count, owner = _runs(texts)
            made = [pa.array(seed.view(np.int64))]
            if details:
                content = texts.span_hash(start, start + count + WINDOW - 1)
                rows = pa.array(owner)
                made += [
                    pa.array(content.view(np.int64)), column(batch, "doc_id").take(rows), column(batch, "print").take(rows),
                    pa.array((start - texts.bounds[owner]).astype(np.int32)), pa.array(count.astype(np.int32)),
                ]
            yield pa.RecordBatch.from_arrays(made, names=[k.split()[0] for k in kinds])

    columns = ["doc_id", "print", "text"] if details else ["text"]
    return docs.where("doc_id IS NOT NULL").select(*columns).mapInArrow(find, ", ".join(kinds))


def repeated_windows(content: pa.Array, at: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every window of the strings that also starts earlier.

    ``at[i]`` is the rank of the position of string i's first byte: two columns, document
    and start in it.
    """
    texts = Texts(content)
    data, bounds = texts.data, texts.bounds
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.repeat(np.arange(texts.n), texts.sizes)
    place = np.arange(n)
    valid = place + SYMBOL <= bounds[1:][string]
    # exact ranks of ten bytes, from ranks of five
    half = np.zeros(n + SYMBOL, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(SYMBOL, np.uint8)]).astype(np.int64)
    for k in range(5):
        half[: n + 5] = half[: n + 5] << 8 | padded[k : n + 5 + k]
    _, half_rank = np.unique(half[: n + 5], return_inverse=True)
    _, rank = np.unique((half_rank[:n] << 32 | half_rank[5 : n + 5])[valid], return_inverse=True)
    symbol = np.zeros(n, dtype=np.int64)
    symbol[valid] = rank + 1

    edges = np.unique(np.searchsorted(bounds, np.linspace(0, n, shards + 1)[1:-1]))
    groups = np.split(np.arange(texts.n), edges)
    transforms = []
    for group in groups:
        if not len(group):
            continue
        a, b = bounds[group[0]], bounds[group[-1] + 1]
        own = np.flatnonzero(valid[a:b]) + a
        number = np.full(b - a, -1, dtype=np.int64)
        number[own - a] = np.arange(len(own))
        after = np.where(own + SYMBOL < b, own + SYMBOL, a)
        linked = (own + SYMBOL < b) & valid[np.minimum(own + SYMBOL, n - 1)] & (string[np.minimum(own + SYMBOL, n - 1)] == string[own])
        last = np.flatnonzero(~linked)  # each phase of a string ends once
        following = np.empty(len(own), dtype=np.int64)
        following[linked] = number[after[linked] - a]
        following[last] = -1 - np.arange(len(last))
        previous = np.full(len(own), -1, dtype=np.int64)
        previous[following[linked]] = np.flatnonzero(linked)
        made = bwt.transform(symbol[own], following, previous, last)
        transforms.append(bwt.Transform(made.before, np.where(made.place >= 0, own[np.maximum(made.place, 0)], -1), made.strings))
    where, same = bwt.merge(transforms, WINDOW // SYMBOL)
    whole = where + WINDOW <= bounds[1:][string[where]]
    where, same = where[whole], same[whole]
    which = string[where]
    offset = where - bounds[which]
    order = np.lexsort((at[which, 1] + offset, at[which, 0], same))
    where, same, which, offset = where[order], same[order], which[order], offset[order]
    doc, start = at[which, 0], at[which, 1] + offset
    head = np.ones(len(same), dtype=bool)
    head[1:] = same[1:] != same[:-1]
    origin = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[origin]) | (start != start[origin])
    return which[later], offset[later]


def _spans(which: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows: string, first byte, end of the last window."""
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    new = np.ones(len(which), dtype=bool)
    new[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(which)) - 1 if len(which) else begin
    return which[begin], offset[begin], offset[end] + WINDOW


def _merged(segments: DataFrame) -> DataFrame:
    """``doc_id, print, begin, end`` of repeats among ``seed, doc_id, print, start, content``, seed by seed."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        doc, print_, start = (table[c].to_numpy() for c in AT)
        content = table["content"].combine_chunks()
        if isinstance(content, pa.ChunkedArray):
            content = content.chunk(0)
        _, rank = np.unique(np.column_stack([doc, print_]), axis=0, return_inverse=True)  # in order of both
        start = start.astype(np.int64)
        which, begin, end = _spans(*repeated_windows(content, np.column_stack([rank.ravel(), start])))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[which]), pa.array(print_[which]), pa.array(start[which] + begin), pa.array(start[which] + end)],
            names=["doc_id", "print", "begin", "end"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = column(batch, "seed").to_numpy()
            upto = np.cumsum(pa.compute.binary_length(column(batch, "content")).to_numpy())
            changes = np.flatnonzero(np.append(
                bool(held) and column(held[-1], "seed")[-1].as_py() != seeds[0], seeds[1:] != seeds[:-1]
            ))
            first = 0
            for cut in changes.tolist():
                there = int(upto[cut - 1]) - (int(upto[first - 1]) if first else 0) if cut > first else 0
                if bytes_held + there >= MERGE_BYTES:
                    if cut > first:
                        held.append(batch.slice(first, cut - first))
                    yield settle(held)
                    held, bytes_held, first = [], 0, cut
            held.append(batch.slice(first))
            bytes_held += int(upto[-1]) - (int(upto[first - 1]) if first else 0)
        if held:
            yield settle(held)

    return segments.repartition("seed").sortWithinPartitions("seed").mapInArrow(stream, "doc_id long, print long, begin long, end long")


def _take(rows: DataFrame) -> DataFrame:
    """Bytes of the asked runs of each document, or of each window of a hot seed's runs by itself.

    ``rows``: doc_id, print, text, asked (seed, start, windows, hot).
    """
    schema = "seed long, hot boolean, doc_id long, print long, start int, content binary"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            seed, hot, row, start, content = [], [], [], [], []
            texts = Texts(column(batch, "text"))
            asked = column(batch, "asked").to_pylist()
            for i in range(texts.n):
                whole = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes()
                for a in asked[i]:
                    first, windows = a["start"], a["windows"]
                    pieces = range(first, first + windows) if a["hot"] else (first,)
                    length = WINDOW if a["hot"] else windows + WINDOW - 1
                    seed += [a["seed"]] * len(pieces)
                    hot += [a["hot"]] * len(pieces)
                    row += [i] * len(pieces)
                    start += pieces
                    for begin in pieces:
                        piece = whole[begin : begin + length]
                        content.append(hashlib.md5(piece, usedforsecurity=False).digest() if a["hot"] else piece)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed, pa.int64()), pa.array(hot, pa.bool_()), column(batch, "doc_id").take(of), column(batch, "print").take(of),
                 pa.array(start, pa.int32()), pa.array(content, pa.binary())],
                names=["seed", "hot", *AT, "content"],
            )

    return rows.mapInArrow(take, schema)


def _to_texts(docs: DataFrame, rows: DataFrame, what: str, fields: list[str], how: str = "inner") -> DataFrame:
    """Every text with the list of its ``rows``, by id and fingerprint."""
    lists = rows.groupBy(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print")).agg(
        F.collect_list(F.struct(*fields)).alias(what)
    )
    same = (F.col("doc_id") == F.col("of_id")) & (F.col("print") == F.col("of_print"))
    return docs.join(lists.hint("shuffle_hash"), same, how).select("doc_id", "print", "text", what)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, print, begin, end`` of removed bytes, which may overlap.

    ``docs`` has ``doc_id``, ``print`` and ``text``.
    """
    scratch = Scratch(docs.sparkSession)
    twice = runs(docs, details=False).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    # written, so that the join reads two plain exchanges and a hot seed's runs can be split
    twice = scratch.keep(twice, "twice")
    found = scratch.keep(runs(docs).join(twice, "seed"), "runs")
    scratch.drop("twice")
    at = F.struct(*AT)
    kinds = found.groupBy("seed", "content").agg(F.min(at).alias("at"), F.max("windows").alias("windows"), F.count("*").alias("n"))
    kinds = scratch.keep(kinds, "kinds")
    copies = found.join(kinds.where("n > 1").select("seed", "content", "at"), ["seed", "content"]).where(at > F.col("at"))
    copies = copies.selectExpr("doc_id", "print", "CAST(start AS BIGINT) AS begin", f"CAST(start AS BIGINT) + windows + {WINDOW - 1} AS end")
    parts = [scratch.keep(copies, "copies")]
    scratch.drop("runs")

    per_seed = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(per_seed, "seed").select("seed", "at.*", "windows", (F.col("kinds") > hot).alias("hot"))
    segments = _take(_to_texts(docs, wanted, "asked", ["seed", "start", "windows", "hot"]))
    segments = scratch.keep(segments, "segments")
    scratch.drop("kinds")
    parts.append(scratch.keep(_merged(segments.where("NOT hot").drop("hot")), "merged"))
    single = segments.where("hot").select("content", *AT)
    first = single.groupBy("content").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1")
    again = single.join(first, "content").where(at > F.col("at"))
    again = again.selectExpr("doc_id", "print", "CAST(start AS BIGINT) AS begin", f"CAST(start AS BIGINT) + {WINDOW} AS end")
    parts.append(scratch.keep(again, "again"))
    scratch.drop("segments")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans`` with the remaining bytes."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("print"), "text")
    rows = _to_texts(source, repeated_spans(source, hot), "spans", ["begin", "end"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin: long, end: long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = _cut(Texts(column(batch, "text")), column(batch, "spans"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *out], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return rows.mapInArrow(cut, schema)


def _cut(texts: Texts, spans: pa.Array) -> list[pa.Array]:
    whole = texts.data.tobytes()
    removed, number, kept, merged = [], [], [], []
    for i, asked in enumerate(spans.to_pylist()):
        a, b = int(texts.bounds[i]), int(texts.bounds[i + 1])
        joined: list[list[int]] = []
        for s in sorted(asked or [], key=lambda s: s["begin"]):
            if joined and s["begin"] <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], s["end"])
            else:
                joined.append([s["begin"], s["end"]])
        joined = [[x, min(y, b - a)] for x, y in joined if x < b - a]
        pieces, at = [], 0
        for x, y in joined:
            pieces.append(whole[a + at : a + x])
            at = y
        pieces.append(whole[a + at : b])
        removed.append(sum(y - x for x, y in joined))
        number.append(len(joined))
        kept.append(b"".join(pieces))
        merged.append([{"begin": x, "end": y} for x, y in joined])
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return [
        pa.array(texts.sizes), pa.array(removed, pa.int64()), pa.array(number, pa.int64()),
        pa.array(kept, pa.binary()), pa.array(merged, kind),
    ]


def digest(rows: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeats``."""
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
