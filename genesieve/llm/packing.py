"""Best-fit packing of token pieces by vectors of tokens, documents and attention cost.

A document's ids are followed by one end id.  Documents longer than a sequence are cut
into full pieces, the first one shorter; all other documents stay whole.  Every piece is
a vector (tokens, 1, tokens squared), every sequence has a capacity in each component.
Pieces are taken by falling length; among the open sequences that can hold a piece under
every capacity, the one with the least weighted residual norm (or the largest weighted
dot product of piece and residual) takes it; without one, a new sequence is opened.

Pieces are dealt into groups of bounded size that are packed independently, so the work
spreads over tasks; a group leaves a few sequences open at its end, which is the price.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by
one, each with its own pieces; a null id is kept; a text of any length is cut, never
shortened; no rows in, no rows out.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, column, parts_for, slices, written
from .tokens import byte_bpe

SEQUENCE = 2048
END_ID = 0
GROUP = 20_000  # pieces packed together


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how much each component counts in the choice."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE  # a piece has a token at least, so this value never binds
    attention: int = SEQUENCE * SEQUENCE  # squares of parts never exceed the square of the sum
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    select: str = "residual_norm"  # or "dot_product"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = source.selectExpr(
        "doc_id", "0 AS piece", "0L AS start", "0L AS length", "0L AS ids_crc32"
    ).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe()
        for batch in slices(batches, "text", 4 << 20):
            ids, bounds = bpe.encode(Texts(column(batch, "text")))
            ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            total = np.diff(bounds)
            number = -(-total // length)
            first = total - (number - 1) * length
            row = np.repeat(np.arange(len(total)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            raw = memoryview(ids.tobytes())
            begin = ((bounds[row] + start) * 4).tolist()
            finish = ((bounds[row] + start + size) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin, finish, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(size), pa.array(crc, type=pa.int64()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece.

    Pieces of one length are alike, so they are placed together: the open sequences are
    ranked once by the selection rule, and each takes as many as its residuals allow
    before the next one does.
    """
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weight = np.array(capacity.weights)
    order = np.argsort(-lengths, kind="stable")
    left = np.zeros((0, 3))
    number = np.zeros(0, dtype=np.int64)  # of the sequence in that row of `left`
    opened = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    values, at, counts = np.unique(-lengths[order], return_index=True, return_counts=True)
    smallest = float(-values[-1]) if len(values) else 0.0
    for length, first, m in zip(-values, at, counts, strict=True):
        item = np.array([length, 1, float(length) * length])
        if (item > cap).any():
            raise ValueError("a piece exceeds the capacity of a sequence")
        places, room = [np.zeros(0, np.int64)], m
        if len(left):
            fits = np.floor(left / item).min(axis=1).astype(np.int64)
            able = np.flatnonzero(fits)
            if len(able):
                if capacity.select == "dot_product":
                    score = -((left[able] / cap) * (item / cap) * weight).sum(axis=1)
                else:
                    score = (((left[able] - item) / cap) ** 2 * weight).sum(axis=1)
                ranked = able[np.lexsort((number[able], score))]
                take = np.minimum(fits[ranked], np.maximum(0, m - (np.cumsum(fits[ranked]) - fits[ranked])))
                places.append(np.repeat(ranked, take))
                room = m - int(take.sum())
        if room:
            each = int(np.floor(cap / item).min())
            fresh = -(-room // each)
            places.append(len(left) + np.arange(room) // each)
            left = np.concatenate([left, np.tile(cap, (fresh, 1))])
            number = np.concatenate([number, opened + np.arange(fresh)])
            opened += fresh
        place = np.concatenate(places)
        rows = order[first : first + m]
        before = np.arange(m) - np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])[
            np.cumsum(np.concatenate([[0], np.diff(place) != 0]).astype(np.int64))
        ]
        sequence[rows] = number[place]
        offset[rows] = (cap[0] - left[place, 0]).astype(np.int64) + before * length
        used = np.bincount(place, minlength=len(left))
        left = left - used[:, None] * item
        open_ = (left >= np.array([smallest, 1, smallest * smallest])).all(axis=1)
        left, number = left[open_], number[open_]
    return sequence, offset


def pack(cut: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; ``cut`` is a written table of pieces."""
    groups = parts_for(cut.count(), group)
    # Row numbers of a written table are the same whenever a task is run again.
    dealt = cut.withColumn("__group", F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {groups})"))
    schema = cut.selectExpr("*", "0L AS sequence_id", "0L AS offset").schema

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="__group").assign(sequence_id=(int(key[0]) << 24) + sequence, offset=offset)

    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: Capacity = Capacity()) -> DataFrame:
    """Tokenise, cut and pack every document; texts are read once and never shuffled."""
    return pack(written(pieces(docs, doc_id, text, capacity.tokens), "pieces"), capacity)
