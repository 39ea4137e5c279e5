"""Blocked Bloom filters of hashed keys, built by Spark and small enough to broadcast.

A key belongs to a shard; each shard has blocks of 512 bits, by its number of keys.  A key
sets ``PROBES`` bits of one block, so a test reads one cache line.  Bits are set in partial
aggregates and joined by a bitwise or, so no key reaches the driver, only the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, column, distinct_runs, mix

KEY_BITS = 16  # of the filter for each key
PROBES = 6
BLOCK = 512


@dataclass(frozen=True)
class Layout:
    """First block and number of blocks of every shard; a shard without keys has none."""

    first: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, keys: dict[int, int]) -> Layout:
        blocks = np.zeros(max(keys, default=-1) + 1, dtype=np.int64)
        for shard, count in keys.items():
            blocks[shard] = -(-count * KEY_BITS // BLOCK)
        return cls(np.cumsum(blocks) - blocks, blocks)

    @property
    def words(self) -> int:
        return int(self.blocks.sum()) * BLOCK // 64

    def place(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        """First word of each key's block; -1 where its shard has no keys."""
        known = (shard >= 0) & (shard < len(self.blocks))
        shard = np.where(known, shard, 0)
        blocks = self.blocks[shard] if len(self.blocks) else np.zeros(len(shard), np.int64)
        at = ((key >> U(32)) * blocks.view(U) >> U(32)).view(np.int64)
        first = self.first[shard] if len(self.first) else blocks
        return np.where(known & (blocks > 0), (first + at) * (BLOCK // 64), -1)


def _bits(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word in the block and mask of every bit that a key sets."""
    spread = mix(key + U(0x5851F42D4C957F2D))
    for j in range(PROBES):
        bit = (spread >> U(9 * j)) & U(BLOCK - 1)
        yield (bit >> U(6)).view(np.int64), U(1) << (bit & U(63))


def holds(layout: Layout, words: np.ndarray, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the filter may hold."""
    place = layout.place(shard, key)
    left = np.flatnonzero(place >= 0)
    for word, mask in _bits(key):
        if not len(left):
            break
        # few keys survive the first tests, so later ones read little
        left = left[(words[place[left] + word[left]] & mask[left]) != 0]
    return left


def build(keys: DataFrame, layout: Layout) -> np.ndarray:
    """The filter's words, from ``shard, key``."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = column(batch, "key").to_numpy().view(U)
            place = layout.place(column(batch, "shard").to_numpy().astype(np.int64), key)
            if not len(key):
                continue
            at, masks = zip(*((place + word, mask) for word, mask in _bits(key)), strict=True)
            at, masks = np.concatenate(at), np.concatenate(masks)
            order, new = distinct_runs(at)
            heads = np.flatnonzero(new)
            joined = np.bitwise_or.reduceat(masks[order], heads)
            yield pa.RecordBatch.from_arrays([pa.array(at[order][heads]), pa.array(joined.view(np.int64))], names=["at", "mask"])

    set_ = keys.mapInArrow(mark, "at long, mask long").groupBy("at").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    words = np.zeros(layout.words, dtype=U)
    words[set_["at"].to_numpy()] = set_["mask"].to_numpy().view(U)
    return words
