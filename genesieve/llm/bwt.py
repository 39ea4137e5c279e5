"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Strings are sequences of positive symbols, each ended by a terminator of its own that
sorts before all symbols, by number of string.  A transform keeps, for every suffix in
sorted order, the symbol before it (0 at the start of a string).

The merge knows only the transforms.  It holds an interleave: which shard each place of
the merged order comes from.  At first that is shard after shard; every round sorts it
stably by the symbol before each suffix, after which it is right for one symbol more.
Where neighbours first differ gives their common prefix.  Suffixes are never compared
across shards again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transform:
    """``before`` in the order of suffixes, terminators first; ``place`` of each suffix."""

    before: np.ndarray
    place: np.ndarray
    strings: int


def transform(symbols: np.ndarray, following: np.ndarray, previous: np.ndarray, last: np.ndarray) -> Transform:
    """Of a shard's strings, given as linked places.

    ``following[i]`` is the place after place i, or -1 - s at the end of string s;
    ``previous[i]`` the place before, or -1; ``last[s]`` the last place of string s.
    Suffixes are sorted by doubling, within this shard alone.
    """
    n, strings = len(symbols), len(last)
    # terminators take ranks 0 .. strings - 1, so all suffixes differ in the end
    rank = symbols.astype(np.int64) + strings - 1 if n else symbols.astype(np.int64)
    jump = following.copy()
    while n:
        ahead = np.where(jump >= 0, rank[np.maximum(jump, 0)], -1 - jump)
        key = rank << 32 | ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) + strings - 1
        if new.all():
            break
        jump = np.where(jump >= 0, jump[np.maximum(jump, 0)], jump)
    place = np.argsort(rank) if n else np.zeros(0, np.int64)
    behind = previous[place]
    before = np.concatenate([symbols[last], np.where(behind >= 0, symbols[np.maximum(behind, 0)], 0)]) if n else np.zeros(0, np.int64)
    return Transform(before, np.concatenate([np.full(strings, -1), place]), strings)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, class) of every suffix in the merged order, without terminators.

    Suffixes of one class agree in their first ``depth`` symbols; classes are numbered in
    order, so a class with two members or more is a repeated interval of the merged
    transform.
    """
    sizes = [len(s.before) for s in shards]
    total, ends = sum(sizes), sum(s.strings for s in shards)
    base = np.cumsum([0, *sizes[:-1]])
    before = np.concatenate([s.before for s in shards])
    narrow = before.max(initial=0) < 1 << 16
    before = before.astype(np.uint16 if narrow else np.int64)  # sixteen bits sort by radix
    # where shard k's suffixes stand in `before`, in the order of the interleave
    index = np.arange(total)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.int64), sizes)
    terminators = np.repeat(np.arange(len(shards), dtype=shard.dtype), [s.strings for s in shards])
    same = np.zeros(total, dtype=np.int64)  # class of each place of the interleave
    for _ in range(depth):
        symbol = before[index]
        order = np.argsort(symbol, kind="stable")[ends:]  # one 0 for each string start
        symbol, old = symbol[order], same[order]
        refined = np.concatenate([terminators, shard[order]])
        new = np.ones(total, dtype=bool)
        new[ends + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        settled = np.array_equal(refined, shard)
        shard, fresh = refined, np.cumsum(new) - 1
        if settled and np.array_equal(fresh, same):
            break  # the order and its classes stay for good
        same = fresh
        # the j-th place of shard k in the interleave is its j-th suffix
        index = np.empty(total, dtype=np.int64)
        index[np.argsort(shard, kind="stable")] = np.arange(total)
    where = np.concatenate([s.place for s in shards])[index]
    inner = where >= 0
    return where[inner], same[inner]
