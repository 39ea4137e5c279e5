"""Whole texts as byte arrays: slices of Arrow batches, words, and hashes.

Tasks work on slices of a few megabytes, so their memory follows the slice (or one
longer document), never the partition.  A null text counts as empty everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ..session import reachable, scratch_path  # noqa: F401

SLICE_BYTES = 2 << 20
U = np.uint64
def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# one odd multiplier for block numbers, one for lengths, one for hashes that differ by salt
_BLOCK, _LENGTH, _SALT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD1B54A32D192ED03)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
HASHED_BLOCKS = 1 << 21  # blocks of eight bytes that are hashed at once


class Texts:
    """UTF-8 texts side by side: text i is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, array: pa.Array):
        if array.null_count:
            array = array.fill_null("")
        kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
        bounds = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, kind)
        raw = array.buffers()[2] if len(array) else None
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = whole[bounds[0] : bounds[-1]]
        self.bounds = bounds.astype(np.int64) - int(bounds[0])
        self.n = len(array)
        self._eight: np.ndarray | None = None

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the bytes [start, end): equal bytes give equal hashes anywhere.

        Every block of eight bytes is mixed with its number, then blocks are summed and
        mixed with the length, so no arithmetic relation between texts survives.  Another
        salt gives an independent hash.
        """
        if self._eight is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        length = end - start
        count = np.maximum((length + 7) >> 3, 1)
        out = np.empty(len(start), dtype=U)
        reach = np.cumsum(count)
        first = 0
        while first < len(start):
            before = int(reach[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(reach, before + HASHED_BLOCKS, side="right")))
            out[first:last] = self._hash(start[first:last], end[first:last], count[first:last], salt)
            first = last
        return mix(out + length.view(U) * _LENGTH)

    def _hash(self, start: np.ndarray, end: np.ndarray, count: np.ndarray, salt: int) -> np.ndarray:
        at = np.cumsum(count) - count
        which = np.repeat(np.arange(len(start)), count)
        number = np.arange(len(which)) - at[which]
        byte = start[which] + 8 * number
        block = self._eight[byte] & _LOW_BYTES[np.minimum(end[which] - byte, 8)]
        key = mix((number.view(U) + U(1)) * _BLOCK + U(salt) * _SALT)
        return np.add.reduceat(mix(block ^ key), at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every word: runs without space and bytes 9 to 13."""
        return self.runs(~((self.data == 32) | ((self.data >= 9) & (self.data <= 13))))

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every longest run of bytes that are members."""
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = member
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        cuts = np.unique(cuts[inside[cuts].astype(bool) & inside[cuts + 1].astype(bool)])
        if len(cuts):  # a run ends where its text does
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        return start, end, self.owner(start)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, side="right") - 1


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes in a row, a power of two, by doubling."""
    made, reach = data.astype(U), 1
    while reach < width:
        made = made[:-reach] * _SALT + made[reach:]
        made ^= made >> U(29)
        reach *= 2
    return mix(made[: max(0, len(data) - width + 1)])


class ModularHash:
    """Polynomial hashes modulo the prime 2**61 - 1, which can leave out a part of a span.

    Two different texts of n bytes share a hash for at most n of all 2**61 bases.
    """

    PRIME = U((1 << 61) - 1)
    BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
    _forward: np.ndarray | None = None
    _backward: np.ndarray | None = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        term = self.times(mix(data.astype(U) + U(1)) & self.PRIME, self.powers(n)) if n else np.zeros(0, U)
        low, high = np.zeros(n + 1, U), np.zeros(n + 1, U)
        np.cumsum(term & U((1 << 30) - 1), out=low[1:])
        np.cumsum(term >> U(30), out=high[1:])
        self.prefix = self.plus(self.times(self.reduce(high), np.full(n + 1, 1 << 30, U)), self.reduce(low))
        self.inverse = self.powers(n + 1, back=True)

    @classmethod
    def reduce(cls, x: np.ndarray) -> np.ndarray:
        x = (x & cls.PRIME) + (x >> U(61))
        return np.where(x >= cls.PRIME, x - cls.PRIME, x)

    @classmethod
    def plus(cls, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return cls.reduce(a + b)

    @classmethod
    def minus(cls, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return cls.reduce(a + (cls.PRIME - b))

    @classmethod
    def times(cls, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Products modulo the prime, from halves of 32 and 29 bits."""
        half, some = U(32), U((1 << 32) - 1)
        al, ah, bl, bh = a & some, a >> half, b & some, b >> half
        cross = al * bh + ah * bl  # under 2**62
        low = al * bl
        # 2**61 is 1, so 2**64 is 8, and cross * 2**32 has its upper bits wrapped round
        high = ah * bh * U(8)
        middle = (cross >> U(29)) + ((cross & U((1 << 29) - 1)) << half)
        return cls.reduce(cls.reduce(low) + cls.reduce(high) + cls.reduce(middle))

    @classmethod
    def powers(cls, n: int, back: bool = False) -> np.ndarray:
        prime = (1 << 61) - 1
        known = cls._backward if back else cls._forward
        if known is None or len(known) < n:
            base = pow(cls.BASE, -1, prime) if back else cls.BASE
            known = np.ones(1, U)
            while len(known) < max(n, 1 << 12):  # doubling: the next half is this one times a power
                known = np.concatenate([known, cls.times(known, np.full(len(known), pow(base, len(known), prime), U))])
            if n <= 2 * SLICE_BYTES:
                if back:
                    cls._backward = known
                else:
                    cls._forward = known
        return known[:n]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = self.times(self.minus(self.prefix[end], self.prefix[start]), self.inverse[start])
        return mix(value + (end - start).astype(U) * _LENGTH)

    def without(self, start: np.ndarray, end: np.ndarray, cut: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Hashes of bytes [start, end) without the spans [cut, upto) inside them."""
        p, shift = self.prefix, self.inverse[start]
        left = self.times(self.minus(p[cut], p[start]), shift)
        right = self.times(self.minus(p[end], p[upto]), self.times(shift, self.inverse[upto - cut]))
        return mix(self.plus(left, right) + (end - start - (upto - cut)).astype(U) * _LENGTH)


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n)[:n] if n else np.zeros(0)


def slices(
    batches: Iterator[pa.RecordBatch], text: str | Callable[[pa.RecordBatch], pa.Array], limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have ``limit`` bytes together, or are one text."""
    for batch in batches:
        texts = column(batch, text) if isinstance(text, str) else text(batch)
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def distinct_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where each new key begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """``df`` as Parquet; its shuffle files go when the job is done, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; its lineage ends there."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path, *partition_by)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator, each dropped as soon as its last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        write(df, path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def parts_for(rows: int, rows_per_part: int) -> int:
    """How many parts of bounded size so many rows need; it grows with the rows."""
    return max(1, math.ceil(rows / rows_per_part))
