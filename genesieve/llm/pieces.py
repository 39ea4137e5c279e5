"""SentencePiece ids of whole texts, and texts of ids, by a table of distinct chunks.

Pieces of the vocabulary hold their whitespace markers in front, so no piece crosses from a
character to a marker behind it.  A text with its markers therefore falls into chunks, each a
run of markers and the characters up to the next one, that are segmented apart.  Every
different chunk of a slice of texts is segmented once, by the library, or found in the table
that the worker keeps of earlier ones; the table is bounded in chunks and bytes.  Ids are
joined back by the position of the chunks, all at once.

Decoding looks every id's bytes up in a table of pieces and joins them by position.  Ids that
give no valid UTF-8, or hold control ids inside, go to the library one text at a time.

A model whose pieces cross markers, or whose normaliser rewrites characters, is not cut: its
texts go to the library whole.

Edge cases: a null or empty text has no chunk, so only the end id; ids that are null give a
null text and no ids an empty one; texts of any length and rows that repeat are treated
alike; no rows in, no rows out.  Other columns go along untouched, but for one that has the
new column's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, column, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
TABLE_CHUNKS = 400_000
TABLE_BYTES = 24 << 20
SLICE_IDS = 1 << 19


class Pieces:
    """A model with the tables that the worker keeps for it."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = np.array([not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)) for i in range(len(names))])
        crossing = any(MARK in name.lstrip(MARK) for name, p in zip(names, plain, strict=True) if p)
        self.apart = not crossing and lib.decode(lib.encode("  ﬁ 　 Á")) == "  ﬁ 　 Á"
        self.end, self.mark = lib.eos_id(), lib.piece_to_id(MARK)
        surface = [
            bytes([int(n[3:5], 16)]) if lib.is_byte(i) else n.replace(MARK, " ").encode() if plain[i] else b""
            for i, n in enumerate(names)
        ]
        self._size = np.array([len(s) for s in surface], dtype=np.int64)
        self._from = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(surface), dtype=np.uint8)
        # ids that the tables may decode at the start of a text, and inside it
        self._inner = plain | np.array([lib.is_byte(i) for i in range(len(names))])
        self._first = plain & np.array([n.startswith(MARK) for n in names])
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[bytes | None, int] = {}
        self._held = 0
        self._ids = np.zeros(1 << 16, dtype=np.int32)
        self._at = np.zeros(1 << 14, dtype=np.int64)  # chunk c has ids _at[c] .. _at[c + 1]
        self._learn([None, b""], [[self.end], [self.mark]])  # no text is the first one

    def _learn(self, chunks: list[bytes | None], ids: list[list[int]]) -> None:
        known = len(self._slot)
        base = int(self._at[known])
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
        while base + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while known + len(chunks) >= len(self._at):
            self._at = np.concatenate([self._at, np.zeros_like(self._at)])
        self._ids[base : base + len(flat)] = flat
        self._at[known + 1 : known + len(chunks) + 1] = base + np.cumsum([len(i) for i in ids])
        self._slot.update(zip(chunks, range(known, known + len(chunks)), strict=True))
        self._held += sum(len(c or b"") for c in chunks) + 4 * len(flat)

    def chunks(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of what is encoded of every chunk: all but its first marker.

        The library puts that marker in front again, as it does before a text's first chunk.
        """
        space = texts.data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        heads = texts.bounds[:-1][texts.sizes > 0]
        begin[heads] = True  # a space in front joins the marker that every text gets
        start = np.flatnonzero(begin)
        owner = texts.owner(start)
        end = np.append(start[1:], len(texts.data))
        skip = np.ones(len(start), dtype=np.int64)
        skip[np.searchsorted(start, heads)] = 0
        return start + skip, end, owner

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids with end ids, and the bounds of each text's ids among them."""
        raw = texts.data.tobytes()
        if not self.apart:
            whole = [raw[a:b].decode() for a, b in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True)]
            found = [self.library.encode(t) + [self.end] for t in whole]
            return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
        if len(self._slot) > TABLE_CHUNKS or self._held > TABLE_BYTES:
            self._clear()
        start, end, owner = self.chunks(texts)
        key, second = texts.span_hash(start, end), texts.span_hash(start, end, salt=1)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        if (second != second[first][back]).any():
            _, first, back = np.unique(np.column_stack([key, second]), axis=0, return_index=True, return_inverse=True)
        distinct = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        slots = np.fromiter(map(self._slot.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self._slot) + np.arange(len(new))
            chunks = [distinct[i] for i in new.tolist()]
            self._learn(chunks, self.library.encode([c.decode() for c in chunks], num_threads=1))
        # the end id is one more chunk behind each text's own
        count = np.bincount(owner, minlength=texts.n)[: texts.n] if texts.n else np.zeros(0, np.int64)
        slot = np.zeros(len(start) + texts.n, dtype=np.int64)
        slot[np.arange(len(start)) + owner] = slots[back.ravel()]
        length = self._at[slot + 1] - self._at[slot]
        place = np.concatenate([[0], np.cumsum(length)])
        ids = self._ids[np.repeat(self._at[slot] - place[:-1], length) + np.arange(place[-1])]
        return ids, place[np.concatenate([[0], np.cumsum(count + 1)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and the bounds of each text among them."""
        n = len(bounds) - 1
        if not n or not len(ids):
            return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        known = (ids >= 0) & (ids < len(self._size))
        ids = np.where(known, ids, 0)
        size = self._size[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        data = self._bytes[np.repeat(self._from[ids] - place[:-1], size) + np.arange(place[-1])]
        at = place[bounds]
        full = np.diff(bounds) > 0
        head = ids[np.minimum(bounds[:-1], len(ids) - 1)]
        last = np.zeros(len(ids), dtype=bool)
        last[bounds[1:][full] - 1] = True
        sound = known & (self._inner[ids] | (last & (ids == self.end)))
        wrong = np.concatenate([[0], np.cumsum(~sound)])
        bad = wrong[bounds[1:]] > wrong[bounds[:-1]]
        lone = (np.diff(bounds) == 1) & (head == self.end)
        odd = full & ~lone & (bad | ~self._first[head] | (not self.apart))
        # a text starts with one marker that is not its own
        keep = np.ones(len(data), dtype=bool)
        keep[at[:-1][full & ~lone & (at[:-1] < at[1:])]] = False
        out = data[keep]
        removed = np.concatenate([[0], np.cumsum(~keep)])
        cut = at - removed[at]
        starts = cut[:-1][cut[:-1] < cut[1:]]
        whole = out.tobytes()
        broken = bool(((out[starts] & 0xC0) == 0x80).any())
        if not broken:
            try:
                whole.decode()
            except UnicodeDecodeError:
                broken = True
        if not broken and not odd.any():
            return out, cut
        texts = []
        for i in range(n):
            text = whole[cut[i] : cut[i + 1]]
            if not odd[i]:
                try:
                    text.decode()
                    texts.append(text)
                    continue
                except UnicodeDecodeError:
                    pass
            if not known[bounds[i] : bounds[i + 1]].all():
                raise ValueError("an id is outside the vocabulary")
            texts.append(self.library.decode(ids[bounds[i] : bounds[i + 1]].tolist()).encode())
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


@lru_cache(maxsize=2)
def pieces(model: str = MODEL) -> Pieces:
    """One per worker process; the file is read where the task runs."""
    import public_tokenizers

    return Pieces(public_tokenizers.path(model))


def _mapped(df: DataFrame, read: str, name: str, kind: str, convert, keep: bool) -> DataFrame:
    """``df`` with one column made from another in Arrow slices.

    The column that is read stands beside a struct of all others, so no name can clash.
    """
    rest = [c for c in df.columns if c not in (name, read)]
    others = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    rows = df.select(F.col(read).alias("read"), others.alias("row"))
    sent = ["row", "read"] if keep else ["row"]
    schema = rows.selectExpr(*sent, f"CAST(NULL AS {kind}) AS made").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in convert(batch):
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in sent), made], names=[*sent, "made"])

    out = rows.mapInArrow(run, schema)
    back = [F.col("read").alias(c) if c == read else F.col("row")[c].alias(c) for c in df.columns if c != name and (keep or c != read)]
    return out.select(*back, F.col("made").alias(name))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, keep: bool = True) -> DataFrame:
    """``docs`` with a column of ids, closed by the end id; without the texts unless ``keep``."""
    def convert(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for part in slices(iter([batch]), "read"):
            texts = pc.replace_substring(column(part, "read").cast(pa.string()), MARK, " ")  # both are markers
            found, bounds = pieces(model).encode(Texts(texts))
            yield part, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))

    return _mapped(docs.withColumn(text, F.col(text).cast("string")), text, ids, "array<int>", convert, keep)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL, keep: bool = True) -> DataFrame:
    """``docs`` with a column of texts decoded from ids."""
    def convert(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        lists = column(batch, "read")
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        first = 0
        while first < batch.num_rows:  # about a slice of text at once
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_IDS, side="right")) - 1)
            made, cut = pieces(model).decode(flat[at[first] : at[last]], at[first : last + 1] - at[first])
            known = np.packbits(valid[first:last], bitorder="little").tobytes()
            strings = pa.Array.from_buffers(pa.large_string(), last - first, [pa.py_buffer(x) for x in (known, cut.tobytes(), made.tobytes())])
            yield batch.slice(first, last - first), strings.cast(pa.string())
            first = last

    return _mapped(docs, ids, text, "string", convert, keep)


def digest(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Counts and hashes of encoded and decoded documents."""
    return coded.select(
        F.col(doc_id).alias("doc_id"), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(text, 256).alias("decoded_sha256"),
    )
