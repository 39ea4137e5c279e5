"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words are counted over all texts.  Every word of the vocabulary then generates its edits, one
character deleted or replaced, as hashes that follow from the word's own in one step, and
probes them against a broadcast Bloom filter of the vocabulary that has a shard for each
length.  An inserted character is a deletion from the longer word, and of two words that differ
by a replacement the one with the smaller character generates the other, so each pair is met
once.  Only edits that the filter may hold are shuffled, as two 64-bit hashes, to a join with
the vocabulary; what meets is compared as words, which removes every false positive.

The filter takes 16 bits for each word.  Up to ``filter_bits`` it is broadcast whole; a larger
vocabulary is dealt by hash into as many parts as that bound asks for, whose filters are
broadcast and probed one after the other, so the broadcast never grows beyond the bound.

A word's form is its near word with the most occurrences, if it has ``ratio`` times as many as
the word; forms are followed by pointer jumping, each step of which at least squares the ratio.

Edge cases: null and empty texts have no words; a null id reads as an empty string where words
lose a character; words of any length are probed in bounded chunks; repeated rows count each;
of near words with equally many occurrences the first in code-point order is the form; no rows
in, no rows out.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Texts, U, column, mix, parts_for, slices, written
from .source_divergence import distinct_spans

MIN_CHARS = 7
MIN_OCCURRENCES = 2
RATIO = 10
LOSES = 31  # a word whose hash this divides loses a character
FILTER_BITS = 1 << 27
LONGEST = 48  # longer words share one shard
CHUNK = 1 << 19  # edits that are probed at once
PROBE_WORDS = 20_000  # words that one task probes: few bytes, many edits
_POSITION, _CODE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of UTF-8 bytes: which bytes are one, their code points, and letters before each byte.

    A-Z are lowered; U+00C0 to U+00FF are a byte C3 and one behind it.
    """
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] |= 32
    lead = data == 0xC3
    behind = np.zeros(len(data), dtype=bool)
    behind[1:] = lead[:-1]
    letter = (lower >= 97) & (lower <= 122) | lead | behind
    codes = np.where(behind, data | 0x40, lower)[~lead]
    before = np.concatenate([[0], np.cumsum(~lead)])
    return letter, codes, before


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, loses: int | None = LOSES) -> DataFrame:
    """``word, n`` over all texts; n is at least 1 and in total all occurrences.

    A word in a document whose ``crc32("<doc_id>:<word>")`` is divisible by ``loses`` loses the
    character at that hash modulo its length; with None words stay as they are.
    """
    read = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(column(batch, "text"))
            letter, _, before = latin(texts.data)
            start, end, owner = texts.runs(letter)
            long = before[end] - before[start] >= min_chars
            start, end, owner = start[long], end[long], owner[long]
            if not len(start):
                continue
            texts.data = np.where((texts.data >= 65) & (texts.data <= 90), texts.data | 32, texts.data)
            first, word = distinct_spans(texts, start, end)
            raw = texts.data.tobytes()
            words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            pair, times = np.unique(owner * len(first) + word, return_counts=True)
            doc, word = pair // len(first), pair % len(first)
            whole = np.zeros(len(first), dtype=np.int64)
            changed: Counter[str] = Counter()
            if loses:
                salts = [zlib.crc32(f"{i}:".encode()) for i in column(batch, "doc_id").to_pylist()]
                crc = np.fromiter((zlib.crc32(words[w], salts[d]) for d, w in zip(doc.tolist(), word.tolist(), strict=True)), dtype=np.int64, count=len(doc))
                hit = crc % loses == 0
                for w, c, n in zip(word[hit].tolist(), crc[hit].tolist(), times[hit].tolist(), strict=True):
                    full = words[w].decode()
                    if len(full) > min_chars:
                        at = c % len(full)
                        changed[full[:at] + full[at + 1 :]] += n
                word, times = word[~hit], times[~hit]
            np.add.at(whole, word, times)
            some = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i].decode() for i in some.tolist()] + list(changed), pa.string()),
                 pa.array(np.concatenate([whole[some], np.fromiter(changed.values(), np.int64, len(changed))]))],
                names=["word", "n"],
            )

    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(position: np.ndarray, code: np.ndarray, salt: int) -> np.ndarray:
    """A random number for every character at a position."""
    return mix(position.astype(U) * _POSITION + code.astype(U) * _CODE + U(salt))


class Edits:
    """Hashes of words, and of what is left of them after an edit.

    A word's hash is the exclusive or of its characters' numbers, so an edit changes it in one
    step: a replacement exchanges a number, a deletion takes the numbers behind it one place
    further to the front.
    """

    def __init__(self, words: pa.Array, salt: int):
        texts = Texts(words)
        _, self.code, before = latin(texts.data)
        self.bounds = before[texts.bounds]
        self.size = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(texts.n), self.size)
        self.position = np.arange(len(self.code)) - self.bounds[:-1][self.owner]
        self.salt = salt * 0x632BE59BD9B4E019 % (1 << 64)
        own = _letters(self.position, self.code, self.salt)
        moved = _letters(self.position - 1, self.code, self.salt)  # never read at position 0
        self.own = own
        zero = np.zeros(1, U)
        self.upto = np.concatenate([zero, np.bitwise_xor.accumulate(own)]) if len(own) else zero
        self.after = np.concatenate([zero, np.bitwise_xor.accumulate(moved)]) if len(own) else zero
        self.raw = self.upto[self.bounds[1:]] ^ self.upto[self.bounds[:-1]]

    def closed(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(raw + size.astype(U) * U(0xD1B54A32D192ED03))

    def words(self) -> np.ndarray:
        return self.closed(self.raw, self.size)

    def deleted(self, at: np.ndarray) -> np.ndarray:
        """The word of each character without it."""
        w = self.owner[at]
        start, end = self.bounds[w], self.bounds[w + 1]
        raw = self.upto[at] ^ self.upto[start] ^ self.after[end] ^ self.after[at + 1]
        return self.closed(raw, self.size[w] - 1)

    def replaced(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The word of each character with another in its place."""
        w = self.owner[at]
        raw = self.raw[w] ^ self.own[at] ^ _letters(self.position[at], code, self.salt)
        return self.closed(raw, self.size[w])


def _shard(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, LONGEST)


def keyed(words: DataFrame) -> DataFrame:
    """``word, n, size, k1, k2`` from ``word, n``."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            made = [Edits(column(batch, "word"), salt) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "word"), column(batch, "n"), pa.array(made[0].size.astype(np.int64)), *[pa.array(m.words().view(np.int64)) for m in made]],
                names=["word", "n", "size", "k1", "k2"],
            )

    return words.mapInArrow(hashed, "word string, n long, size long, k1 long, k2 long")


def probes(batch: pa.Array, alphabet: np.ndarray, min_chars: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Edits]]:
    """Edits of words in chunks: character, new code (0 for none), length and hash of the edited word."""
    made = Edits(batch, 1)
    # of equal characters in a row only the first one's deletion is new
    again = np.zeros(len(made.code), dtype=bool)
    again[1:] = (made.code[1:] == made.code[:-1]) & (made.position[1:] > 0)
    shorter = np.flatnonzero(~again & (made.size[made.owner] > min_chars))
    for a in range(0, len(shorter), CHUNK):
        at = shorter[a : a + CHUNK]
        yield from _kept(made, at, np.zeros(len(at), np.int64), made.size[made.owner[at]] - 1, made.deleted(at), part, parts)
    step = max(1, CHUNK // max(len(alphabet), 1))
    for a in range(0, len(made.code), step):
        at = np.arange(a, min(a + step, len(made.code)))
        # letters are sorted, so each character is replaced by the ones from its place on
        place = np.searchsorted(alphabet, made.code[at], side="right")
        count = len(alphabet) - place
        at = np.repeat(at, count)
        code = alphabet[np.arange(len(at)) + np.repeat(place - (np.cumsum(count) - count), count)].astype(np.int64)
        yield from _kept(made, at, code, made.size[made.owner[at]], made.replaced(at, code), part, parts)


def _kept(made: Edits, at: np.ndarray, code: np.ndarray, size: np.ndarray, key: np.ndarray, part: int, parts: int):
    if parts > 1:
        own = np.flatnonzero(key % U(parts) == U(part))
        at, code, size, key = at[own], code[own], size[own], key[own]
    if len(at):
        yield at, code, size, key, made


def candidates(vocabulary: DataFrame, alphabet: np.ndarray, min_chars: int, filter_bits: int) -> list[DataFrame]:
    """``x1, x2, y1, y2``: words and edits of them that a filter of the vocabulary may hold."""
    spark = vocabulary.sparkSession
    sizes = {r.shard: r["count"] for r in vocabulary.groupBy(F.least("size", F.lit(LONGEST)).alias("shard")).count().collect()}
    parts = max(1, -(-sum(sizes.values()) * bloom.KEY_BITS // filter_bits))
    layout = bloom.Layout.of({s: -(-n // parts) for s, n in sizes.items()})
    found = []
    for part in range(parts):
        own = vocabulary.where(F.expr(f"CAST(pmod(CAST(k1 AS DECIMAL(20,0)) + IF(k1 < 0, 18446744073709551616, 0), {parts}) AS INT) = {part}")) if parts > 1 else vocabulary
        filled = bloom.build(own.select(F.least("size", F.lit(LONGEST)).alias("shard"), F.col("k1").alias("key")), layout)
        shared = spark.sparkContext.broadcast(filled)

        def probe(batches: Iterator[pa.RecordBatch], part: int = part, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "word", 1 << 18):
                words = column(batch, "word")
                second = None
                for at, code, size, key, first in probes(words, alphabet, min_chars, part, parts):
                    hit = bloom.holds(layout, shared.value, _shard(size), key)
                    if not len(hit):
                        continue
                    second = second or Edits(words, 2)
                    at, code, key = at[hit], code[hit], key[hit]
                    other = np.where(code == 0, second.deleted(at), second.replaced(at, code))
                    who = first.owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (first.words()[who], second.words()[who], key, other)],
                        names=["x1", "x2", "y1", "y2"],
                    )

        dealt = vocabulary.select("word").repartition(parts_for(sum(sizes.values()), PROBE_WORDS))
        found.append(written(dealt.mapInArrow(probe, "x1 long, x2 long, y1 long, y2 long"), "candidates"))
        shared.unpersist()
    return found


def near_pairs(vocabulary: DataFrame, min_chars: int = MIN_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``word, near, n``: every two words of ``word, n, size, k1, k2`` one edit apart, both ways."""
    codes = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().select(F.ascii("c").alias("code"))
    # at most 90 letters are possible
    alphabet = np.array(sorted(r.code for r in codes.where("code > 0").collect()), dtype=np.int64)
    tables = candidates(vocabulary, alphabet, min_chars, filter_bits)
    met = tables[0]
    for t in tables[1:]:
        met = met.unionByName(t)
    x = vocabulary.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("word").alias("x"), F.col("n").alias("xn"))
    y = vocabulary.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("word").alias("y"), F.col("n").alias("yn"))
    pairs = met.join(y, ["y1", "y2"]).select("x1", "x2", "y", "yn").join(x, ["x1", "x2"])
    pairs = pairs.where(F.levenshtein("x", "y", 1) == 1).select("x", "xn", "y", "yn").distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("yn").alias("n")),
        F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("xn").alias("n")),
    )).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where each word's ``form`` leads in the end."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        at = written(step, "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    min_occurrences: int = MIN_OCCURRENCES, ratio: int = RATIO, loses: int | None = LOSES, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    counted = word_counts(docs, doc_id, text, min_chars, loses).where(F.col("n") >= min_occurrences)
    vocabulary = written(keyed(counted), "vocabulary")
    near = near_pairs(vocabulary, min_chars, filter_bits).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    )
    judged = vocabulary.select("word", "n").join(near, "word", "left")
    most = -F.col("best.less")
    enough = most >= ratio * F.col("n")
    judged = written(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, most).alias("form_n"),
    ), "forms")
    found = roots(judged.where("form IS NOT NULL"))
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
