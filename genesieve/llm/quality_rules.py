"""Quality rules: counts of a text, and a hashed n-gram logistic regression beside them.

Word unigrams, word pairs and runs of four bytes are hashed into three tables of
weights.  A text's margin is the sum over tables of the mean weight of its n-grams; a
logistic curve fitted on rows kept out of the training turns it into a probability.

The regression is fitted on at most ``SAMPLE`` labelled rows, those with the least hash
of their id, and of these on as many as have ``ENTRIES`` different n-grams in all: a sample
bounded in rows and in bytes.  Every text is counted and scored whole.

Edge cases: a null or empty text has no words, so all counts are 0 and the base rule
fails it; labels with a null id or class, or seen with both classes, teach nothing; of rows
that share a labelled id the text with the least hash teaches.
Without both classes in the sample the base rule decides alone.  Repeated rows are
judged one by one.  No rows in, no rows out.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, U, column, mix, per_text, slices, written
from .quality_discriminant import clean_labels
from .text_statistics import Words, symbols

BITS = 16
SAMPLE = 3000
ENTRIES = 24_000_000  # eight bytes each
ROUNDS = 80
CHUNK = 1 << 19  # n-grams of the sample that one step of the training touches
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
THRESHOLD = 0.5  # of the calibrated probability of class 1


def ngrams(texts: Texts, words: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot, text) of every n-gram, for each of the three tables."""
    shift = U(64 - bits)
    one = (words.hash >> shift).astype(np.int64)
    together = words.owner[1:] == words.owner[:-1] if len(words.owner) else np.zeros(0, bool)
    pair = mix(words.hash[:-1] * U(0xC2B2AE3D27D4EB4F) ^ words.hash[1:])[together] if len(together) else np.zeros(0, U)
    two = (pair >> shift).astype(np.int64), words.owner[:-1][together] if len(together) else np.zeros(0, np.int64)
    d = texts.data.astype(np.uint32)
    if len(d) >= 4:
        four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        owner = np.repeat(np.arange(texts.n), texts.sizes)
        whole = owner[:-3] == owner[3:]
        four, owner = ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)[whole], owner[:-3][whole]
    else:
        four, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return [(one, words.owner), two, (four, owner)]


@dataclass(frozen=True)
class NgramModel:
    """Weights of three tables, intercept, and slope and offset of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, texts: Texts, words: Words) -> np.ndarray:
        margin = np.full(texts.n, self.intercept)
        for table, (slot, owner) in zip(self.weights, ngrams(texts, words), strict=True):
            count = per_text(owner, texts.n)
            margin += per_text(owner, texts.n, table[slot]) / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int = SAMPLE) -> DataFrame:
    """Hashed n-gram shares of at most ``limit`` labelled documents."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most `limit` ids and classes: a proven bound for the broadcast
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("print"), "text")

    schema = rows.selectExpr("doc_id", "label", "print", "array(0) AS slot", "array(float(0)) AS share").schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(column(batch, "text"))
            slot, share, owner = [], [], []
            for k, (s, o) in enumerate(ngrams(texts, Words(texts))):
                key, count = np.unique(o * (1 << BITS) + s, return_counts=True)
                who = key >> BITS
                slot.append((key & ((1 << BITS) - 1)) + (k << BITS))
                share.append(count / np.maximum(per_text(o, texts.n), 1)[who])
                owner.append(who)
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            at = np.concatenate([[0], np.cumsum(per_text(owner, texts.n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), column(batch, "label"), column(batch, "print"),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(slot)[order].astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(share)[order].astype(np.float32))),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(hashed, schema)


class Sample:
    """The bounded sample's n-gram shares, row after row, with products in small chunks."""

    def __init__(self, label: np.ndarray, bounds: np.ndarray, slot: np.ndarray, share: np.ndarray):
        self.label, self.slot, self.share = label.astype(float), slot, share
        self.owner = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(bounds))

    def _chunks(self) -> Iterator[slice]:
        return (slice(a, a + CHUNK) for a in range(0, len(self.slot), CHUNK))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.label))
        for c in self._chunks():
            out += np.bincount(self.owner[c], weights=weights[self.slot[c]] * self.share[c], minlength=len(out))
        return out

    def gradient(self, error: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        for c in self._chunks():
            out += np.bincount(self.slot[c], weights=error[self.owner[c]] * self.share[c], minlength=width)
        return out


def train(rows: Sample, rounds: int = ROUNDS) -> NgramModel | None:
    """Adagrad over all rows at once, and Platt scaling on every fourth row, which is left out."""
    y, width = rows.label, 3 << BITS
    kept = np.arange(len(y)) % 4 == 0
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        return None
    balance = np.where(kept, 0.0, np.where(y == 1, 0.5 / y[~kept].sum(), 0.5 / (1 - y[~kept]).sum()))
    w, b, seen = np.zeros(width), 0.0, np.full(width, 1e-10)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(b + rows.margins(w), -30, 30))) - y) * balance
        gradient = rows.gradient(error, width) + 1e-7 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
        b -= 0.5 * error.sum()
    margin, target = (b + rows.margins(w))[kept], y[kept]
    ones, zeros = target.sum(), (1 - target).sum()
    aim = np.where(target == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # keeps the slope finite
    scale = max(np.abs(margin).max(), 1e-9)
    a = np.array([1.0, 0.0])
    z = np.column_stack([margin / scale, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        a = a - np.linalg.solve(hessian, z.T @ (p - aim) + 1e-6 * a)
        a = np.clip(a, -100, 100)
    return NgramModel(w.reshape(3, -1), b, float(a[0] / scale), float(a[1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label_id: str = "doc_id", label: str = "quality", limit: int = SAMPLE) -> NgramModel | None:
    """The model from the bounded sample, in order of ids, so that reruns agree."""
    rows = written(sample(docs, clean_labels(labels, label_id, label), doc_id, text, limit), "sample")
    sizes = rows.select("doc_id", "print", F.size("slot").alias("n"), F.xxhash64("doc_id").alias("turn")).distinct()
    kept: dict[int, int] = {}
    total = 0
    for r in sorted(sizes.collect(), key=lambda r: (r["turn"], r["doc_id"], r["print"])):  # at most `limit` ids
        if r["doc_id"] not in kept and total + r["n"] <= ENTRIES:
            kept[r["doc_id"]] = r["print"]
            total += r["n"]
    if not kept:
        return None
    chosen = rows.sparkSession.createDataFrame(list(kept.items()), "doc_id long, print long")
    found = rows.join(F.broadcast(chosen), ["doc_id", "print"]).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    labels_, sizes_ = found["label"].to_numpy(), pc.list_value_length(found["slot"]).to_numpy()
    slot, share = (pc.list_flatten(found[c]).to_numpy() for c in ("slot", "share"))
    del found
    return train(Sample(labels_, np.concatenate([[0], np.cumsum(sizes_)]), slot, share))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame, model: NgramModel | None, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, whole_rows: bool = False,
) -> DataFrame:
    """Counts, the base rule, the probability of class 1 and the verdict for every document.

    With ``whole_rows`` the document itself goes along as one struct column ``row``, so
    that no column of it can clash with a count.
    """
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("row") if whole_rows else F.col(text).cast("string").alias("text"),
    )
    carried = ["doc_id", "row"] if whole_rows else ["doc_id"]
    at = docs.columns.index(text)
    out = source.select(
        *carried, *[F.lit(0).cast("bigint").alias(c) for c in COUNTS], F.lit(0.0).alias("probability")
    ).schema

    def texts_of(batch: pa.RecordBatch) -> pa.Array:
        return column(batch, "row").field(at) if whole_rows else column(batch, "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, texts_of):
            texts = Texts(texts_of(batch))
            words = Words(texts)
            made = (words.counts(), words.code_points(), symbols(texts), words.lines()[1], words.repeated())
            chance = model.probability(texts, words) if model else np.ones(texts.n)
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in carried] + [pa.array(m.astype(np.int64)) for m in made] + [pa.array(chance)],
                names=out.names,
            )

    judged = source.mapInArrow(score, out).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label_id: str = "doc_id", label: str = "quality", limit: int = SAMPLE) -> DataFrame:
    """Fit on the bounded sample and judge every document."""
    return judge(docs, fit(docs, labels, doc_id, text, label_id, label, limit), doc_id, text)


# The counts and the base rule; the regression's probability has no SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
v AS (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM v),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(0, 3) r(k) WHERE n > 1 GROUP BY row),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (row) LEFT JOIN dup USING (row) LEFT JOIN covered USING (row))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c
"""
