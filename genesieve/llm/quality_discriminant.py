"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then
towards a multiple of the identity.  A document's score is the logistic function of the
difference of its two log densities, each from a Mahalanobis distance solved with the
Cholesky factor that was computed once per class.

Edge cases: a null or empty text has the statistics of an empty text and is scored; a
null id is kept and treated as the empty string in the fold rule; labels with a null
id or class, or one seen with both classes, teach nothing; labels repeated alike count
once; repeated rows are scored one by one.  Without rows of both classes every score is the share of
class 1 in the training rows, or 0.5.  No rows in, no rows out.  Only the named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, column, slices, written
from .text_statistics import FEATURES, features

POOLED = 0.2  # share of the pooled covariance in a class covariance
RIDGE = 0.02  # share of the mean variance on the diagonal
TEMPERATURE = 4.0  # the features are dependent and not normal; densities overstate
THRESHOLD = 0.7


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants, prior log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def score(self, x: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * (z**2).sum(axis=1) - 0.5 * self.log_dets[k])
        margin = (density[1] - density[0]) / temperature + self.prior
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def held_out(doc_id: str, remainder: int = 2, folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == remainder


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and an array ``x`` of transformed statistics, one row per document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = source.select("doc_id", F.array(F.lit(0.0)).alias("x")).schema
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(Texts(column(batch, "text")))
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), rows], names=["doc_id", "x"])

    return source.mapInArrow(measure, schema)


def clean_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """One row per labelled document; ids labelled both ways teach nothing."""
    return (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most").select("doc_id", "label")
    )


def fit(rows: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant | float:
    """From ``label`` and ``x``: the discriminant, or a constant score where a class is missing.

    Counts, sums and sums of products per class are one aggregate of Spark; two rows
    come back.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [F.col("x")[i] for i in range(d)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(c) for c in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"),
    )
    found = {r["label"]: r for r in sums.collect()}
    total = sum(r["n"] for r in found.values())
    if set(found) != {0, 1}:
        return 1.0 * (1 in found) if total else 0.5
    means, scatter, counts = [], [], []
    for k in (0, 1):
        n, s = found[k]["n"], np.array(found[k]["s"])
        m = np.zeros((d, d))
        for (i, j), value in zip(pairs, found[k]["p"], strict=True):
            m[i, j] = m[j, i] = value
        means.append(s / n)
        scatter.append(m - np.outer(s, s) / n)
        counts.append(n)
    common = (scatter[0] + scatter[1]) / total
    factors, dets = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / counts[k] + pooled * common
        scale = max(np.trace(own) / d, 1e-9)
        lower = np.linalg.cholesky((1 - ridge) * own + ridge * scale * np.eye(d))
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(dets), float(np.log(counts[1] / counts[0])))


def apply(measured: DataFrame, model: Discriminant | float) -> DataFrame:
    """``doc_id`` and ``score`` for rows of ``statistics``."""
    if isinstance(model, float):
        return measured.select("doc_id", F.lit(model).alias("score"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = model.score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(score)], names=["doc_id", "score"])

    return measured.mapInArrow(rate, measured.select("doc_id", F.lit(0.0).alias("score")).schema)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD,
) -> DataFrame:
    """Score every document; learn from labelled rows outside the held-out fold.

    Texts are read once: their statistics are written to the shared folder and serve
    the fit and the scores.  Only statistics, never texts, meet the labels in a join.
    """
    measured = written(statistics(docs, doc_id, text), "statistics")
    known = clean_labels(labels, label_id, label)
    training = measured.where(~held_out("doc_id")).join(known, "doc_id")
    scored = apply(measured, fit(training))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
