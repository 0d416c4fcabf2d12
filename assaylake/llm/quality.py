"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk toward the pooled covariance and then toward
a multiple of the identity. A score is the logistic of the difference of the two log densities, with
Mahalanobis distances from Cholesky factors that are inverted once and cached in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docstats import COUNTS, FEATURES, doc_stats, features, matrix
from .shared import Scratch

THRESHOLD = 0.3
FOLDS = 5
SHARE_POOLED = 0.3
SHARE_IDENTITY = 0.02
#: Log-density differences are divided by this: shared statistics make the plain ones too sure.
TEMPERATURE = 4.0

#: Square roots spread the ratios that crowd near zero.
_ROOTS = [FEATURES.index(x) for x in ("symbol_ratio", "digit_ratio", "exclaim_ratio", "pipe_ratio", "dup_line_ratio", "repeat_ratio", "top_ratio", "upper_ratio")]


def transform(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, _ROOTS] = np.sqrt(x[:, _ROOTS])
    return x


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log constants of both classes; no classes: a constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    prior: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        z = np.clip((transform(x) - self.centre) / self.scale, -8.0, 8.0)
        log = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip((log[1] - log[0]) / TEMPERATURE, -60, 60)))


def moments(stats: DataFrame, label: str = "quality") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Row count, sum and sum of outer products of the transformed features of each class.

    Each task sums its rows; what reaches the driver has one number for each pair of features.
    """
    d = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for b in batches:
            m = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], axis=1) if b.num_rows else np.zeros((0, len(COUNTS)))
            x = np.hstack([np.ones((b.num_rows, 1)), transform(features(m))])
            y = b.column(len(COUNTS)).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        at = np.argwhere(np.ones_like(total))
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, i].astype(np.int32)) for i in range(3)), pa.array(total.ravel())], ["k", "i", "j", "v"])

    sums = stats.select(*COUNTS, label).mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((2, d, d))
    for r in sums.collect():
        total[r.k, r.i, r.j] = r.v
    return {k: (int(round(total[k, 0, 0])), total[k, 0, 1:], total[k, 1:, 1:]) for k in (0, 1)}


def fit(by_class: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """Without rows of both classes the score is 1 (only label 1, or no labels at all) or 0."""
    n = {k: by_class[k][0] for k in (0, 1)}
    d = len(FEATURES)
    if not n[0] or not n[1]:
        return Discriminant(*(np.zeros(0),) * 5, prior=0.0 if n[0] else 1.0)
    every = n[0] + n[1]
    centre = (by_class[0][1] + by_class[1][1]) / every
    spread = np.sqrt(np.maximum(np.diag(by_class[0][2] + by_class[1][2]) / every - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, own = [], []
    for k in (0, 1):
        m = by_class[k][1] / n[k]
        means.append((m - centre) / scale)
        own.append((by_class[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / every
    inverses, constants = [], []
    for k in (0, 1):
        s = (1 - SHARE_POOLED) * own[k] + SHARE_POOLED * pooled
        s = (1 - SHARE_IDENTITY) * s + SHARE_IDENTITY * max(np.trace(s) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((s + s.T) / 2)
        inverses.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / every) * TEMPERATURE - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(inverses), np.array(constants))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """One quality for each labelled document outside the held-out fold; 0 wins where rows disagree."""
    labels = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def learn(docs_stats: DataFrame, labels: DataFrame) -> Discriminant:
    return fit(moments(docs_stats.join(training_labels(labels), "doc_id")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts are scored as texts without words; a null doc_id has held_out null and is
    not learnt from; repeated rows are scored alike, and each counts in the fit if labelled.
    """
    stats = Scratch(docs.sparkSession).table(doc_stats(docs), "stats")
    model = learn(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(m)))], ["doc_id", "score"])

    out = T.StructType([T.StructField("doc_id", stats.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    scored = stats.mapInArrow(run, out)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    model = learn(Scratch(docs.sparkSession).table(doc_stats(docs), "stats"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(matrix(b.column(at)))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
