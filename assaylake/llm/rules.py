"""Quality rules: gradient-boosted trees over document statistics, as flat numpy node arrays.

Trees are grown on histograms of a bounded labelled sample. Chosen features are monotone: more
symbols, repeats or duplicate lines never raise a score. Scoring walks all rows down one level of a
tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docstats import COUNTS, FEATURES, doc_stats, features
from .quality import training_labels
from .shared import Scratch

#: Most labelled rows that the trees are fitted on; the smallest hashes of doc_id are taken.
SAMPLE_ROWS = 40_000
KEEP_FROM = 0.3
TREES, DEPTH, RATE, BINS, RIDGE, LEAF_ROWS = 60, 3, 0.15, 64, 1.0, 10
#: -1: the score may only fall as the feature rises.
MONOTONE = {"symbol_ratio": -1, "exclaim_ratio": -1, "pipe_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "top_ratio": -1}
_SIGNS = np.array([MONOTONE.get(x, 0) for x in FEATURES])


@dataclass
class Forest:
    """Node arrays of all trees, one after the other; a leaf points at itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray = _SIGNS, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted logistic trees; rows of one class only, or none, give a constant score."""
    n, d = x.shape
    nodes: list[list[float]] = []
    roots: list[int] = []
    p = np.clip(y.mean() if n else 1.0, 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1) if n else np.zeros((0, d), int)
    margin = np.full(n, base)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        weight = lambda gs, hs: np.clip(-gs / (hs + RIDGE), low, high)
        worth = lambda gs, hs, w: -(gs * w + 0.5 * (hs + RIDGE) * w * w)
        own = weight(total_g, total_h)
        nodes.append([0, 0.0, here, here, RATE * float(own)])
        if level == depth or len(rows) < 2 * LEAF_ROWS:
            return here
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(d):
            if not len(cuts[j]):
                continue
            of, k = binned[rows, j], len(cuts[j]) + 1
            gs, hs, cs = (np.cumsum(np.bincount(of, weights=v, minlength=k))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            wl, wr = weight(gs, hs), weight(total_g - gs, total_h - hs)
            gain = worth(gs, hs, wl) + worth(total_g - gs, total_h - hs, wr) - worth(total_g, total_h, own)
            gain[(cs < LEAF_ROWS) | (len(rows) - cs < LEAF_ROWS) | (signs[j] * (wr - wl) < 0)] = -np.inf
            if gain[at := int(np.argmax(gain))] > best[0]:
                best = (float(gain[at]), j, at, float(wl[at]), float(wr[at]))
        if best[1] < 0:
            return here
        _, j, at, wl, wr = best
        # Below a monotone split neither side may cross the middle of the two weights.
        mid = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((max(low, mid), high), (low, min(high, mid))), 1: ((low, min(high, mid)), (max(low, mid), high))}[int(signs[j])]
        goes = binned[rows, j] <= at
        left = node(rows[goes], g, h, level + 1, *bounds[0])
        right = node(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[here] = [j, float(cuts[j][at]), left, right, 0.0]
        return here

    for _ in range(trees if 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(node(np.arange(n), q - y, np.maximum(q * (1 - q), 1e-9), 0, -4.0, 4.0))
        part = np.array(nodes[first:])
        tree = Forest(0.0, np.array([0]), part[:, 0].astype(int), part[:, 1], part[:, 2].astype(int) - first, part[:, 3].astype(int) - first, part[:, 4], depth)
        margin += tree.margin(x)
    a = np.array(nodes).reshape(len(nodes), 5)
    return Forest(base, np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth)


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    rows = stats.join(training_labels(labels), "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(sample_rows).select(*COUNTS, "quality").toPandas()
    return grow(features(rows[list(COUNTS)].to_numpy()), rows["quality"].to_numpy().astype(float))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict of every row of ``docs``.

    Null and empty texts have no words and fail the base rules. Without labels of both classes the
    trees are a constant, which keeps everything that passes the base rules (nothing if all
    labels are 0). Repeated rows and null ids are judged like any other row.
    """
    stats = Scratch(docs.sparkSession).table(doc_stats(docs), "stats")
    forest = learn(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(features(m)))], [*b.schema.names, "tree_score"])

    scored = stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("tree_score", T.DoubleType())]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("tree_score") >= KEEP_FROM)).alias("kept"), "tree_score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
