"""Nearest neighbours by a block matrix join with int8 tiles.

Unit vectors are quantised to int8, each with the norm of what the rounding lost. A tile of a query
block and a candidate block is one integer matrix product; its scaled values bound every cosine from
both sides. Only pairs whose upper bound reaches the k-th lower bound so far are computed from the
original vectors, in double precision, and go through one bounded heap for each query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

NEAREST = 5
QUERY_EVERY = 50
BLOCK = 1024
#: Candidates of a group at most, and from how many on a group is worth a task of its own.
GROUP_MOST, GROUP_LEAST = 262_144, 8192
#: Pairs that are recomputed at a time.
_PAIRS = 32_768
#: Rounding of the bounds themselves.
_SLACK = 1e-9
#: Products of so many int8 pairs are exact in a float32 sum.
_EXACT = 1024

_BLOCK_SCHEMA = "grp int, dim int, ids binary, vectors binary, codes binary, scales binary, lost binary"


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and float64 vectors of the rows that take part: whole, finite and not zero."""
    rows, vectors = [], []
    for i, v in enumerate(column):
        values = v.values
        if values is None or not len(values) or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            rows.append(i)
            vectors.append(x)
    return np.array(rows, dtype=np.int64), vectors


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and norms of the rounding errors of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows; float32 sums hold the integers of _EXACT columns."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], _EXACT):
        out += a[:, i : i + _EXACT].astype(np.float32) @ b[:, i : i + _EXACT].astype(np.float32).T
    return out


def _pack(grp: int, ids: np.ndarray, x: np.ndarray, copies: int | None) -> pa.RecordBatch:
    if copies is not None:
        # Equal vectors tie, and smaller ids win ties: no more than ``copies`` ids of them can be among the nearest.
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, which = np.unique(x.view([("", np.void, x.dtype.itemsize * x.shape[1])]).ravel(), return_inverse=True)
        by = np.argsort(which, kind="stable")
        a, b = by[1:], by[:-1]
        by = by[np.r_[True, (which[a] != which[b]) | (ids[a] != ids[b])]]  # an id counts once
        starts = np.r_[0, np.flatnonzero(np.diff(which[by])) + 1]
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        keep = np.sort(by[rank < copies])
        ids, x = ids[keep], x[keep]
    codes, scale, lost = quantise(unit(x))
    values = [[grp], [x.shape[1]], [ids.tobytes()], [x.tobytes()], [codes.tobytes()], [scale.tobytes()], [lost.tobytes()]]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["grp", "dim", "ids", "vectors", "codes", "scales", "lost"])


def blocks(vectors: DataFrame, copies: int | None) -> DataFrame:
    """Packed blocks of at most BLOCK rows (grp, id, vector) of one group and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            rows, xs = usable(b.column(2))
            groups, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for r, x in zip(rows, xs, strict=True):
                at = waiting.setdefault(key := (int(groups[r]), len(x)), [])
                at.append((int(ids[r]), x))
                if len(at) == BLOCK:
                    yield _pack(key[0], np.array([i for i, _ in at]), np.stack([v for _, v in at]), copies)
                    at.clear()
        for (grp, _), at in waiting.items():
            if at:
                yield _pack(grp, np.array([i for i, _ in at]), np.stack([v for _, v in at]), copies)

    return vectors.mapInArrow(run, _BLOCK_SCHEMA)


class Tile:
    """The query side of a run of tiles: its blocks' arrays and a bounded heap for each query."""

    def __init__(self, dim: int, parts: list[bytes], k: int):
        self.k = k
        self.ids, self.x, self.codes, self.scale, self.lost = unpack(dim, parts)
        self.u = unit(self.x)
        self.near = np.sqrt(((self.codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in self.ids]

    def meet(self, dim: int, parts: list[bytes]) -> None:
        ids, x, codes, scale, lost = unpack(dim, parts)
        about = products(self.codes, codes) * self.scale[:, None] * scale
        bound = self.lost[:, None] + self.near[:, None] * lost + _SLACK
        own = self.ids[:, None] == ids
        low = np.where(own, -np.inf, about - bound)
        least = np.array([h[0][0] - _SLACK if len(h) == self.k else -np.inf for h in self.heaps])
        if len(ids) > self.k and len(np.unique(ids)) == len(ids):
            least = np.maximum(least, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        rows, columns = np.nonzero((about + bound >= least[:, None]) & ~own)
        u = unit(x)
        for i in range(0, len(rows), _PAIRS):
            r, c = rows[i : i + _PAIRS], columns[i : i + _PAIRS]
            exact = (self.u[r] * u[c]).sum(axis=1)
            for q, score, vec in zip(r.tolist(), exact.tolist(), ids[c].tolist(), strict=True):
                self.push(self.heaps[q], score, vec)

    def push(self, heap: list[tuple[float, int]], score: float, vec: int) -> None:
        for i, (s, v) in enumerate(heap):
            if v == -vec:  # a repeated id counts once, with its best vector
                if score > s:
                    heap[i] = (score, -vec)
                    heapq.heapify(heap)
                return
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec))
        elif (score, -vec) > heap[0]:
            heapq.heapreplace(heap, (score, -vec))

    def found(self) -> pa.RecordBatch:
        out = [(int(q), -v, s) for q, h in zip(self.ids, self.heaps, strict=True) for s, v in h]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["query_id", "vec_id", "score"])


def unpack(dim: int, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    ids, x, codes, scale, lost = (np.frombuffer(p, dtype=t) for p, t in zip(parts, (np.int64, np.float64, np.int8, np.float64, np.float64), strict=True))
    return ids, x.reshape(-1, dim), codes.reshape(-1, dim), scale, lost


def nearest(embeddings: DataFrame, k: int = NEAREST, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, every row being a candidate.

    Queries are rows whose id is divisible by ``query_every``; nearness is the cosine. Rows with a
    null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part; vectors meet only those of their own length. An id that repeats counts once, with its
    best vector. Ties go to the smaller id. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q")).first()
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, math.ceil(counts.n / GROUP_MOST), min(math.ceil(counts.n / GROUP_LEAST), tasks))
    candidates = vectors.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), "id", "v").repartition(groups, "grp")
    candidates = Scratch(spark).table(blocks(candidates, k + 1), "candidates")
    queries = vectors.filter(F.col("id") % query_every == 0).select(F.lit(0).alias("grp"), "id", "v")
    queries = blocks(queries.repartition(max(1, math.ceil(counts.q / BLOCK))), None)
    queries = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    names = ["ids", "vectors", "codes", "scales", "lost"]
    left = queries.select("grp", "dim", *(F.col(c).alias(f"q_{c}") for c in names))
    # The merge join takes each query block through all candidate blocks of its group before the next.
    tiles = left.join(candidates.hint("merge"), ["grp", "dim"]).select("dim", *(f"q_{c}" for c in names), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, *parts = (c[i].as_py() for c in b.columns)
                if (dim, parts[0], parts[1]) != now:
                    if tile is not None:
                        yield tile.found()
                    now, tile = (dim, parts[0], parts[1]), Tile(dim, parts[:5], k)
                tile.meet(dim, parts[5:])
        if tile is not None:
            yield tile.found()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
