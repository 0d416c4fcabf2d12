"""Variable-capacity best-fit packing of texts into sequences of a few permitted lengths.

Sizes are whole numbers up to the longest length, so that the whole corpus packs as a histogram:
the driver runs best fit, largest first, on counts of sizes, for several rules of which length to
open, and keeps the cheapest packing after shrinking each bin to the smallest length that holds its
contents. The plan's size depends on the number of lengths, not on the corpus. Pieces are then
ranked within their size, in parallel, and look their place up by size and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, Scratch

LENGTHS = (512, 1024, 2048, 4096)
_RANK_BITS = 42


def cost(length: int) -> float:
    """Of one sequence: its positions, its share of attention, and a fixed part."""
    return length + length * length / 65_536 + 16


@dataclass
class Plan:
    """Segments by (size, first rank): first bin, pieces a bin, fill before; and lengths by bin range."""

    keys: np.ndarray
    first: np.ndarray
    bins: np.ndarray
    each: np.ndarray
    fill: np.ndarray
    ranges: np.ndarray
    lengths: np.ndarray
    total: float

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset, length) of pieces."""
        at = np.searchsorted(self.keys, (size << _RANK_BITS) + rank, side="right") - 1
        within = rank - self.first[at]
        b = self.bins[at] + within // self.each[at]
        return b, self.fill[at] + within % self.each[at] * size, self.lengths[np.searchsorted(self.ranges, b, side="right") - 1]


def best_fit(histogram: dict[int, int], lengths: tuple[int, ...], opens) -> Plan:
    """Best fit, largest sizes first, over counts; ``opens(size)`` is the length of a new bin."""
    segments: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int, int]]] = {}
    rests: list[int] = []
    bins = 0

    def put(rest: int, low: int, high: int, length: int) -> None:
        if high > low:
            if rest not in free:
                free[rest] = []
                insort(rests, rest)
            free[rest].append((low, high, length))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(rests, size)
            if at == len(rests):
                length = opens(size)
                put(length, bins, bins + -(-left // (length // size)), length)
                bins += -(-left // (length // size))
                continue
            rest = rests[at]
            low, high, length = free[rest].pop()
            if not free[rest]:
                del free[rest], rests[at]
            each = rest // size
            full = min(high - low, left // each)
            if full:
                segments.append((size, rank, low, each, length - rest))
                put(rest - each * size, low, low + full, length)
                rank, left = rank + full * each, left - full * each
            low += full
            if left and low < high:  # fewer than fill a bin
                segments.append((size, rank, low, each, length - rest))
                put(rest - left * size, low, low + 1, length)
                rank, left, low = rank + left, 0, low + 1
            put(rest, low, high, length)
    ranges = sorted((low, high, length - rest) for rest, held in free.items() for low, high, length in held)
    final = [min(x for x in lengths if x >= used) for _, _, used in ranges]
    total = sum((high - low) * cost(x) for (low, high, _), x in zip(ranges, final, strict=True))
    s = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    return Plan((s[:, 0] << _RANK_BITS) + s[:, 1], s[:, 1], s[:, 2], s[:, 3], s[:, 4], np.array([r[0] for r in ranges], dtype=np.int64), np.array(final, dtype=np.int64), total)


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> Plan:
    """The cheapest packing over the rules for opening bins: least cost a word, or at least a given length."""
    fits = lambda size, least: min(x for x in lengths if x >= max(size, least))
    rules = [lambda size: min((x for x in lengths if x >= size), key=lambda x: cost(x) / (x // size * size))]
    rules += [lambda size, least=least: fits(size, least) for least in lengths]
    return min((best_fit(histogram, lengths, r) for r in rules), key=lambda p: p.total)


def pack(items: DataFrame, size_col: str, id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece, start, size, bin_id, length, bin_offset: one row for each piece of each row.

    Items longer than the longest length are cut into pieces of that length and a rest; pieces of
    size 0 (null or empty items) have a null bin. Repeated rows and null ids are packed each; the
    order of pieces within a size is by a hash of id and piece. Other columns are not read.
    """
    spark, lengths = items.sparkSession, tuple(sorted(lengths))
    scratch, most = Scratch(items.sparkSession), lengths[-1]
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    pieces = items.select(F.col(id_col).alias("doc_id"), size.alias("whole"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("whole") / most), F.lit(1)) - 1)))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("whole") - F.col("piece") * most).alias("size"))
    # The order of a size is spread over ranges, so that ranks need no task that holds a whole size.
    spread = pieces.withColumn("h", F.xxhash64("doc_id", "piece")).repartitionByRange("size", "h")
    spread = scratch.table(spread.withColumn("part", F.spark_partition_id()), "pieces")
    parts = spread.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = {}
    starts = []
    for r in sorted(parts, key=lambda r: (r["size"], r.part)):
        starts.append((r.part, r["size"], histogram.get(r["size"], 0)))
        histogram[r["size"]] = histogram.get(r["size"], 0) + r.n
    held = spark.sparkContext.broadcast(plan(histogram, lengths))
    # A size has a row for each range it lies in: no more rows than ranges and sizes together.
    first = spark.createDataFrame(starts, "part int, size long, first long")
    window = Window.partitionBy("part", "size").orderBy("h", "doc_id", "piece")
    ranked = spread.withColumn("rank", F.row_number().over(window) - 1).join(F.broadcast(first), ["part", "size"])
    ranked = ranked.select("doc_id", "piece", "start", "size", (F.col("rank") + F.col("first")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            some = n > 0
            out = np.zeros((3, len(n)), dtype=np.int64)
            if some.any():
                out[:, some] = p.place(n[some], rank[some])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, mask=~some) for x in out)], ["doc_id", "piece", "start", "size", "bin_id", "bin_offset", "length"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    out = ranked.mapInArrow(run, f"doc_id {kind}, piece long, start long, size long, bin_id long, bin_offset long, length long")
    return out.select("doc_id", "piece", "start", "size", "bin_id", "length", "bin_offset")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``docs`` packed by their numbers of words."""
    return pack(docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).alias("words")), "words", lengths=lengths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
