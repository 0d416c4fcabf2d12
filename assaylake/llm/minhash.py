"""MinHash near-duplicates by min-max hashing.

Each of PERMUTATIONS hash functions gives both the minimum and the maximum over a text's shingles,
so that half the hash evaluations fill the signature. Bands of it name buckets; texts that share a
bucket and whose sketches are near fall into one family; inside each family, full shingle sets are
compared. Buckets and families alike are cut into chunks of bounded size that meet in tiles; a tile
gives a spanning forest of its links, never all its pairs. Equal sets are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linking import components, shared_buckets
from .shared import Scratch, join_unique, maybe_in, packed, split_by

#: 2 * PERMUTATIONS = BANDS * ROWS. A pair at similarity 0.8 misses all bands with probability 1.2e-5,
#: one at 0.25, as texts that share a passage are, shares one with probability 3e-3.
PERMUTATIONS, BANDS, ROWS = 168, 48, 7
#: Of the 320 sketch bits, in five longs, a pair at similarity 0.8 has 32 apart on average; 66 is over six
#: deviations away (less than 1e-9 of such pairs), and about where pairs at 0.6 are.
SKETCH_WORDS, SKETCH_APART = 5, 66
PERCENT = 80

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND_MIX = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEED = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BLOCK = 8192
#: Members of a chunk of a bucket; sets, and shingles, of a chunk of a family; a tile holds two chunks. Columns of a product.
TILE_MEMBERS, TILE_SETS, TILE_SHINGLES, _COLUMNS = 1024, 512, 600_000, 4096
#: Texts whose signatures are held at a time.
_ROWS = 1024


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < width:
        grams = [b" ".join(words)]
    elif width == 2:
        grams = [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    else:
        grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    return np.unique(np.array([digest(g) for g in set(grams)], dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a set under all permutations."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        h = shingles[i : i + _BLOCK, None] * _A + _B
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name for each band of a row of signatures."""
    v = _mixed(sig).reshape(*sig.shape[:-1], BANDS, ROWS)
    return _mixed((v * _BAND_MIX).sum(axis=-1, dtype=np.uint64) + _BAND_SEED).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words of 64 bits with one bit of each of the first values."""
    bit = (_mixed(sig)[..., : 64 * SKETCH_WORDS] >> np.uint64(17)) & np.uint64(1)
    return (bit.reshape(*sig.shape[:-1], SKETCH_WORDS, 64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64).view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, dk, text): dk names a row by its id and text, nulls included."""
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("dk"), "text")


def hashed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, dk, n_shingles, set_id, bands and sketch of every row; empty sets have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small parts: a signature is larger than many a text.
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            sizes, ids, sigs = [], [], []
            for text in b.column(2).cast(pa.large_binary()).to_pylist():
                s = shingle_set(text or b"", width)
                sizes.append(len(s))
                ids.append(set_id(s))
                sigs.append(signature(s))
            sig = np.array(sigs, dtype=np.uint64).reshape(-1, 2 * PERMUTATIONS)
            names, two = bands(sig), np.ascontiguousarray(sketch(sig))
            names = pa.array([list(x) if n else [] for x, n in zip(names, sizes, strict=True)], pa.list_(pa.int64()))
            rows = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), names, pa.FixedSizeListArray.from_arrays(two.ravel(), SKETCH_WORDS).cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "dk", "n_shingles", "set_id", "bands", "sketch"])

    long = T.LongType()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, long) for c in ("dk", "n_shingles", "set_id"))]
    fields += [T.StructField("bands", T.ArrayType(long)), T.StructField("sketch", T.ArrayType(long))]
    return _keyed(docs).mapInArrow(run, T.StructType(fields))


def forest(like: np.ndarray) -> list[tuple[int, int]]:
    """(i, root) for each node that a symmetric adjacency connects with a smaller one; roots are the smallest."""
    left, out = np.ones(len(like), dtype=bool), []
    for root in range(len(like)):
        front = [root] if left[root] else []
        left[root] = False
        while len(front):
            front = np.flatnonzero(like[front].any(axis=0) & left)
            left[front] = False
            out += [(int(i), root) for i in front]
    return out


def near_sketches(ids: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what near sketches connect, among ascending ids."""
    like = np.zeros((len(ids), len(ids)), dtype=bool)
    for i in range(0, len(ids), 256):
        like[i : i + 256] = np.bitwise_count(sketches[i : i + 256, None] ^ sketches[None]).sum(axis=2) <= SKETCH_APART
    return [(int(ids[i]), int(ids[j])) for i, j in forest(like)]


def tile_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect, through links alone, what the links among these sets connect.

    The sizes of all intersections are one matrix product of the sets' incidence with itself.
    """
    ids, at = np.unique(np.array(ids, dtype=np.int64), return_index=True)
    sets = [sets[i] for i in at]
    n = len(ids)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(ids[1]), int(ids[0]))] if 100 * both >= percent * (size.sum() - both) else []
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    number = np.cumsum(times > 1) - 1
    row, column = row[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for low in range(0, int(number[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        x = np.zeros((n, _COLUMNS), dtype=np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x @ x.T
    return [(int(ids[i]), int(ids[j])) for i, j in forest(100 * both >= percent * (size[:, None] + size - both))]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])


def sketch_links(tiled: DataFrame) -> DataFrame:
    """(u, v): edges among the members of each tile. ``tiled`` has (id, sketch, tiles) for each member."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in _closed(batches):
            if b is not None:
                tile, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                words = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS)
                if kept is not None:
                    tile, ids, words = (np.concatenate(x) for x in zip(kept, (tile, ids, words), strict=True))
                end = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
                kept = tile[end:], ids[end:], words[end:]
                tile, ids, words = tile[:end], ids[:end], words[:end]
            elif kept is not None:
                tile, ids, words = kept
            else:
                return
            if not len(tile):
                continue
            start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            first = np.repeat(start, np.diff(np.r_[start, len(tile)]))
            near = np.bitwise_count(words ^ words[first]).sum(axis=1) <= SKETCH_APART
            own = near & (ids != ids[first])
            found = list(zip(ids[own].tolist(), ids[first][own].tolist(), strict=True))
            # Only tiles with members far from their first one need more than a star.
            for at in np.unique(first[~near]).tolist():
                to = int(np.searchsorted(first, at, side="right"))
                found += near_sketches(ids[at:to], words[at:to])
            yield _edges(found)

    rows = tiled.select(F.explode("tiles").alias("tile"), "id", "sketch")
    return rows.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(link, "u long, v long")


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def set_links(docs: DataFrame, tiled: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): edges among the sets of each tile. ``tiled`` has (dk, id, tiles) for each set."""
    held = maybe_in(_keyed(docs).select("dk", "text"), "dk", tiled, "dk").join(tiled.hint("shuffle_merge"), "dk", "inner").select("tiles", "id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [(t, j, shingle_set(x or b"", width).tobytes()) for ts, j, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), strict=True) for t in ts]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["tile", "id", "shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []
        for b in batches:
            for tile, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if tile != now:
                    yield _edges(tile_links(ids, held, percent))
                    now, ids, held = tile, [], []
                ids.append(i)
                held.append(np.frombuffer(x.as_py(), dtype=np.uint64))
        yield _edges(tile_links(ids, held, percent))

    rows = held.mapInArrow(sets, "tile long, id long, shingles binary")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(link, "u long, v long")


def connected(rows: DataFrame, weight: str, chunks, link: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(id, component) over the links inside each group of ``rows`` (grp, id, n, w, ...).

    A group of n members and weight w is cut into ``chunks(n, w)`` chunks. Its first chunk meets each
    other one in a tile, which is all of a small group; what is then outside the group's largest
    component meets all chunks. ``link`` gives the edges inside the tiles of (id, ..., tiles).
    """
    rows = scratch.table(rows.withColumn("chunks", chunks(F.col("n"), F.col("w"))).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")), "members")
    tile = lambda i, j: F.xxhash64("grp", i, j)
    zero = F.lit(0).cast("long")
    first = F.when(F.col("chunk") > 0, F.array("chunk")).when(F.col("chunks") == 1, F.array(zero)).otherwise(F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1))
    links = scratch.table(link(rows.withColumn("tiles", F.transform(first, lambda j: tile(zero, j)))), "links")
    done = components(links, scratch)

    large = rows.filter("chunks > 2").drop("n", "w")
    if large.isEmpty():
        return done
    large = scratch.table(large.join(done, "id", "left").withColumn("component", F.coalesce("component", "id")), "large")
    parts = large.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("w"))
    parts = parts.groupBy("grp").agg(F.max(F.struct("c", "component", "w")).alias("main"), F.sum("c").alias("n"), F.sum("w").alias("w"))
    parts = parts.filter("n > main.c").select("grp", "n", F.col("main.component").alias("main"), chunks(F.col("n") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("others"))
    large = join_unique(large, scratch.table(parts, "large-parts"), "grp", "n", "inner")
    other = F.pmod(F.xxhash64("id", F.lit(1)), "others")
    rows_of = lambda i, j: F.transform(i, lambda x: F.transform(j, lambda y: tile(x + 1, y)))
    upto = lambda n: F.sequence(zero, n - 1)
    tiles = F.flatten(rows_of(upto(F.col("others")), F.array("chunk")))
    tiles = F.when(F.col("component") == F.col("main"), tiles).otherwise(F.array_union(tiles, F.flatten(rows_of(F.array(other), upto(F.col("chunks"))))))
    more = scratch.table(link(large.withColumn("tiles", tiles)), "more")
    return components(links.unionByName(more), scratch)


def families(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): every two items of one bucket with near sketches are in one family.

    ``members`` has (key, id, sketch). Nothing is verified here; links are to be looked for inside
    each family.
    """
    shared = shared_buckets(members, scratch).select(F.col("key").alias("grp"), "id", "sketch", "n", F.lit(1).cast("long").alias("w"))
    chunks = lambda n, w: F.greatest(F.ceil(n / TILE_MEMBERS), F.lit(1))
    return connected(shared, F.lit(1).cast("long"), chunks, sketch_links, scratch)


def link_families(docs: DataFrame, found: DataFrame, sets: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) over the links inside each family; see ``families``."""
    rows = found.join(sets.select(F.col("set_id").alias("id"), "dk", "n_shingles"), "id").withColumnRenamed("component", "grp")
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).filter("n > 1")
    rows = join_unique(rows, scratch.table(size, "family-sizes"), "grp", "n", "inner")
    chunks = lambda n, w: F.greatest(F.ceil(n / TILE_SETS), F.ceil(w / TILE_SHINGLES), F.lit(1))
    return connected(rows, "n_shingles", chunks, lambda tiled: set_links(docs, tiled.select("dk", "id", "tiles"), width, percent), scratch)


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``, one row for each.

    Texts with fewer words than ``width`` have their whole sequence as one shingle; null and empty
    ones have none, are linked with nothing and form their own component. Equal sets are linked.
    component_id is the smallest doc_id of the component (nulls aside); a null doc_id without
    others has a null component and is not kept. Rows that repeat a doc_id are rows of their own.
    """
    return _near_duplicates(docs, width, percent).drop("dk")


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(hashed(docs, width).withColumn("rid", F.monotonically_increasing_id()), "hashed")
    some = rows.filter("n_shingles > 0")
    sets = some.groupBy("set_id").agg(F.min(F.struct("rid", "dk")).alias("r"), F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n"))
    sets = scratch.table(sets.select("set_id", "r.rid", "r.dk", "doc_id", "n_shingles", "n"), "sets")
    one = some.select("rid", "set_id", "bands", "sketch").join(sets.select("rid"), "rid").drop("rid")
    members = scratch.table(one, "bands").select(F.explode("bands").alias("key"), F.col("set_id").alias("id"), "sketch")
    linked = link_families(docs, families(members, scratch), sets, width, percent, scratch)
    labelled = sets.join(linked, F.col("set_id") == F.col("id"), "left").select("set_id", "doc_id", "n", F.coalesce("component", "set_id").alias("component"))
    labelled = scratch.table(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    labelled = join_unique(labelled, scratch.table(least, "least"), "component", "c", "inner")
    labelled = scratch.table(labelled.select("set_id", "component_id", "n"), "component-ids")
    out = join_unique(some.select("doc_id", "dk", "n_shingles", "set_id"), labelled, "set_id", "n", "inner").select("doc_id", "dk", "n_shingles", "component_id")
    out = out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "dk", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows without words stay; of rows that repeat the kept doc_id one stays; rows with a null
    doc_id that are linked with nothing stay. An empty table gives an empty one. Columns pass
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.table(_near_duplicates(docs, width, percent), "judged")
    gone = judged.filter("n_shingles > 0 and not kept and component_id is not null").select("dk").distinct()
    again = judged.filter("kept and n_shingles > 0").groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("component_id").alias("doc_id"))
    gone = scratch.table(gone, "gone")
    keyed = packed(docs, "doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("dk"))
    maybe, surely = split_by(keyed, "dk", gone, "dk")
    out = maybe.join(gone, "dk", "left_anti").unionByName(surely.select("dk", "row", "doc_id"), allowMissingColumns=False)
    if not again.isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("dk"))
        twice = out.join(again, "doc_id", "left_semi").withColumn("first", first).filter("first = 1").select("row")
        out = out.join(again, "doc_id", "left_anti").select("row").unionByName(twice)
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
