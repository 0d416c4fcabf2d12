"""Scratch tables and skew-proof joins that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot from this many rows on; only the HOT_KEYS heaviest of them are broadcast, so that
#: no other key holds more than 1/HOT_KEYS of the rows.
HOT_ROWS = 200
HOT_KEYS = 8192

#: A task takes at least so many rows of a table whose size is known.
TASK_ROWS = 100_000

#: After a table that took so many seconds, the driver is asked to let go of shuffle files.
RECLAIM_S = 1.0


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is unset, a local master (as in tests) gets a folder below its warehouse; a
    cluster is refused, as its executors would not see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/assaylake-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Scratch folders of this driver, which results may still be read from.
_ROOTS: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes all scratch folders of this driver; results that were not written are gone then."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)


class Scratch:
    """Written tables of one operator call; each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_dir(spark)
        _ROOTS.append((spark, self.root))
        self._n = 0
        self._paths: dict[int, tuple[str, DataFrame]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` written and read again; no more than about ``rows`` rows, if given, need few tasks."""
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
        began = time.monotonic()
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if time.monotonic() - began > RECLAIM_S:
            # Shuffle files of earlier tables go when the driver collects the plans that made them.
            gc.collect()
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            _delete(self.spark, self._paths.pop(id(df))[0])


def join_unique(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``big`` joined to ``small``, which has one row for each key and the key's row count in ``big``.

    The rows of the HOT_KEYS heaviest keys meet their match by a broadcast of at most HOT_KEYS
    rows; the others, none of which can hold more than 1/HOT_KEYS of the rows, are shuffled.
    ``how`` may be left too: cold rows without a match stay.
    ``small`` is read twice and should be a written table.
    """
    hot = small.filter(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc(), F.col(key)).limit(HOT_KEYS)
    few = F.broadcast(hot)
    warm = big.join(few, key, "inner")
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small, key, how)
    return warm.unionByName(cold)


def with_default(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with each missing column added as null of the given type."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def join_salted(big: DataFrame, small: DataFrame, key: str, salt_by: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, whose rows may be large and have distinct keys.

    Only the names and part counts of the HOT_KEYS heaviest keys are broadcast; the rows of such a
    key are dealt over parts of about HOT_ROWS rows, to each of which its ``small`` row is copied.
    """
    hot = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= HOT_ROWS).orderBy(F.col("_n").desc(), F.col(key)).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(key, F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(1000)).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), parts).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Rows of 64 bits that a bitmap has at most, however many ids it holds.
BITMAP_ROWS = 1 << 18


def _slot(key):
    """A key's row of a bitmap, and the two bits that stand for it there."""
    h = F.xxhash64(key)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, at), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(BITMAP_ROWS)).alias("_slot"), bit(40).bitwiseOR(bit(50))


def maybe_in(big: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``big`` without most of the rows whose key is not among ``ids``; none of the others is lost.

    A bitmap of at most BITMAP_ROWS rows is broadcast; an inner join on the key has to follow (the
    optimizer would move a semi join ahead of the bitmap).
    """
    slot, bit = _slot(F.col(id_col))
    bits = ids.groupBy(slot).agg(F.bit_or(bit).alias("_bits"))
    slot, bit = _slot(F.col(key))
    out = big.withColumn("_slot", slot).join(F.broadcast(bits), "_slot", "inner")
    return out.filter(F.col("_bits").bitwiseAND(bit) == bit).drop("_slot", "_bits")


def split_by(big: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``big`` as the rows that ``maybe_in`` keeps and the rest, whose keys are surely not among ``ids``."""
    slot, bit = _slot(F.col(id_col))
    bits = ids.groupBy(slot).agg(F.bit_or(bit).alias("_bits"))
    slot, bit = _slot(F.col(key))
    out = big.withColumn("_slot", slot).join(F.broadcast(bits), "_slot", "left")
    held = F.coalesce(F.col("_bits").bitwiseAND(bit) == bit, F.lit(False))
    return out.filter(held).drop("_slot", "_bits"), out.filter(~held).drop("_slot", "_bits")


def packed(df: DataFrame, *more) -> DataFrame:
    """``df`` as one struct column ``row`` beside ``more``, so that no column of the user's clashes."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *more)
