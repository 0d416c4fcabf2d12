"""JSON-lines archives: strict and tolerant scans, integrity of appends, repair of a broken tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.journal import append_log
from ..schema import ARCHIVE


def read_archives(spark: SparkSession, path: str, schema: str = ARCHIVE) -> DataFrame:
    """All archives of a log; a line that is no such object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str = ARCHIVE) -> tuple[DataFrame, DataFrame]:
    """(archives, broken lines): malformed lines are set aside as text."""
    lines = spark.read.text(path).withColumn("ok", F.try_parse_json("value").isNotNull() & F.col("value").startswith("{"))
    good = lines.filter("ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, lines.filter("not ok").select("value")


def get(archives: DataFrame, archive_id: str) -> DataFrame:
    return archives.filter(F.col("metadata.archive_id") == archive_id).limit(1)


def duplicate_ids(archives: DataFrame) -> DataFrame:
    """(archive_id, n) of ids of more than one archive: an index over the log is refused while there are any."""
    return archives.groupBy(F.col("metadata.archive_id").alias("archive_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rebuild_index(archives: DataFrame) -> DataFrame:
    """(archive_id, ordinal) of the archives that ``read_archives`` gives: where each stands in the log, from 0, file by file.

    An id of more than one archive is refused. Only the counts of the files' blocks meet in one task.
    """
    if twice := duplicate_ids(archives).head(1):
        raise ValueError(f"duplicate historical archive_id: {twice[0].archive_id}")
    block = ["file_path", "file_block_start"]
    rows = archives.select(F.col("metadata.archive_id").alias("archive_id"), *(F.col(f"_metadata.{c}") for c in block), F.monotonically_increasing_id().alias("_at"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(*block, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("_at")) - 1
    return rows.withColumn("_within", within).join(F.broadcast(starts), block).select("archive_id", (F.col("_before") + F.col("_within")).alias("ordinal"))


def append(spark: SparkSession, path: str, new: DataFrame, key: str = "id") -> DataFrame:
    """Appends rows whose key is new, and returns the conflicts: known keys with another row.

    If there are conflicts nothing is written. Repeating an append changes nothing.
    """
    existing = spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], new.schema)
    fresh, conflicts = append_log(existing, new, key)
    if conflicts.isEmpty():
        fresh.write.mode("append").parquet(path)
    return conflicts


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def recover_tail(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with what becomes of each: kept, completed (whole but unended) or discarded.

    Only the last line of a file may be partial; a broken line elsewhere is corrupt.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "value"), F.size(F.split("text", "\n")).alias("n"))
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    last = F.col("line") == F.col("n") - 1
    fate = F.when(last & (F.col("value") == ""), "end").when(last & good, "completed").when(last, "discarded").when(good, "kept").otherwise("corrupt")
    return lines.select("path", "line", "value", fate.alias("fate")).filter("fate <> 'end'")


def publish(objects: DataFrame, magic: bytes | None = None) -> DataFrame:
    """Binary objects with the digest that names them; with ``magic`` only those that start with it."""
    rows = objects if magic is None else objects.filter(F.substring("content", 1, len(magic)) == F.lit(magic))
    return rows.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])


def verify_published(stored: DataFrame) -> DataFrame:
    """Stored objects whose content no longer has the digest of their name."""
    return stored.filter(F.sha2("content", 256) != F.col("sha256"))
