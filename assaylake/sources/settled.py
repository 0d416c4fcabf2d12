"""Intermediate results of iterations, written to the shared folder so that they outlive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is unset, a local master (as in tests) gets one below its warehouse; a cluster
    is refused, as its executors would share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of this driver; what was returned may still be read from them.
_FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes all intermediate tables of this driver; results that were not written are gone then."""
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        if spark.sparkContext._jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared folder and read from there.

    That cuts the lineage as a checkpoint does. A checkpoint would keep the sizes that the optimizer guessed
    for the plan behind it, which multiply from round to round; of a table it sees the real ones. These are the sizes
    of compressed columns, though, often a hundredth of the rows': a hint keeps joins from sending them through the driver.
    """
    folder = shared_folder(df.sparkSession, "settled")
    _FOLDERS.append((df.sparkSession, folder))
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).hint("merge")
