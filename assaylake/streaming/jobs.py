"""Job journals as streams: a keyed state machine, idempotent appends and windowed counts.

Events that a job's state does not allow go to the output with a reason, rather than stopping the
stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.journal import TRANSITIONS, append_log
from ..sources.versions import VersionedTables, append_once

EVENT = "job_id string, version long, state string, at timestamp"
OUT = "job_id string, version long, state string, accepted boolean, reason string"


def step(held: tuple[int, str] | None, version: int, state: str) -> str | None:
    """Why an event may not follow the held (version, state); null if it may."""
    if state not in TRANSITIONS:
        return "corrupt job-state record"
    if held is None:
        return None if version == 1 and state == "PENDING" else "corrupt job-state creation record"
    if version != held[0] + 1 or (state != held[1] and state not in TRANSITIONS[held[1]]):
        return "corrupt job-state transition record"
    return None


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["version", "at"])
    out = []
    for r in rows.itertuples(index=False):
        if held is not None and (r.version, r.state) == held:
            continue  # the same event again
        reason = step(held, r.version, r.state)
        if reason is None:
            held = (int(r.version), r.state)
        out.append((key[0], int(r.version), r.state, reason is None, reason))
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=["job_id", "version", "state", "accepted", "reason"])


def fold_stream(events: DataFrame) -> DataFrame:
    """Accepted and refused events of a stream of EVENT rows, each judged by its job's state so far."""
    return events.groupBy("job_id").applyInPandasWithState(_fold, OUT, "version long, state string", "append", GroupStateTimeout.NoTimeout)


def append_stream(events: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """A query that appends events once each, by key, to a table; conflicts go to ``<path>_conflicts``."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        existing = spark.read.parquet(path) if there else spark.createDataFrame([], batch.schema)
        fresh, conflicts = append_log(existing, batch, key)
        fresh.write.mode("append").parquet(path)
        conflicts.write.mode("append").parquet(f"{path}_conflicts")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_versions(events: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """The same into ``rows`` and ``conflicts`` of a versioned folder, each micro-batch as one version.

    A batch that is lost between its writes, and run again, leaves each row and each conflict once.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_once(VersionedTables(batch.sparkSession, path), batch, key, checkpoint, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests of each owner and UTC day, final once the watermark has passed the day."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "owner_key", "action").agg(F.count(F.lit(1)).alias("n"))
