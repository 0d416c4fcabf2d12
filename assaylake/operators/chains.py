"""Logs whose events are chained by hashes: verification, comparison, ranks and ordered replay, in parallel.

No task holds a log: links are checked by joins on (log, ordinal), ranks go by segments, and copies of a log are
compared by the digests of segments before any event is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as O

SEGMENT = 4096


def link(previous: Column, payload: Column) -> Column:
    """The hash of an event: of the hash before it (empty for the first) and of its payload."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(previous, F.lit("")), F.coalesce(payload, F.lit(""))), 256)


def chained(events: DataFrame, log: str = "log_id", ordinal: str = "ordinal", payload: str = "payload") -> DataFrame:
    """``events`` with prev_hash and hash, each log folded in order; for writers, whose logs are short."""
    rows = events.groupBy(log).agg(F.array_sort(F.collect_list(F.struct(ordinal, payload))).alias("_e"))
    none = F.array().cast("array<string>")
    last = lambda acc: F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1))
    hashes = F.aggregate("_e", none, lambda acc, e: F.concat(acc, F.array(link(last(acc), e[payload]))))
    rows = rows.withColumn("_h", hashes).select(log, F.posexplode(F.arrays_zip(F.col("_e").alias("e"), F.col("_h").alias("h"))).alias("_i", "x"), "_h")
    return rows.select(log, F.col(f"x.e.{ordinal}").alias(ordinal), F.col(f"x.e.{payload}").alias(payload), F.when(F.col("_i") > 0, F.get("_h", F.col("_i") - 1)).otherwise("").alias("prev_hash"), F.col("x.h").alias("hash"))


def broken_links(events: DataFrame) -> DataFrame:
    """(log_id, ordinal, reason) of every event of (log_id, ordinal, payload, prev_hash, hash) that breaks its chain.

    An event stands if its hash is that of its payload and prev_hash, and prev_hash is the hash of the event one before it. What
    is missing shows at the event after it. Events that share a place break it both.
    """
    before = events.groupBy("log_id", (F.col("ordinal") + 1).alias("ordinal")).agg(F.count(F.lit(1)).alias("_n"), F.max("hash").alias("_before"))
    same = events.groupBy("log_id", "ordinal").agg(F.count(F.lit(1)).alias("_same"))
    rows = events.join(before, ["log_id", "ordinal"], "left").join(same, ["log_id", "ordinal"])
    first = F.col("ordinal") == 1
    reason = O.ladder([
        (F.col("_same") > 1, "place_taken_twice"), (F.col("ordinal") < 1, "place_before_the_first"),
        (~F.col("hash").eqNullSafe(link(F.col("prev_hash"), F.col("payload"))), "tampered"),
        (~first & F.col("_n").isNull(), "predecessor_missing"), (~first & ~F.col("prev_hash").eqNullSafe(F.col("_before")), "not_linked"), (first & (F.coalesce("prev_hash", F.lit("")) != ""), "not_linked"),
    ])
    return rows.select("log_id", "ordinal", reason.alias("reason")).filter("reason is not null").distinct()


def verified_prefix(events: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(log_id, events, verified, broken_at, reason): how far each log can be trusted, and the first link that breaks.

    ``tails`` (log_id, ordinal, hash) say where logs should end: what was cut off at the end breaks at its tail.
    """
    broken = broken_links(events)
    if tails is not None:
        last = events.select("log_id", "ordinal", F.col("hash").alias("_hash"))
        cut = tails.join(last, ["log_id", "ordinal"], "left").filter(~F.col("hash").eqNullSafe(F.col("_hash")))
        broken = broken.unionByName(cut.select("log_id", "ordinal", F.lit("tail_missing").alias("reason")))
    first = broken.groupBy("log_id").agg(F.min(F.struct("ordinal", "reason")).alias("b"))
    size = events.groupBy("log_id").agg(F.count(F.lit(1)).alias("events"), F.max("ordinal").alias("_last"))
    rows = size.join(first, "log_id", "full")
    return rows.select("log_id", F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.greatest(F.coalesce(F.col("b.ordinal") - 1, F.col("_last")), F.lit(0)).alias("verified"), F.col("b.ordinal").alias("broken_at"), F.col("b.reason").alias("reason"))


def segment_digests(events: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(log_id, segment, n, digest): sums that do not depend on the order of rows, merged within tasks first."""
    at = F.floor((F.col("ordinal") - 1) / size).alias("segment")
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "ordinal", "hash").cast("decimal(38,0)"))
    return events.groupBy("log_id", at).agg(F.count(F.lit(1)).alias("n"), part(1).alias("_a"), part(2).alias("_b")).select("log_id", "segment", "n", F.struct("_a", "_b").alias("digest"))


def log_differences(own: DataFrame, other: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(log_id, ordinal, difference) between two copies of logs; only segments whose digests differ are compared by event."""
    a, b = segment_digests(own, size), segment_digests(other, size)
    apart = a.join(b.select("log_id", "segment", F.col("n").alias("_n"), F.col("digest").alias("_digest")), ["log_id", "segment"], "full")
    apart = apart.filter(~F.struct("n", "digest").eqNullSafe(F.struct("_n", "_digest"))).select("log_id", "segment")
    here = lambda df, name: df.withColumn("segment", F.floor((F.col("ordinal") - 1) / size)).join(apart, ["log_id", "segment"]).select("log_id", "ordinal", F.col("hash").alias(name))
    rows = here(own, "_own").join(here(other, "_other"), ["log_id", "ordinal"], "full")
    what = F.when(F.col("_own").isNull(), "missing").when(F.col("_other").isNull(), "added").when(F.col("_own") != F.col("_other"), "changed")
    return rows.select("log_id", "ordinal", what.alias("difference")).filter("difference is not null")


def ranked(rows: DataFrame, log: str, ordinal: str, out: str, size: int = SEGMENT) -> DataFrame:
    """``rows`` with their rank (from 1) in their log, by segments of the ordinal and the sums of those before."""
    cut = rows.withColumn("_segment", F.floor(F.col(ordinal) / size))
    sums = cut.groupBy(log, "_segment").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(log).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select(log, "_segment", ahead.alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy(log, "_segment").orderBy(ordinal))
    return cut.withColumn("_r", inner).join(sums, [log, "_segment"]).withColumn(out, F.col("_r") + F.col("_ahead")).drop("_segment", "_r", "_ahead")


def replay(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """``requests`` with replayed, reason and raw_ref: the stored outcome of each in order, up to the first that can't be replayed.

    ``requests``: log_id, position (from 1), model, phase, request_hash; ``attempts``: log_id, ordinal, model, phase, request_hash,
    status, raw_ref. Attempts that confirmed no result are passed over; the request at a position must be the one stored there.
    """
    stored = ranked(attempts.filter(F.coalesce("status", F.lit("")) != "CONFIRMED_NO_RESULT"), "log_id", "ordinal", "position")
    stored = stored.select("log_id", "position", F.struct("model", "phase", "request_hash").alias("_asked"), "status", "raw_ref", F.lit(True).alias("_there"))
    rows = requests.join(stored, ["log_id", "position"], "left")
    reason = O.ladder([
        (F.col("_there").isNull(), "no_durable_response"), (~F.struct("model", "phase", "request_hash").eqNullSafe(F.col("_asked")), "request_differs"),
        (~F.col("status").eqNullSafe(F.lit("RAW_PERSISTED")) | F.col("raw_ref").isNull(), "not_replayable"),
    ])
    rows = rows.withColumn("_reason", reason)
    stop = rows.filter("_reason is not null").groupBy("log_id").agg(F.min("position").alias("_stop"))
    rows = rows.join(stop, "log_id", "left")
    reached = F.when(F.col("position") < F.coalesce("_stop", F.col("position") + 1), F.lit(None).cast("string")).when(F.col("position") == F.col("_stop"), F.col("_reason")).otherwise("not_reached")
    return rows.select(*requests.columns, reached.isNull().alias("replayed"), reached.alias("reason"), F.when(reached.isNull(), F.col("raw_ref")).alias("raw_ref"))
