"""Keyed event journals: folding, transitions, intents and quotas, over batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a job, and those that may follow each.
TRANSITIONS = {
    "PENDING": ("RUNNING", "FAILED", "CANCELLED"),
    "RUNNING": ("WAITING_PROVIDER", "VALIDATING", "FAILED", "CANCELLED"),
    "WAITING_PROVIDER": ("VALIDATING", "FAILED", "CANCELLED", "RECONCILIATION_REQUIRED"),
    "VALIDATING": ("ARCHIVING", "FAILED", "CANCELLED"),
    "ARCHIVING": ("SUCCEEDED", "FAILED", "CANCELLED"),
    "SUCCEEDED": (),
    "FAILED": (),
    "CANCELLED": (),
    "RECONCILIATION_REQUIRED": ("PENDING", "WAITING_PROVIDER", "VALIDATING", "CANCELLED"),
}


def _before(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def allowed_step(prev: Column, state: Column, transitions: dict[str, tuple[str, ...]]) -> Column:
    steps = [f"{a}>{b}" for a, then in transitions.items() for b in then]
    return F.concat_ws(">", prev, state).isin(*steps)


def illegal(events: DataFrame, key: str, order: list[str], state: str, transitions: dict[str, tuple[str, ...]]) -> DataFrame:
    """Events whose step from the key's previous state is not allowed, with ``prev``."""
    rows = events.withColumn("prev", F.lag(state).over(_before(key, order)))
    return rows.filter(F.col("prev").isNotNull() & ~allowed_step(F.col("prev"), F.col(state), transitions))


def fold_jobs(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current state of each job, violations with reason) of versioned job events.

    A job starts with version 1 in PENDING; each event's version is one more than the last, and
    its state may follow the last. Corrupt events are reported, not raised.
    """
    w = Window.partitionBy("job_id").orderBy("version")
    rows = events.withColumn("prev_state", F.lag("state").over(w)).withColumn("prev_version", F.lag("version").over(w))
    first = F.col("prev_state").isNull()
    reason = (
        F.when(~F.col("state").isin(*TRANSITIONS), "corrupt job-state record")
        .when(first & ((F.col("version") != 1) | (F.col("state") != "PENDING")), "corrupt job-state creation record")
        .when(~first & (F.col("version") != F.col("prev_version") + 1), "corrupt job-state transition record")
        .when(~first & (F.col("state") != F.col("prev_state")) & ~allowed_step(F.col("prev_state"), F.col("state"), TRANSITIONS), "corrupt job-state transition record")
    )
    rows = rows.withColumn("reason", reason)
    columns = [c for c in events.columns if c != "job_id"]
    current = events.groupBy("job_id").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("job_id", "r.*")
    return current, rows.filter("reason is not null")


def safe_to_resume(jobs: DataFrame) -> DataFrame:
    """``plan``: what may be done with a job's current state without repeating an external action."""
    plan = (
        F.when(F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED"), "terminal")
        .when(F.col("state") == "RECONCILIATION_REQUIRED", "needs_operator")
        .when((F.col("state") == "WAITING_PROVIDER") & F.coalesce("open_intent", F.lit(False)), "uncertain")
        .otherwise("resume")
    )
    return jobs.withColumn("plan", plan)


def pair_intents(events: DataFrame, key: str, order: list[str], id_col: str, is_intent: Column, kind: str, outcome: str) -> DataFrame:
    """Each intent with the event right after it; anything but the outcome leaves it to be reconciled."""
    w = _before(key, order)
    rows = events.withColumn("_i", is_intent).withColumn("_next", F.lead(id_col).over(w)).withColumn("_kind", F.lead(kind).over(w)).filter("_i")
    status = F.when(F.col("_kind") == outcome, "RESULT_PERSISTED").otherwise("RECONCILIATION_REQUIRED")
    return rows.select(key, F.col(id_col).alias("intent_id"), F.col("_next").alias("outcome_id"), status.alias("status"))


def operator_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first record of each action id, conflicts): the same id with other inputs is a conflict."""
    per = actions.groupBy("action_id").agg(F.min_by(F.struct(*[c for c in actions.columns if c != "action_id"]), "seq").alias("r"), F.countDistinct("inputs").alias("n"))
    return per.filter("n = 1").select("action_id", "r.*"), per.filter("n > 1").select("action_id", "n")


def reserve_quota(requests: DataFrame, per_user: int, per_day: int) -> DataFrame:
    """``granted``: requests by (at, request_id) while neither the user's nor the UTC day's count is full.

    A refused request takes no place. A user's first ``per_user`` of a day compete for the
    ``per_day`` places, so that the day's window sees at most those.
    """
    order = ["at", "request_id"]
    rows = requests.withColumn("day", F.to_date("at"))
    rows = rows.withColumn("_u", F.row_number().over(Window.partitionBy("day", "action", "owner_key").orderBy(*order)))
    within = rows.filter(F.col("_u") <= per_user).withColumn("_g", F.row_number().over(Window.partitionBy("day", "action").orderBy(*order)))
    granted = within.filter(F.col("_g") <= per_day).select("request_id", F.lit(True).alias("granted"))
    return rows.drop("_u").join(granted, "request_id", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def append_log(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known id with the same row is no news, with another row a conflict.

    Both logs meet in one shuffle and one grouping by id, whose least and greatest rows tell whether an id has several;
    rows without an id equal none, so each is a group of its own. The number of parts is kept, as parts joined by their
    compressed sizes would be sorted whole in few tasks.
    """
    row = lambda df: F.struct(*[c for c in df.columns if c != key])
    digest = lambda df: F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c != key])), 256).alias("_d")
    rows = new.select(key, F.when(F.col(key).isNull(), row(new)).alias("_own"), digest(new), row(new).alias("_r"))
    old = existing.filter(F.col(key).isNotNull()).select(key, digest(existing), F.lit(True).alias("_known"))
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.unionByName(old, allowMissingColumns=True).repartition(parts, key, "_own").groupBy(key, "_own").agg(
        F.max("_known").alias("_known"), F.min("_d").alias("_least"), F.max("_d").alias("_most"), F.min("_r").alias("_r"), F.max("_r").alias("_other"))
    differ = F.when(F.col("_known"), F.col("_least") != F.col("_most")).otherwise(~F.col("_r").eqNullSafe(F.col("_other")))
    ids = ids.filter("_r is not null").select(key, "_r", "_known", differ.alias("_differ"))
    unnamed = ids.filter(F.col(key).isNull()).groupBy(key).count().filter("count > 1").select(key)
    return ids.filter("_known is null and not _differ").select(key, "_r.*"), ids.filter("_differ").select(key).unionByName(unnamed)
