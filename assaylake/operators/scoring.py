"""Scoring of extracted rows against gold assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as O


def cascade(gold: DataFrame, seen: DataFrame, id_cols: list[str], on: list[str], steps: dict[str, Column]) -> DataFrame:
    """One row: how many assertions some observation meets up to each step, every step adding a condition."""
    marked = seen.withColumn("_seen", F.lit(True))
    rows = gold.join(marked, on, "left")
    held, flags = F.coalesce(F.col("_seen"), F.lit(False)), []
    for name, condition in steps.items():
        held = held & F.coalesce(condition, F.lit(False))
        flags.append(F.max(held.cast("int")).alias(f"_{name}"))
    per = rows.groupBy(*id_cols).agg(*flags)
    return per.agg(F.count(F.lit(1)).alias("expected"), *(F.sum(f"_{n}").alias(n) for n in steps))


def confusion(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """The four counts and the precision, 0 if nothing was predicted."""
    n = lambda c: F.count_if(c)
    return rows.agg(
        n(predicted & gold).alias("true_positive"), n(predicted & ~gold).alias("false_positive"), n(~predicted & gold).alias("false_negative"), n(~predicted & ~gold).alias("true_negative"),
        O.ratio(n(predicted & gold), n(predicted), 3, 0.0).alias("precision"),
    )


def metric_match(gold: DataFrame, seen: DataFrame, on: list[str], fields: dict[str, str]) -> DataFrame:
    """Gold rows that some observation meets in every field the gold asserts."""
    return gold.join(seen, [gold[c] == seen[c] for c in on] + [gold[g].isNull() | (gold[g] == seen[s]) for g, s in fields.items()], "left_semi")


def series_recall(gold: DataFrame, seen: DataFrame, on: list[str], coordinate: str, value: str, tolerance: float = 1e-8) -> DataFrame:
    """expected and found points of each series; a point is found at its coordinate within the tolerance."""
    other = seen.select(*on, F.round(coordinate, 6).alias("_at"), F.col(coordinate).alias("_c"), F.col(value).alias("_v"))
    rows = gold.withColumn("_at", F.round(coordinate, 6)).join(other, [*on, "_at"], "left")
    hit = (F.abs(F.col(coordinate) - F.col("_c")) <= tolerance) & (F.abs(F.col(value) - F.col("_v")) <= tolerance)
    per = rows.groupBy(*on, coordinate, value).agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("_hit"))
    return per.groupBy(*on).agg(F.count(F.lit(1)).alias("expected"), F.sum("_hit").alias("found"))


def assertion_score(assertions: DataFrame, case: str = "case_id", passed: str = "passed") -> DataFrame:
    """Share of assertions that hold, by case."""
    return assertions.groupBy(case).agg(F.count(F.lit(1)).alias("assertions"), F.count_if(passed).alias("matched"), F.avg(F.col(passed).cast("double")).alias("score"))


def closure(cases: DataFrame) -> DataFrame:
    """Cases with ``closed``: everything matched and the score exactly 1. There is no average over cases."""
    return cases.withColumn("closed", (F.col("matched") == F.col("assertions")) & (F.col("score") == 1.0))


def invariants(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """name, holds: each invariant over all rows; one without rows holds."""
    got = rows.agg(*(F.coalesce(F.every(F.coalesce(c, F.lit(False))), F.lit(True)).alias(n) for n, c in named.items()))
    return got.unpivot([], list(named), "name", "holds")


def provider_groups(runs: DataFrame) -> DataFrame:
    """Runs by provider: rates over the runs that have what a rate is of."""
    done = F.col("status") == "succeeded"
    return runs.groupBy("provider").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("succeeded"), O.ratio(F.count_if(done), F.count("status")).alias("success_rate"),
        O.ratio(F.count_if(done & F.col("valid")), F.count_if(done)).alias("schema_valid_rate"), F.sort_array(F.collect_set("model")).alias("models"),
    )


def latest_over_history(current: DataFrame, historic: DataFrame, key: str) -> DataFrame:
    """Current rows, and historic ones whose key has no current row."""
    return current.unionByName(historic.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def validate_manifest(entries: DataFrame, required: list[str], unique: list[str], roles: list[str]) -> DataFrame:
    """rule, key of each violation: missing fields, duplicates, malformed checksums, missing or extra roles."""
    out = [entries.filter(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).select(F.lit(f"missing_{c}").alias("rule"), F.col(unique[0]).cast("string").alias("key")) for c in required]
    out += [entries.groupBy(c).count().filter("count > 1").select(F.lit(f"duplicate_{c}").alias("rule"), F.col(c).cast("string").alias("key")) for c in unique]
    out.append(entries.filter(~F.col("checksum").rlike("^[0-9a-f]{64}$")).select(F.lit("malformed_checksum").alias("rule"), F.col(unique[0]).cast("string").alias("key")))
    wanted = entries.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    out.append(wanted.join(entries.select(F.col("benchmark_role").alias("role")), "role", "left_anti").select(F.lit("missing_role").alias("rule"), F.col("role").alias("key")))
    out.append(entries.filter(~F.col("benchmark_role").isin(*roles)).select(F.lit("extra_role").alias("rule"), F.col("benchmark_role").alias("key")))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def artifact_integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, status: absent, mismatched or verified."""
    rows = expected.join(found.select("path", F.col("sha256").alias("_found")), "path", "left")
    return rows.select("path", F.when(F.col("_found").isNull(), "absent").when(F.col("_found") != F.col("sha256"), "mismatched").otherwise("verified").alias("status"))
