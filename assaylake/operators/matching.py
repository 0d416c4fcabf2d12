"""Comparison of observed records with expected ones, and what must never be among admitted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Owners whose values are not the paper's own.
NON_FOCAL = ("cited_prior_work", "review_summary", "comparison_table", "background", "example", "unknown")
#: Owners of a group that its items cannot change.
PRIOR = ("cited_prior_work", "review_summary", "comparison_table", "background")
#: Origins of evidence that lead back to the source.
TRACKED_ORIGINS = ("native_text", "table_reported", "ocr_extracted")
#: Methods of calculation that must not stand on a measurement.
CALCULATED = ("dft", "first_principles")


def _given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def asserted(fields: dict[str, str], same=lambda a, e: a == e) -> Column:
    """Every field (actual -> expected) that is asserted is met."""
    met = F.lit(True)
    for actual, expected in fields.items():
        met = met & (~_given(F.col(expected)) | F.coalesce(same(F.col(actual), F.col(expected)), F.lit(False)))
    return met


def identity_matches(expected: DataFrame, seen: DataFrame, on: list[str], fields: list[str], parts: str = "components") -> DataFrame:
    """Rows of ``expected`` and ``seen`` whose asserted ``fields`` are equal and whose expected parts are all seen."""
    other = seen.select(*on, *(F.col(c).alias(f"seen_{c}") for c in [*fields, parts, "seen_id"]))
    rows = expected.join(other, on)
    have = F.size(F.array_except(F.coalesce(parts, F.array().cast("array<string>")), F.coalesce(f"seen_{parts}", F.array().cast("array<string>")))) == 0
    return rows.filter(asserted({f"seen_{c}": c for c in fields}) & have).select(*expected.columns, F.col("seen_seen_id").alias("seen_id"))


def dimension_counts(expected: DataFrame, seen: DataFrame, on: list[str], dimensions: dict[str, list[str]]) -> DataFrame:
    """dimension, expected, matched: expected rows that some observation meets in the fields of each dimension.

    One join serves all dimensions; null is not asserted. Rows that repeat are counted before they meet.
    """
    fields = sorted({c for cs in dimensions.values() for c in cs})
    keys = [*on, *fields]
    gold = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    other = seen.select(*on, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_seen")).distinct()
    rows = gold.join(other, on, "left")
    met = {d: F.coalesce(F.col("_seen"), F.lit(False)) & asserted({f"_{c}": c for c in cs}) for d, cs in dimensions.items()}
    per = rows.groupBy(*keys, "_n").agg(*(F.max(c.cast("int")).alias(f"_is_{d}") for d, c in met.items()))
    got = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("expected"), *(F.coalesce(F.sum(F.col(f"_is_{d}") * F.col("_n")), F.lit(0)).alias(d) for d in dimensions))
    return got.unpivot(["expected"], list(dimensions), "dimension", "matched").select("dimension", "expected", "matched")


def review_contamination() -> Column:
    """An admitted row of somebody else's values."""
    return (F.col("admission_status") == "canonical") & F.col("ownership").isin(*NON_FOCAL)


def calculation_leak(properties: list[str]) -> Column:
    """A row that is no calculation, but has a calculated property or method."""
    leak = F.coalesce(F.col("property").isin(*properties), F.lit(False)) | F.coalesce(F.lower("method").isin(*CALCULATED), F.lit(False))
    return F.coalesce(F.col("record_type") != "CalculationRecord", F.lit(True)) & leak


def conversion_violation() -> Column:
    """A converted potential that the authors did not report themselves."""
    return F.col("converted_potential").isNotNull() & F.coalesce(F.col("conversion_status") != "author_reported", F.lit(True))


def violation_counts(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One row: how many rows break each of the three rules."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(
        n(review_contamination()).alias("review_contamination"), n(calculation_leak(properties)).alias("calculation_leakage"), n(conversion_violation()).alias("conversion_violations")
    )


def source_tracked() -> Column:
    """The row names title, page and snippet of its source, by evidence that leads back to it."""
    return _given(F.col("source_title")) & F.coalesce(F.col("source_page") != 0, F.lit(False)) & _given(F.col("evidence_snippet")) & F.coalesce(F.col("evidence_origin").isin(*TRACKED_ORIGINS), F.lit(False))


def effective_ownership(group: Column, item: Column) -> Column:
    """An item's owner: its group's where that is somebody else, else its own where known, else its group's."""
    return F.when(group.isin(*PRIOR), group).when(F.coalesce(item, F.lit("unknown")) != "unknown", item).otherwise(group)


def normalization_key(kind: Column, material: Column, basis: Column) -> Column:
    """What values are normalised by; null if unknown."""
    named = F.coalesce(F.when(_given(material), material), F.when(_given(basis), basis), F.lit(""))
    return F.when(F.coalesce(kind, F.lit("unknown")) != "unknown", F.concat(kind, F.lit(":"), named))


def comparability(left: Column, right: Column) -> Column:
    """Whether values under two normalisation keys can be compared."""
    return F.when(left.isNull() | right.isNull(), "unknown_basis").when(left == right, "comparable").otherwise("not_comparable")


def experiments(measurements: DataFrame, context: list[str], item: list[str]) -> DataFrame:
    """Measurements gathered under the experiment that their context makes; null contexts are alike.

    The list holds a context's own measurements only, in the order of ``item``.
    """
    key = F.sha2(F.to_json(F.struct(*context), {"ignoreNullFields": "false"}), 256)
    return measurements.groupBy(*context).agg(F.sort_array(F.collect_list(F.struct(*item))).alias("measurements")).withColumn("experiment_id", key)


def unresolved_conflicts(measurements: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``measurements`` with ``in_conflict``: an unresolved conflict names the experiment, or names none in a document of one."""
    open_ = conflicts.filter(~F.coalesce("resolved", F.lit(False)))
    named = open_.filter("experiment_id is not null").select("document_id", "experiment_id").distinct().withColumn("_named", F.lit(True))
    loose = open_.filter("experiment_id is null").select("document_id").distinct().withColumn("_loose", F.lit(True))
    single = measurements.groupBy("document_id").agg((F.count_distinct("experiment_id") == 1).alias("_single"))
    rows = measurements.join(named, ["document_id", "experiment_id"], "left").join(loose.join(single, "document_id"), "document_id", "left")
    flag = F.coalesce("_named", F.lit(False)) | F.coalesce(F.col("_loose") & F.col("_single"), F.lit(False))
    return rows.select(*measurements.columns, flag.alias("in_conflict"))
