"""Relational operators that the projections, audits and scorers share.

All are set-based over a whole corpus. Where order matters it is a column; where exactly one match
is asked for, it is counted, never assumed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; a running maximum, not a sort of the key's rows, decides."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def earliest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``: first-wins dedup."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def keep_last_at_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, with ``position``: where the key first occurred."""
    columns = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.min(seq).alias("position"), F.max_by(F.struct(*columns), seq).alias("_r"))
    return out.select(key, "_r.*", "position")


def only_match(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``out``: the key's single distinct match; null, with ``matches`` above 1, if ambiguous."""
    got = df.groupBy(*keys).agg(F.countDistinct(value).alias("matches"), F.min(value).alias("_v"))
    return got.select(*keys, "matches", F.when(F.col("matches") == 1, F.col("_v")).alias(out))


def scalar_or_conflict(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One distinct value: ``scalar``; several: null, and the sorted ``conflict`` list."""
    got = df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("_all"))
    return got.select(*keys, F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).alias("scalar"), F.when(F.size("_all") > 1, F.col("_all")).alias("conflict"))


def ladder(rules: list[tuple[Column, str | Column]], passed: str | None = None) -> Column:
    """The reason of the first rule that holds; ``passed`` if none does."""
    out = None
    for holds, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out.otherwise(F.lit(passed))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def close(a: Column, b: Column, rel: float = 1e-9, abs_tol: float = 0.0) -> Column:
    """Equal within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))


def ratio(part: Column, whole: Column, digits: int | None = None, empty: float | None = None) -> Column:
    """part / whole; ``empty`` if the whole is 0."""
    out = F.when(whole != 0, part / F.when(whole != 0, whole)).otherwise(F.lit(empty).cast("double"))
    return F.round(out, digits) if digits is not None else out


def sum_if_complete(value: str) -> Column:
    """The sum if no row lacks the value, else null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def common_value(value: str) -> Column:
    """The value that all rows share, else null."""
    return F.when((F.count_distinct(value) == 1) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def wildcard(expected: str, observed: str) -> Column:
    """An asserted field has to match; one that is not asserted matches anything."""
    return F.col(expected).isNull() | (F.col(expected) == F.col(observed))


def pipe_join(values: Column) -> Column:
    """Array as a cell; nulls keep their place as empty texts."""
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "|")


def ordered_list(value: Column, order: Column) -> Column:
    """The group's values in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def backfill(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Each row's last non-empty value so far: labels of merged cells, headings of sections."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Numbers the runs of rows; ``starts`` marks the first row of a run."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(starts.cast("int")).over(w))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with the sign and number by which two tables differ; none if they are equal as multisets."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("difference")).filter("difference <> 0")
