"""Where queries are registered under their function's name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when first named; only named columns reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None):
    """Registers fn(tables) -> DataFrame as a query over (spark, folder)."""

    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"a query of this name is registered: {fn.__name__}")
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register
