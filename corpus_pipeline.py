"""The corpus pipeline: quality, line and near-duplicate filters, mixing and packing of ``documents``.

Every stage takes empty tables and gives empty ones, keeps rows that repeat unless its rule says
otherwise, reads whole texts of any length, and passes extra columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import lines, minhash, mixing, packing, quality
from assaylake.llm.shared import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; a null doc_id is never labelled, but scored.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that lose their last word. Null and empty texts stay."""
    return lines.without_repeats(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: sets of two-word shingles, similar at 0.8 or more.

    Rows without words stay; rows with a null doc_id stay if they are linked with nothing.
    """
    return minhash.without_near_duplicates(docs, width=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them, repeats included, shard by shard in the order of the shards' shuffle.

    Rows without words are not taken; a null source is a source of its own.
    """
    return mixing.mixed(docs, shard_col=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the packed sequences; rows without words have none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Boosted statistics, hashes and draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
