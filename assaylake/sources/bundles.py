"""A source's context from its parts: native pages, recognised pages, tables, figures, digitisations, as joined tables.

What parsers and recognition returned are inputs. Parts that were made for another version of the source (another
checksum) don't count, and recognised text stands in for native text only where that is insufficient and it isn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least text of a page, and the most replacement characters in it.
LEAST_CHARS, LEAST_ALPHANUMERIC, MOST_REPLACED = 40, 20, 0.02


def insufficiency(text: Column) -> Column:
    """Why a page's text is not enough, in order; none for a sufficient one."""
    key = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    size = F.char_length(key)
    letters = F.char_length(F.regexp_replace(key, r"[^\p{L}\p{N}]", ""))
    replaced = size - F.char_length(F.replace(key, F.lit("�"), F.lit("")))
    return F.array_compact(F.array(
        F.when(size < LEAST_CHARS, "normalized_text_below_minimum"), F.when(letters < LEAST_ALPHANUMERIC, "alphanumeric_text_below_minimum"),
        F.when((size > 0) & (replaced > MOST_REPLACED * size), "replacement_character_ratio_exceeded"),
    ))


def native_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """source_id, page, text, parser, sufficient, reasons, attempts: the first parser's page, or the second's where that one is insufficient.

    ``first`` and ``second``: source_id, page, text, parser. If neither suffices the longer text is kept, the first on a tie.
    """
    a = first.select("source_id", "page", F.col("text").alias("_a"), F.col("parser").alias("_pa"))
    b = second.select("source_id", "page", F.col("text").alias("_b"), F.col("parser").alias("_pb"))
    rows = a.join(b, ["source_id", "page"], "full")
    good_a, good_b = F.size(insufficiency(F.col("_a"))) == 0, F.size(insufficiency(F.col("_b"))) == 0
    longer = F.char_length(F.coalesce("_b", F.lit(""))) > F.char_length(F.coalesce("_a", F.lit("")))
    takes = ~good_a & (good_b | longer)
    text = F.coalesce(F.when(takes, F.col("_b")).otherwise(F.col("_a")), F.lit(""))
    attempts = F.array_compact(F.array("_pa", F.when(~good_a, F.col("_pb"))))
    rows = rows.select("source_id", "page", text.alias("text"), F.when(takes, F.col("_pb")).otherwise(F.col("_pa")).alias("parser"), attempts.alias("attempts"))
    reasons = insufficiency(F.col("text"))
    return rows.withColumns({"sufficient": F.size(reasons) == 0, "reasons": reasons})


def current(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """The parts (source_id, source_checksum, ...) that were made for the source as it is."""
    own = sources.select("source_id", F.col("checksum").alias("source_checksum"))
    return parts.join(own, ["source_id", "source_checksum"]).drop("source_checksum")


def effective_pages(native: DataFrame, recognised: DataFrame, sources: DataFrame) -> DataFrame:
    """``native`` pages with native_text, origin and, where recognition helps, its text.

    ``recognised``: source_id, source_checksum, page, raw_text, status. A recognised page counts if it succeeded and suffices.
    """
    good = current(recognised, sources).filter((F.col("status") == "succeeded") & (F.size(insufficiency(F.col("raw_text"))) == 0))
    good = good.groupBy("source_id", "page").agg(F.min("raw_text").alias("_ocr"))
    rows = native.join(good, ["source_id", "page"], "left")
    used = ~F.col("sufficient") & F.col("_ocr").isNotNull()
    return rows.select(
        "source_id", "page", F.col("text").alias("native_text"), F.col("parser").alias("native_parser"), F.when(used, F.col("_ocr")).otherwise(F.col("text")).alias("text"), F.when(used, "ocr").otherwise(F.col("parser")).alias("parser"),
        F.when(used, "ocr_extracted").otherwise("native_text").alias("origin"), (F.col("sufficient") | used).alias("sufficient"),
        F.when(used, F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"), F.when(used, F.concat("attempts", F.array(F.lit("ocr_sidecar")))).otherwise(F.col("attempts")).alias("attempts"),
    )


def source_objects(tables: DataFrame, figures: DataFrame, recognised: DataFrame, digitizations: DataFrame) -> DataFrame:
    """(source_id, object_id, object_type) of all that a source's sidecar holds."""
    one = lambda df, key, kind: df.select("source_id", key.cast("string").alias("object_id"), F.lit(kind).alias("object_type"))
    return reduce(DataFrame.unionByName, [
        one(tables, F.col("table_id"), "table"), one(figures, F.col("figure_id"), "figure"), one(recognised, F.concat(F.lit("ocr-page-"), "page"), "ocr_block"), one(digitizations, F.col("digitization_id"), "digitization"),
    ])


def asked_cells(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """``asked`` (request_id, source_id, table_id, row, col, cell_id) with the cell's text, found by its id if one is given, else by its place, and reason.

    ``cells``: source_id, table_id, row, col, cell_id, text. Of several cells of one id or place the first by place counts.
    """
    known = cells.select("source_id", "table_id").distinct().withColumn("_table", F.lit(True))
    place = F.struct("row", "col", "text")
    by_id = cells.filter("cell_id is not null").groupBy("source_id", "table_id", "cell_id").agg(F.min(place).alias("_by_id"))
    by_place = cells.groupBy("source_id", "table_id", "row", "col").agg(F.min(place).alias("_by_place"))
    rows = asked.join(known, ["source_id", "table_id"], "left").join(by_id, ["source_id", "table_id", "cell_id"], "left").join(by_place, ["source_id", "table_id", "row", "col"], "left")
    found = F.when(F.col("cell_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_place"))
    vague = F.col("cell_id").isNull() & (F.col("row").isNull() | F.col("col").isNull())
    reason = F.when(F.col("_table").isNull(), "unknown_table").when(vague, "no_cell_named").when(found.isNull(), "unknown_cell")
    return rows.select("request_id", found["row"].alias("row"), found["col"].alias("col"), found["text"].alias("text"), reason.alias("reason"))


def bundle_summary(sources: DataFrame, pages: DataFrame, objects: DataFrame) -> DataFrame:
    """One row for each source: pages, how many are recognised or insufficient, and objects by kind."""
    count = lambda df, **what: df.groupBy("source_id").agg(*(c.alias(n) for n, c in what.items()))
    p = count(pages, pages=F.count(F.lit(1)), recognised=F.count_if(F.col("origin") == "ocr_extracted"), insufficient=F.count_if(~F.col("sufficient")))
    kinds = ("table", "figure", "ocr_block", "digitization")
    o = count(objects, **{f"{k}s": F.count_if(F.col("object_type") == k) for k in kinds})
    out = sources.select("source_id").join(p, "source_id", "left").join(o, "source_id", "left")
    return out.fillna(0)
