"""What stands before a place in a text: segments with offsets, bounded look-backs, and sentences that need the one before.

Texts are cut once; segments, not texts, meet places, and only those of the two neighbouring bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_key

#: Characters before a caption in which a condition may be stated.
LOOK_BACK = 2000
#: Phrases that refer to the sentence before, and words of which that has to have one.
REFERS = r"(?i)\b(?:material containing|that containing|respectively|former|latter|both materials|these catalysts)\b"
NAMED = r"(?i)\b(?:catalyst|material|using|sample)\b"
MOST_CHARS, MOST_BEFORE = 1200, 500

#: A piece and what parts it from the next one: white space after an end mark, or a line's end.
_SEGMENT = r"(?s)[^\n]*?(?:(?<=[.!?])\s+|\n|\z)"


def segments(texts: DataFrame, id_col: str, text_col: str = "text", pattern: str = _SEGMENT) -> DataFrame:
    """(id, seq, start, end, segment) of the sentences and lines of each text; offsets count from 0, blank pieces are left out."""
    pieces = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(pattern), F.lit(0))).alias("piece_no", "piece"))
    before = F.coalesce(F.sum(F.char_length("piece")).over(Window.partitionBy("id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("_at", before).withColumn("segment", F.btrim("piece", F.lit(" \t\n\r\f\x0b"))).filter("segment <> ''")
    lead = F.char_length("piece") - F.char_length(F.ltrim("piece", F.lit(" \t\n\r\f\x0b")))
    start = (F.col("_at") + lead).cast("long")
    seq = F.row_number().over(Window.partitionBy("id").orderBy("piece_no"))
    return rows.select("id", seq.alias("seq"), start.alias("start"), (start + F.char_length("segment")).alias("end"), "segment")


def last_before(places: DataFrame, cut: DataFrame, needle: str, reach: int = LOOK_BACK, key: Callable[[Column], Column] = evidence_key) -> DataFrame:
    """``places`` (id, at, ...) with the last segment of ``cut`` that holds their ``needle`` and ends before them, ``reach`` characters back at most.

    A segment that begins further back counts from there on. Both sides meet by text and bin of ``reach``
    characters, a segment in each bin that it touches. ``key`` makes needles and segments comparable.
    """
    bin_ = lambda c: F.floor(c / reach)
    touched = cut.select("id", "start", "end", "segment", F.explode(F.sequence(bin_(F.col("start")), bin_(F.col("end") - 1))).alias("_bin"))
    rows = places.withColumn("_id", F.struct(*places.columns))
    asked = rows.select("_id", "id", "at", key(F.col(needle)).alias("_key"), F.explode(F.array(bin_(F.col("at")), bin_(F.col("at")) - 1)).alias("_bin")).filter("_key <> ''")
    low = F.col("at") - reach
    seen = F.when(F.col("start") < low, F.substring("segment", (low - F.col("start") + 1).cast("int"), F.char_length("segment"))).otherwise(F.col("segment"))
    met = asked.join(touched, ["id", "_bin"]).filter((F.col("end") <= F.col("at")) & (F.col("end") > low)).withColumn("_seen", F.btrim(seen, F.lit(" \t\n\r\f\x0b")))
    met = met.filter(F.contains(key(F.col("_seen")), F.col("_key")))
    best = met.groupBy("_id").agg(F.max_by(F.struct("_seen", "start"), "start").alias("_b"))
    return rows.join(best, "_id", "left").select(*places.columns, F.col("_b._seen").alias("support"), F.when(F.col("_b").isNotNull(), F.greatest(F.col("_b.start"), F.col("at") - reach)).alias("support_at"))


def with_context(sentences: DataFrame) -> DataFrame:
    """Sentences (id, seq, start, end, segment) with ``context_start``: where what they say begins.

    A sentence that refers back begins with the one before, if that is short and names a thing; where that is the rest of
    a figure's number, with the one before that. Sentences beyond MOST_CHARS are left out.
    """
    w = Window.partitionBy("id").orderBy("seq")
    back = lambda c, n: F.lag(c, n).over(w)
    rows = sentences.select("*", *(back(c, n).alias(f"_{c}{n}") for c in ("segment", "start") for n in (1, 2)))
    refers = F.rlike("segment", F.lit(REFERS)) & F.col("_segment1").isNotNull() & (F.char_length("_segment1") <= MOST_BEFORE) & F.rlike("_segment1", F.lit(NAMED))
    split = F.rlike("_segment1", F.lit(r"^\d+[A-Za-z]\b")) & F.lower("_segment2").isin("fig.", "figure.")
    start = F.when(F.coalesce(refers, F.lit(False)), F.when(F.coalesce(split, F.lit(False)), F.col("_start2")).otherwise(F.col("_start1"))).otherwise(F.col("start"))
    return rows.filter(F.char_length("segment") <= MOST_CHARS).select(*sentences.columns, start.alias("context_start"))
