"""Evidence: is a snippet where it says it is, and does it hold the value?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as O

def _runs(text: Column) -> Column:
    """(size, key) of all runs of three words of a text: their characters, and their hash."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    two = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.struct((F.length(a) + F.length(b)).alias("n"), F.xxhash64(a, b).alias("h")))
    three = F.zip_with(two, F.slice(words, 3, F.size(words)), lambda p, c: F.struct((p["n"] + F.length(c)).alias("size"), F.xxhash64(p["h"], c).alias("key")))
    return F.when(F.size(words) >= 3, F.slice(three, 1, F.size(words) - 2))


def contained(snippets: DataFrame, texts: DataFrame, snippet_id: str, text_id: str, scope: str | None = None) -> DataFrame:
    """(snippet id, text id) of the texts that hold a snippet, case aside; both of one ``scope``, if given.

    A snippet's inner words are whole words of a text that holds it, so its inner run of three words
    with most characters is an equality key. Texts give their runs' keys and ids alone; their bodies
    meet only the snippets that share one. Snippets of fewer than five words have no key; they meet
    the texts of their scope, or without scopes (they are few or none) every text.
    """
    inner = lambda runs: F.when(F.size(runs) > 2, F.slice(runs, 2, F.size(runs) - 2))
    within = F.col(scope) if scope else F.lit(0)
    key = F.array_max(inner(_runs(F.col("text"))))["key"]
    s = snippets.select(F.col(snippet_id).alias("sid"), within.alias("scope"), F.lower("text").alias("snippet"), key.alias("key"))
    bodies = texts.select(F.col(text_id).alias("tid"), within.alias("scope"), F.lower("text").alias("body"))
    keys = texts.select(F.col(text_id).alias("tid"), within.alias("scope"), F.explode(F.array_distinct(_runs(F.col("text"))["key"])).alias("key"))
    near = keys.join(s.select("sid", "scope", "key").filter("key is not null"), ["scope", "key"]).select("sid", "tid")
    out = bodies.drop("scope").join(near, "tid").join(s.select("sid", "snippet"), "sid").filter(F.contains("body", F.col("snippet"))).select("sid", "tid")
    short = s.filter("key is null").select("sid", "scope", "snippet")
    if scope or not short.isEmpty():
        met = short.join(bodies, "scope") if scope else short.drop("scope").crossJoin(bodies.drop("scope"))
        out = out.unionByName(met.filter(F.contains("body", F.col("snippet"))).select("sid", "tid"))
    return out.select(F.col("sid").alias(snippet_id), F.col("tid").alias(text_id))


def verify_snippets(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence with ``verbatim_match``: its page, or without a page exactly one of the source's, holds the snippet.

    Snippets and pages meet by source and shared runs of words; keys are normal forms. An empty
    snippet or a source without text leaves the match null.
    """
    from ..functions.text import evidence_key

    rows = evidence.withColumn("_id", F.to_json(F.struct(*evidence.columns)))
    wanted = rows.select("_id", "source_id", "page", evidence_key(F.col("text_snippet")).alias("text")).filter(F.length("text") > 0).distinct()
    texts = pages.select(F.struct("source_id", "page").alias("at"), "source_id", evidence_key(F.col("text")).alias("text"))
    hits = contained(wanted.select("_id", "source_id", "text"), texts, "_id", "at", "source_id").distinct().join(wanted.select("_id", "page"), "_id")
    hits = hits.filter(F.col("page").isNull() | (F.col("page") == F.col("at.page")))
    hits = hits.groupBy("_id").agg(F.count(F.lit(1)).alias("_hits"), F.min("at.page").alias("_at"))
    counted = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("_pages"))
    got = rows.join(counted, "source_id", "left").join(hits, "_id", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0).cast("long")))
    asked = (F.length(evidence_key(F.col("text_snippet"))) > 0) & (F.col("_pages") > 0)
    match = F.when(asked, F.when(F.col("page").isNotNull(), F.col("_hits") > 0).otherwise(F.col("_hits") == 1))
    kept = [c for c in evidence.columns if c not in ("page", "verbatim_match")]
    return got.select(*kept, F.coalesce("page", F.when(F.col("_hits") == 1, F.col("_at"))).alias("page"), match.alias("verbatim_match"))


def verify_cells(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims about a table cell with the reason for which one is rejected, null if it stands."""
    from ..functions.text import cell_key

    known = cells.select("table_id").distinct().withColumn("_table", F.lit(True))
    at = cells.select("table_id", "row", "col", cell_key(F.col("text")).alias("_cell"))
    rows = claims.join(known, "table_id", "left").join(at, ["table_id", "row", "col"], "left")
    want = cell_key(F.col("claim_text"))
    reason = O.ladder([(F.col("_table").isNull(), "unknown_table"), (F.col("_cell").isNull(), "unknown_cell"), (want == "", "empty_claim"), (F.col("_cell") != want, "cell_text_mismatch")])
    return rows.select(*claims.columns, reason.alias("reason"))


def value_supported(evidence: Column, raw: Column, *, page: bool = False, locator: bool = False, table: bool = False, kinds: tuple[str, ...] = ()) -> Column:
    """Some verbatim snippet holds the raw value; by domain it also needs a page, a place, a table or a kind."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))

    def holds(e: Column) -> Column:
        tests = [F.coalesce(e["verbatim_match"], F.lit(False)), F.contains(squeeze(e["text_snippet"]), squeeze(raw))]
        if page:
            tests.append(e["page"].isNotNull())
        if locator:
            tests.append(F.coalesce(e["locator"], e["table_id"]).isNotNull())
        if table:
            tests.append(e["table_id"].isNotNull())
        if kinds:
            tests.append(F.coalesce(e["source_type"].isin(*kinds), F.lit(False)) & ~F.contains(F.lower(F.coalesce(e["original_source_type"], F.lit(""))), F.lit("caption")))
        return O.all_of(*tests)

    return (F.length(squeeze(raw)) > 0) & F.exists(evidence, holds)


def semantics(e: Column) -> Column:
    """(strength, estimated) of one evidence item; null is unverified."""
    origin = F.coalesce(e["original_source_type"], e["source_type"])
    verbatim = F.coalesce(e["verbatim_match"], F.lit(False))
    strength = F.when((origin == "ocr_extracted") & verbatim, "verified_ocr").when(origin == "figure_digitized", "estimated_digitized").when(verbatim, "verified_native").otherwise("unverified")
    return F.struct(strength.alias("strength"), (F.coalesce(origin == "figure_digitized", F.lit(False)) | F.coalesce(e["estimated"], F.lit(False))).alias("estimated"))
