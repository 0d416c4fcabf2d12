"""Review papers: their numbers are other people's. And candidates for discovery, of which nothing is verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import stable_id

#: A reference mark, a number with a unit, and the two ways in which a paper calls itself a review.
REFERENCE = r"\[\d+(?:\s*[-–,]\s*\d+)*\]|\(\d{4}\)|et al\."
NUMERIC_UNIT = r"\d+(?:\.\d+)?\s*(?:%|mV|V|mA|µA|uA|A|mm|µm|um|nm|h|d|days?|°C|K|MPa|GPa|g|mg|ppm)\b|\d\s*%"
LABEL, SUMMARY = r"(?im)^\s*(?:review|review article|critical review)\s*$", r"(?is)\bthis review\s+summari[sz]es\b"


def review_signals(pages: DataFrame) -> DataFrame:
    """source_id, labelled, summarised, pure_review: only both signals together make a review."""
    first = F.col("page") <= 2
    got = pages.groupBy("source_id").agg(F.max(first & F.col("text").rlike(LABEL)).alias("labelled"), F.max(F.col("text").rlike(SUMMARY)).alias("summarised"))
    return got.withColumn("pure_review", F.coalesce(F.col("labelled") & F.col("summarised"), F.lit(False)))


def guard_ownership(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Records of a pure review that were held focal, or of unknown owner, become review summaries."""
    pure = signals.filter("pure_review").select("source_id", F.lit(True).alias("_review"))
    out = records.join(pure, "source_id", "left")
    own = F.when(F.coalesce("_review", F.lit(False)) & F.col("ownership").isin("focal_work", "unknown"), "review_summary").otherwise(F.col("ownership"))
    return out.withColumn("ownership", own).drop("_review")


def cited_statements(pages: DataFrame, context: str) -> DataFrame:
    """Sentences with a reference, a number with a unit and the domain's context, each of a source once."""
    rows = pages.select("source_id", "page", F.posexplode(X.sentences(F.col("text"))).alias("at", "snippet"))
    rows = rows.filter(F.col("snippet").rlike(REFERENCE) & F.col("snippet").rlike(NUMERIC_UNIT) & F.col("snippet").rlike(f"(?i){context}"))
    token = X.ascii_key(F.col("snippet"))
    first = rows.groupBy("source_id", token.alias("token")).agg(F.min(F.struct("page", "at", "snippet")).alias("r"))
    return first.select(stable_id("review", F.col("source_id"), F.col("r.page"), F.col("r.at"), F.col("token")).alias("candidate_id"), "source_id", "r.page", "r.snippet", F.lit("cited_prior_work").alias("ownership"))


def direct_doi(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:dx\.)?doi\.org/(10\.\d{4,9}/\S+)$", 1), F.lit(""))


def discovery_candidates(responses: DataFrame) -> DataFrame:
    """Search results (query, organic list of link, title, snippet) as candidates; unsafe links are left out."""
    rows = responses.select("query", F.posexplode("organic").alias("rank", "r")).withColumn("url", X.http_url(F.col("r.link"))).filter("url is not null")
    title = F.coalesce(F.nullif(F.trim("r.title"), F.lit("")), F.lit("Untitled discovery result"))
    doi = direct_doi(F.col("url"))
    return rows.select(
        stable_id("disc", F.col("query"), F.col("rank"), title, F.col("url")).alias("candidate_id"), title.alias("title"), "url", F.nullif(F.trim("r.snippet"), F.lit("")).alias("snippet"), doi.alias("doi"),
        F.when(doi.isNotNull(), "direct_doi_url").alias("doi_provenance"), "query",
    )


def save_candidates(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved candidates, and new ones that are not among them."""
    return saved.unionByName(new.dropDuplicates(["candidate_id"]).join(saved.select("candidate_id"), "candidate_id", "left_anti"))


def enrich_titles(sources: DataFrame, found: DataFrame, least: float = 0.72) -> DataFrame:
    """Sources with missing DOI and year filled from the found record whose title is most alike, if it is enough.

    Records meet the source that they were searched for; fields that a source has stay.
    """
    rows = sources.join(found.select("source_id", F.col("title").alias("_title"), F.col("doi").alias("_doi"), F.col("year").alias("_year")), "source_id", "left")
    rows = rows.withColumn("_alike", X.similarity_ratio(F.coalesce("title", F.lit("")), F.coalesce("_title", F.lit(""))))
    best = F.max_by(F.struct("_doi", "_year"), F.when(F.col("_alike") >= least, F.struct("_alike", "_title")))
    got = rows.groupBy(*sources.columns).agg(best.alias("_b"))
    return got.select(*(F.coalesce(c, F.col(f"_b._{c}")).alias(c) if c in ("doi", "year") else F.col(c) for c in sources.columns))
