"""What is told about extractions, runs and corpora: coverage, totals, reviews due, and why a result is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as O

#: Kinds of empty results and the title that each is shown under.
EMPTY_TITLES = {
    "review_no_focal_data": "No focal scientific results extracted",
    "quarantined_only": "No canonical results admitted",
    "no_structured_results": "No structured results available",
}
#: Properties whose values mean little without a method.
METHOD_BOUND = ("charge_transfer_resistance", "impedance", "diffusion_coefficient")
#: Characters of a failure summary.
SUMMARY_CHARS = 2000


def empty_state(paper_types: Column, admitted: Column, quarantined: Column, results: Column) -> Column:
    """(kind, title) of an archive without results; null if it has some."""
    kinds = F.coalesce(paper_types, F.array().cast("array<string>"))
    review = F.exists(kinds, lambda k: F.lower(k) == "review")
    held = (F.coalesce(admitted, F.lit(0)) == 0) & (F.coalesce(quarantined, F.lit(0)) > 0)
    kind = F.when(F.coalesce(review, F.lit(False)), "review_no_focal_data").when(held, "quarantined_only").otherwise("no_structured_results")
    title = F.try_element_at(F.create_map(*(F.lit(x) for pair in EMPTY_TITLES.items() for x in pair)), kind)
    return F.when(F.coalesce(results, F.lit(0)) == 0, F.struct(kind.alias("kind"), title.alias("title")))


def condition_reviews(prop: Column, cycle: Column, rate: Column, method: Column) -> Column:
    """What a value lacks that its property needs, in a fixed order; an empty list if nothing."""
    return F.array_compact(F.array(
        F.when((prop == "capacity_retention") & cycle.isNull(), "retention has no associated cycle"),
        F.when((prop == "specific_capacity") & cycle.isNull() & rate.isNull(), "capacity has neither cycle nor C-rate association"),
        F.when(prop.isin(*METHOD_BOUND) & (F.coalesce(method, F.lit("")) == ""), "impedance/transport value has no method association"),
    ))


def review_due(document_type: Column, values: Column, synthesised: Column) -> Column:
    """A review that holds values or syntheses has to be read by someone."""
    return F.coalesce(F.contains(document_type, F.lit("review")), F.lit(False)) & ((values > 0) | (synthesised > 0))


def evidence_coverage(records: DataFrame, by: list[str], evidence: str = "evidence") -> DataFrame:
    """Shares of records with evidence and with verbatim evidence, and of snippets that are verbatim.

    A share of nothing is 0. Items without a snippet are evidence, but no snippet.
    """
    snippets = F.filter(F.coalesce(evidence, F.filter(evidence, lambda e: F.lit(False))), lambda e: F.coalesce(e["text_snippet"], F.lit("")) != "")
    found = F.coalesce(F.size(snippets), F.lit(0))
    verified = F.coalesce(F.size(F.filter(snippets, lambda e: F.coalesce(e["verbatim_match"], F.lit(False)))), F.lit(0))
    rows = records.select(*by, (F.coalesce(F.size(evidence), F.lit(0)) > 0).alias("_has"), F.greatest(found, F.lit(0)).alias("_found"), F.greatest(verified, F.lit(0)).alias("_verified"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("_has").alias("with_evidence"), F.count_if(F.col("_verified") > 0).alias("with_verbatim"),
        F.sum("_found").alias("snippets"), F.sum("_verified").alias("verified"),
    )
    share = lambda n, of: F.round(F.col(n) / F.greatest(F.col(of), F.lit(1)), 3)
    return sums.select(
        *by, "records", "with_evidence", share("with_evidence", "records").alias("record_coverage"), "with_verbatim",
        share("with_verbatim", "records").alias("verbatim_record_coverage"), "snippets", share("verified", "snippets").alias("verbatim_match_coverage"),
    )


def quantitative_totals(measurements: DataFrame, by: list[str], signature: list[str]) -> DataFrame:
    """Values, verbatim ones, and repeats of a signature, among all values and among outputs alone.

    Values are first counted by signature, so a signature that repeats often is summed before it is
    shuffled; null fields are alike.
    """
    output = (F.col("kind") == "scientific_output").cast("int")
    per = measurements.filter("value is not null").groupBy(*by, *signature).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(output), F.lit(0)).alias("_out"), F.count_if("verbatim").alias("_verbatim")
    )
    return per.groupBy(*by).agg(
        F.sum("_n").alias("quantitative_values"), F.sum("_verbatim").alias("verbatim_values"), F.sum(F.col("_n") - 1).alias("repeated"),
        F.sum(F.greatest(F.col("_out") - 1, F.lit(0))).alias("repeated_outputs"),
    )


def failure_summary(attempts: DataFrame, by: str, order: str) -> DataFrame:
    """One text for each run: how often each class of failure came, then its attempts in order.

    Classes and attempts are those of one run, a handful; ``model``, ``failure_class`` and ``message``
    may be null.
    """
    kind = F.coalesce("failure_class", F.lit("unknown"))
    told = F.concat(F.coalesce("model", F.lit("unknown")), F.lit(": "), kind, F.coalesce(F.concat(F.lit(" ("), F.nullif("message", F.lit("")), F.lit(")")), F.lit("")))
    runs = attempts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order), told.alias("told")))).alias("a"))
    counts = attempts.groupBy(by, kind.alias("k")).count().groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", "count"))).alias("c"))
    of = F.array_join(F.transform("c", lambda x: F.concat(x["k"], F.lit("="), x["count"].cast("string"))), ", ")
    text = F.concat(F.lit("Failure summary: "), of, F.lit(". Attempts: "), F.array_join(F.transform("a", lambda x: x["told"]), "; "))
    return runs.join(counts, by).select(by, F.substring(text, 1, SUMMARY_CHARS).alias("summary"))


def primary_parser(pages: DataFrame, by: str, parsers: list[str]) -> DataFrame:
    """The parser that most of a source's pages come from, the earlier of ``parsers`` on a tie; null if none is known."""
    counts = pages.groupBy(by).agg(*(F.count_if(F.col("parser") == p).alias(p) for p in parsers))
    best = F.array_max(F.array(*(F.struct(F.col(p).alias("n"), F.lit(-i).alias("i"), F.lit(p).alias("parser")) for i, p in enumerate(parsers))))
    return counts.select(by, F.when(best["n"] > 0, best["parser"]).alias("parser"))


def provider_runs(runs: DataFrame, identifier) -> DataFrame:
    """Runs as they may be shown: identifiers that ``identifier`` lets through, a score only where a payload came back."""
    domain = identifier(F.col("domain"))
    shown = [identifier(F.col(c)).alias(c) for c in ("provider", "model", "run_id")]
    payload = F.coalesce("payload", F.lit(False))
    return runs.filter(domain.isNotNull()).select(
        domain.alias("domain"), *shown, payload.alias("payload"), F.when(payload, F.col("score").cast("string")).otherwise("N/A").alias("score"),
        F.coalesce(F.col("schema_valid").cast("string"), F.lit("not standardized")).alias("schema_valid"),
    )


def first_of(aliases: list[str], reported: Column) -> Column:
    """The count under the first alias that a map of lists reports; null if it reports none."""
    return F.coalesce(*(F.when(F.map_contains_key(reported, F.lit(a)), F.size(F.try_element_at(reported, F.lit(a)))) for a in aliases))


def corpus_summary(cases: DataFrame, flags: dict[str, Column], sums: list[str]) -> DataFrame:
    """One row over all cases: their number, how many hold each flag, totals, and the share that is complete."""
    out = cases.agg(F.count(F.lit(1)).alias("cases"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    return out.select("*", *(O.ratio(F.col(n), F.col("cases")).alias(f"{n}_share") for n in flags))


def shown_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs as they may be shown: plain identifiers, file names without paths or keys, a prefix of checksums, and what is uncertain.

    ``jobs``: job_id, run_id, state, domain, provider, model, error_class, created_at, filename, sha256, uncertain_action (of an action whose
    outcome is not known, or null).
    """
    from ..functions.text import redact, safe_identifier

    plain = [safe_identifier(F.col(c)).alias(c) for c in ("job_id", "run_id", "state", "domain", "provider", "model", "error_class")]
    words = lambda c: F.replace(safe_identifier(F.col(c)), F.lit("_"), F.lit(" "))
    name = F.col("filename")
    bare = (F.char_length(name) <= 255) & ~F.rlike(name, F.lit(r"[/\\\\\x00-\x1f]")) & (name != "") & ~name.isin(".", "..")
    open_ = (F.col("state") == "RECONCILIATION_REQUIRED") | ((F.col("state") == "WAITING_PROVIDER") & F.col("uncertain_action").isNotNull())
    uncertain = F.coalesce(open_, F.lit(False))
    return jobs.select(
        *plain, "created_at", words("error_class").alias("error_summary"), F.initcap(words("state")).alias("stage"), F.when(bare, F.regexp_replace(redact(name), "sk-[A-Za-z0-9_-]{8,}", "[REDACTED]")).alias("source_filename"),
        F.when(F.rlike("sha256", F.lit("^[0-9a-f]{64}$")), F.substring("sha256", 1, 12)).alias("source_sha256_prefix"), uncertain.alias("reconciliation_required"),
        F.when(uncertain, "outcome_uncertain").otherwise(words("error_class")).alias("status_reason"),
    )


def frozen_runs(runs: DataFrame, manifest: DataFrame, fields: list[str]) -> DataFrame:
    """``runs`` with what a manifest has frozen for exactly their case, run and model; null where it has nothing, the greatest entry of several."""
    key = ["case_id", "run_id", "exact_model"]
    one = manifest.groupBy(*key).agg(F.max(F.struct(*fields)).alias("_f"))
    return runs.join(one, key, "left").select(*runs.columns, *(F.col(f"_f.{f}").alias(f) for f in fields))
