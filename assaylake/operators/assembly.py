"""From drafts to admitted records: gates, local references to stable ids, edges, and what is refused.

Drafts are flat tables keyed by ``source_id``: every record has a local id, an owner, evidence and lists
of local references. All steps are joins over the whole corpus; refused records go to one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import stable_id
from . import frames as O

#: Domains whose evidence has to be verbatim.
STRICT = ("mechanical", "additive_manufacturing", "photovoltaics", "thermoelectrics", "membranes", "semiconductors", "biomaterials")


def gate_reason(strict: bool) -> Column:
    """Owner first, then evidence: a snippet, and for strict domains a verbatim one."""
    good = lambda e: (F.length(F.coalesce(e["text_snippet"], F.lit(""))) > 0) & (F.coalesce(e["verbatim_match"], F.lit(False)) if strict else F.lit(True))
    return O.ladder([(F.col("ownership") != "focal_work", F.concat(F.lit("ownership_"), F.col("ownership"))), (~F.coalesce(F.exists("evidence", good), F.lit(False)), "no_source_evidence")])


def resolve_refs(records: DataFrame, refs: str, ids: DataFrame, out: str) -> DataFrame:
    """``out``: the stable ids of a list of local references in their order, and ``<out>_all`` whether all resolve."""
    rows = records.select("source_id", "local_id", F.posexplode(refs).alias("p", "ref"))
    hits = rows.join(ids.select("source_id", F.col("local_id").alias("ref"), "stable"), ["source_id", "ref"])
    found = hits.groupBy("source_id", "local_id").agg(O.ordered_list(F.col("stable"), F.col("p")).alias(out))
    got = records.join(found, ["source_id", "local_id"], "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    return got.withColumn(f"{out}_all", F.size(out) == F.coalesce(F.size(refs), F.lit(0)))


def assemble(drafts: dict[str, DataFrame], domain: str) -> dict[str, DataFrame]:
    """materials, processes, experiments (admitted), edges and quarantine.

    ``drafts`` has ``materials`` (source_id, local_id, formula, ownership, evidence), ``processes`` (name,
    inputs, outputs) and ``experiments`` (kind, material_refs). A process or experiment with a
    reference that was not admitted is refused as a whole.
    """
    strict = domain in STRICT
    refused = []

    def gated(name: str) -> DataFrame:
        rows = drafts[name].withColumn("reason", gate_reason(strict))
        refused.append(rows.filter("reason is not null").select(F.lit(name).alias("kind"), "source_id", "local_id", "ownership", "reason"))
        return rows.filter("reason is null").drop("reason")

    def depending(rows: DataFrame, name: str, flags: list[str]) -> DataFrame:
        whole = O.all_of(*(F.col(f) for f in flags))
        refused.append(rows.filter(~whole).select(F.lit(name).alias("kind"), "source_id", "local_id", "ownership", F.lit("entity_dependencies_not_admitted").alias("reason")))
        return rows.filter(whole).drop(*flags)

    materials = gated("materials").withColumn("stable", stable_id("mat", F.col("formula"), F.col("source_id"), F.col("local_id")))
    ids = materials.select("source_id", "local_id", "stable")
    processes = resolve_refs(resolve_refs(gated("processes"), "inputs", ids, "input_ids"), "outputs", ids, "output_ids")
    processes = depending(processes, "processes", ["input_ids_all", "output_ids_all"]).withColumn("stable", stable_id("proc", F.col("source_id"), F.col("local_id"), F.col("name")))
    experiments = depending(resolve_refs(gated("experiments"), "material_refs", ids, "material_ids"), "experiments", ["material_ids_all"])
    experiments = experiments.withColumn("stable", stable_id("exp", F.col("source_id"), F.col("local_id"), F.col("kind")))
    edge = lambda df, a, predicate, b: df.select("source_id", a.alias("subject_id"), F.lit(predicate).alias("predicate"), b.alias("object_id"))
    made = processes.withColumn("m", F.explode("output_ids"))
    edges = [
        edge(processes.withColumn("m", F.explode("input_ids")), F.col("m"), "input_to", F.col("stable")), edge(made, F.col("m"), "processed_by", F.col("stable")), edge(made, F.col("stable"), "produces", F.col("m")),
        edge(experiments.withColumn("m", F.explode("material_ids")), F.col("m"), "tested_in", F.col("stable")), edge(experiments, F.col("stable"), "reported_by", F.col("source_id")),
    ]
    edges = reduce(lambda a, b: a.unionByName(b), edges).distinct()
    edges = edges.withColumn("relation_id", stable_id("rel", F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    return {"materials": materials, "processes": processes, "experiments": experiments, "edges": edges, "quarantine": reduce(lambda a, b: a.unionByName(b), refused)}


def resolve_protocol(groups: DataFrame, protocols: DataFrame, fields: list[str]) -> DataFrame:
    """Groups with each protocol field: inline if given, else from the first shared protocol that has it."""
    refs = groups.select("group_id", F.posexplode("protocol_refs").alias("p", "protocol_id")).join(protocols, "protocol_id")
    shared = refs.groupBy("group_id").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("p"))).alias(f"_{f}") for f in fields))
    out = groups.join(shared, "group_id", "left")
    return out.select(*(F.coalesce(c, F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in groups.columns))


def share_components(groups: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shared protocols, groups that refer to them): a payload that two groups or more have is kept once."""
    long = groups.unpivot(["group_id"], fields, "field", "payload").filter("payload is not null").withColumn("protocol_id", stable_id("prot", F.col("field"), F.col("payload")))
    shared = long.groupBy("protocol_id", "field", "payload").agg(F.countDistinct("group_id").alias("groups")).filter("groups >= 2")
    refs = long.join(shared.select("protocol_id"), "protocol_id").groupBy("group_id").agg(F.sort_array(F.collect_set("protocol_id")).alias("protocol_refs"), F.collect_set("field").alias("_moved"))
    out = groups.join(refs, "group_id", "left")
    left = [F.when(F.coalesce(F.array_contains("_moved", f), F.lit(False)), F.lit(None)).otherwise(F.col(f)).alias(f) for f in fields]
    return shared.drop("groups"), out.select("group_id", *left, F.coalesce("protocol_refs", F.array().cast("array<string>")).alias("protocol_refs"))


def completeness(checks: list[tuple[Column, Column]]) -> Column:
    """Share of the checks that hold, of those that apply."""
    applies = [F.coalesce(a, F.lit(False)).cast("int") for a, _ in checks]
    holds = [(F.coalesce(a, F.lit(False)) & F.coalesce(h, F.lit(False))).cast("int") for a, h in checks]
    return sum(holds, F.lit(0)) / F.greatest(sum(applies, F.lit(0)), F.lit(1))


def admitted_share(completeness_: Column, admitted: Column, quarantined: Column) -> Column:
    """Completeness scaled by the share of candidates that were admitted."""
    return completeness_ * O.ratio(admitted, admitted + quarantined, None, 1.0)


def marked_text(pages: DataFrame, most_chars: int = 180_000) -> DataFrame:
    """source_id, text: pages with markers, cut after so many characters in page order."""
    from pyspark.sql import Window

    piece = F.concat(F.lit("\n\n===== PAGE "), F.col("page").cast("string"), F.lit(" =====\n"), F.coalesce("text", F.lit("")))
    w = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("piece", piece).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))).filter(F.col("before") < most_chars)
    rows = rows.withColumn("piece", F.expr(f"substring(piece, 1, {most_chars} - cast(before as int))"))
    return rows.groupBy("source_id").agg(F.array_join(O.ordered_list(F.col("piece"), F.col("page")), "").alias("text"))


def split_marked(texts: DataFrame) -> DataFrame:
    """source_id, page, text: the pages of a marked text."""
    parts = F.split("text", r"\n*===== PAGE (?=\d+ =====)")
    rows = texts.select("source_id", F.explode(F.slice(parts, 2, 1 << 30)).alias("part"))
    return rows.select("source_id", F.regexp_extract("part", r"^(\d+) =====", 1).cast("int").alias("page"), F.trim(F.regexp_replace("part", r"^\d+ =====\n?", "")).alias("text"))


def relevant_tables(tables: DataFrame, terms: list[str], most: int = 8) -> DataFrame:
    """A source's tables with most term hits, then by page and id."""
    from pyspark.sql import Window

    hits = sum((X.term_count(F.lower(F.coalesce("text", F.lit(""))), t) for t in terms), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("hits").desc(), "page", "table_id"))
    return tables.withColumn("hits", hits).withColumn("rank", rank).filter(F.col("rank") <= most)


def candidate_coverage(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """candidate_id, covered, missing, reason: is a numeric statement's every number in a record with its evidence?

    Candidates and record evidence meet by source, page and origin; then their snippets overlap.
    """
    key = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.11e", F.replace(c, F.lit(","), F.lit("")).try_cast("double")), r"0+e", "e"), r"\.e", "e")
    keys = lambda values: F.array_compact(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.when(v.rlike(r"\d"), key(F.regexp_extract(v, r"[-+]?\d+(?:[,.]\d+)*", 0)))))
    r = records.select("source_id", "page", "origin", F.col("snippet").alias("_snippet"), keys(F.col("numbers")).alias("_numbers"))
    hits = candidates.join(r, ["source_id", "page", "origin"], "left").withColumn("_hit", F.coalesce(X.snippet_overlap(F.col("snippet"), F.col("_snippet")), F.lit(False)))
    per = hits.groupBy("candidate_id", "numbers").agg(F.max("_hit").alias("matched"), F.flatten(F.collect_list(F.when(F.col("_hit"), F.col("_numbers")))).alias("observed"))
    missing = F.array_except(keys(F.col("numbers")), F.col("observed"))
    reason = F.when(~F.col("matched"), "no_contextual_evidence_match").when(F.size(missing) > 0, "evidence_linked_missing_numeric_spans").otherwise("evidence_linked_all_numeric_spans")
    return per.select("candidate_id", (F.col("matched") & (F.size(missing) == 0)).alias("covered"), missing.alias("missing"), reason.alias("reason"))
