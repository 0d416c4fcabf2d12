"""Archives as flat tables: measurements, results, integrity, quality, search, graph and exchange projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import export_id
from ..functions.text import csv_cell
from . import frames as O
from .analytic import _as_text, measured_conditions, merge_layers, point_conditions
from .evidence import semantics

def _id() -> Column:
    return F.col("metadata.archive_id").alias("archive_id")


def explode_list(archives: DataFrame, name: str) -> DataFrame:
    """One row for each member of a record list, with its place."""
    return archives.select(_id(), F.posexplode(name).alias("position", "r")).select("archive_id", "position", "r.*")


def silver(archives: DataFrame) -> dict[str, DataFrame]:
    """One flat table for each record list, and ``measurements`` and ``evidence`` across them."""
    names = ("sources", "materials", "devices", "processes", "experiments", "calculations", "relationships", "domain_payloads")
    return {n: explode_list(archives, n) for n in names} | {"measurements": measurements(archives), "evidence": evidence_rows(archives)}


#: Record list, its measurement lists, and what a measurement of each is.
_BRANCHES = (
    ("processes", "process_id", "process", (("parameters", "parameter"),)),
    ("experiments", "experiment_id", "experiment", (("conditions", "condition"), ("outputs", "result"))),
    ("calculations", "calculation_id", "calculation", (("parameters", "parameter"), ("outputs", "result"))),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def measurements(archives: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """Every measurement of an archive with its record, role and place, and its record's conditions; ``carried`` columns of the archive beside it."""
    out, more = [], carried or {}
    for name, key, kind, lists in _BRANCHES:
        for field, role in lists:
            rows = archives.select(_id(), F.col("metadata.domain").alias("domain"), *(c.alias(a) for a, c in more.items()), F.explode(name).alias("r"))
            parent = F.col(f"r.{'conditions' if kind == 'experiment' else 'parameters'}")
            materials = F.col("r.outputs") if kind == "process" else F.col("r.material_ids")
            label = {"process": "name", "experiment": "experiment_type", "calculation": "calculation_type"}[kind]
            out.append(rows.select(
                "archive_id", "domain", F.lit(kind).alias("record_type"), F.lit(role).alias("measurement_role"), F.col(f"r.{key}").alias("parent_id"), F.col(f"r.{label}").alias("parent_label"),
                (F.col("r.target") if kind == "experiment" else F.lit(None).cast("string")).alias("reaction"), materials.alias("material_ids"), measured_conditions(parent).alias("parent_conditions"), *more, F.posexplode(f"r.{field}").alias("ordinal", "m"),
            ))
    return _union(out)


def _first(conditions: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(conditions, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def results(archives: DataFrame) -> DataFrame:
    """The public result rows of admitted measurements, with source, materials, conditions and first evidence.

    Ids of materials that an archive does not hold are dropped; the order of the others is kept.
    """
    state = lambda m: F.coalesce(F.try_variant_get(m["structure"], "$.catalyst_state", "string"), m["phase"])
    known = F.transform("materials", lambda m: F.named_struct(F.lit("material_id"), m["material_id"], F.lit("name"), m["name"], F.lit("formula"), m["formula"], F.lit("state"), state(m)))
    sources = F.transform("sources", lambda s: F.struct(s["source_id"].alias("source_id"), s["title"].alias("title"), s["doi"].alias("doi")))
    rows = measurements(archives, {"known": known, "listed": sources}).withColumn("record_id", export_id("meas", F.col("parent_id"), F.col("measurement_role"), F.col("ordinal").cast("string"), F.to_json("m")))
    rows = rows.withColumn("x", F.flatten(F.transform("material_ids", lambda i: F.filter("known", lambda k: k["material_id"] == i))))
    held = (("material_ids", "material_id"), ("material_names", "name"), ("material_formulas", "formula"), ("material_states", "state"))
    rows = rows.withColumns({b: O.pipe_join(F.col(f"x.{a}")) for b, a in held})
    e = F.try_element_at("m.evidence", F.lit(1))
    own = F.try_element_at(F.filter("listed", lambda s: s["source_id"] == e["source_id"]), F.lit(1))
    rows = rows.withColumn("s", F.coalesce(own, F.try_element_at("listed", F.lit(1))))
    rows = rows.withColumn("c", merge_layers(F.col("parent_conditions"), point_conditions(F.col("m.conditions"))))
    own = F.coalesce(F.nullif(F.col("m.raw_value"), F.lit("")), F.trim(F.concat_ws(" ", _as_text(F.col("m.value")), F.col("m.unit"))), F.lit(""))
    self = lambda name: F.coalesce(F.nullif(_first(F.col("c"), name), F.lit("")), F.when(F.col("m.property") == name, own), F.lit(""))
    strength, text = semantics(e), lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "archive_id", "record_id", "record_type", "measurement_role", "parent_id", "ordinal", text(F.col("s.source_id")).alias("source_id"), text(F.col("s.title")).alias("source_title"), text(F.col("s.doi")).alias("doi"),
        e["page"].alias("source_page"), text(F.col("domain")).alias("domain"), F.lit("focal_work").alias("ownership"), F.lit("canonical").alias("admission_status"),
        *(text(F.col(c)).alias(c) for c in ("material_ids", "material_names", "material_formulas", "material_states")), F.when(F.col("record_type") == "experiment", F.col("parent_label")).otherwise("").alias("experiment_type"),
        F.coalesce(F.nullif(F.col("reaction"), F.lit("")), _first(F.col("c"), "reaction", "reaction_class")).alias("reaction"), F.col("m.property").alias("metric"), _first(F.col("c"), "product").alias("product"),
        _as_text(F.col("m.value")).alias("value"), "m.raw_value", "m.qualifier", "m.unit", _as_text(F.col("m.normalized_value")).alias("normalized_value"), "m.normalized_unit", "m.uncertainty", "m.uncertainty_unit",
        *(self(n).alias(n) for n in ("temperature", "pressure", "duration", "time_on_stream")), F.coalesce(F.nullif(_first(F.col("c"), "reported_potential_raw", "potential"), F.lit("")), self("potential")).alias("potential"),
        _first(F.col("c"), "reported_reference", "reference_electrode").alias("reference_electrode"), _first(F.col("c"), "electrolyte").alias("electrolyte"), _first(F.col("c"), "pH", "ph").alias("pH"),
        _first(F.col("c"), "normalization_basis", "normalization_key").alias("normalization_basis"), "m.method", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("c")))).alias("conditions_json"),
        F.coalesce(e["original_source_type"], e["source_type"], F.lit("")).alias("evidence_origin"), e["page"].alias("evidence_page"), text(e["text_snippet"]).alias("evidence_snippet"), strength["strength"].alias("evidence_strength"), strength["estimated"].alias("estimated"),
    )


_QUARANTINE = "array<struct<kind:string,record:string,property:string,raw_value:string,unit:string,reason:string>>"


def quarantine(archives: DataFrame) -> DataFrame:
    """Refused candidates of all payload places, each entry of a payload once, at its first place."""
    places = ("quarantine", "audit.quarantine", "provider.quarantine", "extraction.quarantine")
    payload = archives.select(_id(), F.col("metadata.domain").alias("domain"), F.posexplode("domain_payloads").alias("payload", "d"))
    lists = [F.coalesce(F.try_variant_get("d.values", f"$.{p}", _QUARANTINE), F.array().cast(_QUARANTINE)) for p in places]
    rows = payload.select("archive_id", "domain", "payload", F.posexplode(F.concat(*lists)).alias("ordinal", "q"))
    rows = rows.groupBy("archive_id", "domain", "payload", F.to_json("q").alias("signature")).agg(F.min("ordinal").alias("ordinal"), F.min_by("q", "ordinal").alias("q"))
    return rows.select(
        "archive_id", "domain", export_id("quar", F.col("archive_id"), F.col("payload").cast("string"), F.col("ordinal").cast("string"), F.col("signature")).alias("record_id"), F.coalesce("q.kind", F.lit("measurement")).alias("record_type"),
        F.lit("quarantined").alias("admission_status"), F.col("q.property").alias("metric"), "q.raw_value", "q.unit", F.col("q.reason").alias("quarantine_reason"),
    )


def all_results(archives: DataFrame, include_quarantined: bool = False, order: bool = False) -> DataFrame:
    """Result rows, with the refused ones if asked for; sorted only if asked for."""
    out = results(archives)
    if include_quarantined:
        out = out.unionByName(quarantine(archives), allowMissingColumns=True)
    return out.orderBy("admission_status", "record_id") if order else out


#: Record lists whose records bear evidence in the evidence table; devices' is not listed there.
_EVIDENCED = {"materials": "material_id", "processes": "process_id", "experiments": "experiment_id", "calculations": "calculation_id", "relationships": "relation_id"}


_EVIDENCE_FIELDS = ("source_id", "page", "section", "source_type", "original_source_type", "verbatim_match", "text_snippet", "table_id", "figure_id", "locator", "confidence")


def evidence_rows(archives: DataFrame) -> DataFrame:
    """Each evidence item with the record that it supports."""
    out = [
        archives.select(_id(), F.explode(name).alias("r")).select("archive_id", F.lit(name[:-1] if name != "processes" else "process").alias("linked_record_type"), F.col(f"r.{key}").alias("linked_record_id"), F.posexplode("r.evidence").alias("ordinal", "e"))
        for name, key in _EVIDENCED.items()
    ]
    m = measurements(archives)
    out.append(m.select("archive_id", F.lit("measurement").alias("linked_record_type"), F.concat_ws(":", "parent_id", "measurement_role", F.col("ordinal").cast("string")).alias("linked_record_id"), F.col("m.evidence").alias("ev")).select("archive_id", "linked_record_type", "linked_record_id", F.posexplode("ev").alias("ordinal", "e")))
    rows = _union(out)
    strength = semantics(F.col("e"))
    return rows.select(export_id("ev", F.col("linked_record_id"), F.col("ordinal").cast("string"), F.to_json("e")).alias("evidence_id"), "archive_id", "linked_record_type", "linked_record_id", *(f"e.{c}" for c in _EVIDENCE_FIELDS), strength["strength"].alias("evidence_strength"), strength["estimated"].alias("estimated"))


def integrity_violations(archives: DataFrame) -> DataFrame:
    """rule, archive_id, record_id, missing_id of each reference that resolves to nothing in its archive.

    An archive is one row: its references are held against its own lists, and only archives with a missing one go on.
    """
    ids = lambda *fields: F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields))
    known = ids("materials.material_id", "devices.device_id", "sources.source_id", "processes.process_id", "experiments.experiment_id", "calculations.calculation_id", F.array("metadata.archive_id"))

    def rule(name: str, records: str, key: str, refs: Callable, parents: Column) -> DataFrame:
        made = F.filter(F.transform(records, refs), lambda x: x.isNotNull())
        rows = archives.select(_id(), F.array_except(F.flatten(made), parents).alias("missing"), F.col(records).alias("rs"))
        rows = rows.filter(F.size("missing") > 0).select("archive_id", "missing", F.explode("rs").alias("r"))
        rows = rows.select(F.lit(name).alias("rule"), "archive_id", F.col(f"r.{key}").alias("record_id"), F.explode(F.array_intersect(refs(F.col("r")), "missing")).alias("missing_id"))
        return rows.filter("missing_id is not null").distinct()

    materials = ids("materials.material_id")
    return _union([
        rule("device_materials", "devices", "device_id", lambda r: r["material_ids"], materials), rule("experiment_materials", "experiments", "experiment_id", lambda r: r["material_ids"], materials),
        rule("experiment_devices", "experiments", "experiment_id", lambda r: F.array_union(F.coalesce(r["device_ids"], F.array().cast("array<string>")), F.array(r["device_id"])), ids("devices.device_id")),
        rule("calculation_materials", "calculations", "calculation_id", lambda r: r["material_ids"], materials), rule("process_outputs", "processes", "process_id", lambda r: r["outputs"], ids("materials.material_id", "devices.device_id")),
        rule("relationship_ends", "relationships", "relation_id", lambda r: F.array(r["subject_id"], r["object_id"]), known),
    ])


def quality(archives: DataFrame) -> DataFrame:
    """Coverage ratios of each archive; a ratio without a denominator keeps the archive's old value."""
    m = measurements(archives).select("archive_id", F.lit(True).alias("measured"), "m.evidence", F.to_json("m.value").isNotNull().alias("valued"), "m.unit", F.to_json("m.normalized_value").isNotNull().alias("normal"), "m.normalized_unit")
    records = [archives.select(_id(), F.explode(n).alias("r")).select("archive_id", F.lit(False).alias("measured"), F.col("r.evidence").alias("evidence")) for n in ("materials", "devices", "processes", "experiments", "calculations", "relationships")]
    rows = _union([m, *records])
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    candidate = F.coalesce(F.col("valued"), F.lit(False)) & has(F.col("unit"))
    confidence = F.expr("filter(transform(evidence, e -> e.confidence), x -> x is not null)")
    got = rows.withColumn("cs", F.coalesce(confidence, F.array().cast("array<double>"))).groupBy("archive_id").agg(
        O.ratio(F.count_if(F.size("evidence") > 0), F.count(F.lit(1))).alias("provenance"), O.ratio(F.count_if(candidate & F.col("normal") & has(F.col("normalized_unit"))), F.count_if(candidate)).alias("normalization"),
        O.ratio(F.sum(F.aggregate("cs", F.lit(0.0), lambda a, x: a + x)), F.sum(F.size("cs"))).alias("confidence"), F.count_if("measured").alias("n"),
    )
    some = lambda *names: reduce(lambda a, b: a | b, (F.size(n) > 0 for n in names)).cast("int")
    blocks = some("sources") + some("materials", "devices") + some("processes", "experiments", "calculations") + some("domain_payloads")
    out = archives.select(_id(), "quality", blocks.alias("blocks")).join(got, "archive_id", "left")
    return out.select(
        "archive_id", F.coalesce("provenance", "quality.provenance_coverage").alias("provenance_coverage"), F.coalesce("normalization", "quality.unit_normalization_coverage").alias("unit_normalization_coverage"),
        ((F.col("blocks") + (F.coalesce("n", F.lit(0)) > 0).cast("int")) / 5).alias("completeness"), F.coalesce("confidence", "quality.extraction_confidence").alias("extraction_confidence"), F.lit("schema_validated").alias("validation_status"),
    )


def search(archives: DataFrame, *, domain=None, element=None, formula_contains=None, property=None, target=None, year_min=None, year_max=None) -> DataFrame:
    """Archives that meet all given predicates; archives without a year pass year bounds."""
    tests = []
    if domain:
        tests.append(F.col("metadata.domain") == domain)
    if element:
        tests.append(F.exists("materials", lambda m: F.array_contains(m["elements"], element)))
    if formula_contains:
        tests.append(F.exists("materials", lambda m: F.contains(F.lower(F.coalesce(m["formula"], F.lit(""))), F.lit(formula_contains.lower()))))
    if property:
        named = lambda r: F.exists(r["outputs"], lambda m: m["property"] == property)
        tests.append(F.coalesce(F.exists("experiments", named), F.lit(False)) | F.coalesce(F.exists("calculations", named), F.lit(False)))
    if target:
        tests.append(F.exists("experiments", lambda e: F.lower(F.coalesce(e["target"], F.lit(""))) == target.lower()))
    years = F.filter("sources.year", lambda y: y.isNotNull() & (y != 0))
    if year_min:
        tests.append(F.coalesce(F.array_max(years) >= year_min, F.lit(True)))
    if year_max:
        tests.append(F.coalesce(F.array_min(years) <= year_max, F.lit(True)))
    return archives.filter(O.all_of(*(F.coalesce(t, F.lit(False)) for t in tests)))


SCOPES = ("all_archives", "current_extraction", "selected_sources", "current_domain", "custom_combination")


def select_scope(archives: DataFrame, scope: str, *, archive_ids=(), source_ids=(), domain=None, properties=(), record_types=(), current=None, run_id=None) -> DataFrame:
    """Archives of a scope. A scope whose selection is empty is empty; it never widens.

    ``current`` is the last extraction: (run id, archive ids).
    """
    none = archives.filter(F.lit(False))
    if scope == "current_extraction":
        if current is None or (run_id and run_id != current[0]):
            return none
        archive_ids = current[1]
    elif (scope == "selected_sources" and not source_ids) or (scope == "current_domain" and not domain) or (scope == "custom_combination" and not (archive_ids or source_ids)):
        return none
    any_in = lambda values, wanted: F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False))
    tests = []
    if archive_ids:
        tests.append(F.col("metadata.archive_id").isin(*archive_ids))
    if source_ids:
        tests.append(any_in(F.col("sources.source_id"), source_ids))
    if domain:
        tests.append(F.coalesce("metadata.domain", F.lit("unknown_legacy")) == domain)
    if properties:
        outputs = F.expr("flatten(concat(coalesce(transform(experiments, r -> r.outputs.property), array()), coalesce(transform(calculations, r -> r.outputs.property), array())))")
        tests.append(any_in(outputs, properties))
    if record_types:
        tests.append(any_in(F.concat(F.coalesce("experiments.experiment_type", F.array().cast("array<string>")), F.coalesce("calculations.calculation_type", F.array().cast("array<string>"))), record_types))
    return archives.filter(O.all_of(*tests))


def domain_rollup(archives: DataFrame, catalog: list[str]) -> DataFrame:
    """Archives, distinct papers, records and the last date of each domain, catalogued ones without archives included."""
    papers = archives.select(F.coalesce("metadata.domain", F.lit("unknown_legacy")).alias("domain"), _id(), F.posexplode_outer("sources").alias("p", "s"))
    papers = papers.groupBy("domain").agg(F.countDistinct(F.coalesce("s.source_id", F.concat_ws(":", "archive_id", F.col("p").cast("string")))).alias("papers"))
    sizes = {n: F.sum(F.coalesce(F.size(n), F.lit(0))).alias(n) for n in ("materials", "experiments", "calculations")}
    got = archives.groupBy(F.coalesce("metadata.domain", F.lit("unknown_legacy")).alias("domain")).agg(F.count(F.lit(1)).alias("archives"), *sizes.values(), F.max("metadata.created_at").alias("latest"))
    names = archives.sparkSession.createDataFrame([(d,) for d in catalog], "domain string").unionByName(got.select("domain")).distinct()
    return names.join(got, "domain", "left").join(papers, "domain", "left").fillna(0, ["archives", "papers", *sizes])


def paper_summary(archives: DataFrame) -> DataFrame:
    """One row for each paper: title, DOI and numbers of records."""
    s = F.try_element_at("sources", F.lit(1))
    n = lambda name: F.coalesce(F.size(name), F.lit(0)).alias(name)
    return archives.select(_id(), F.coalesce(s["title"], "metadata.archive_id", F.lit("Untitled extraction")).alias("title"), F.coalesce("metadata.domain", F.lit("unknown")).alias("domain"), s["source_id"].alias("source_id"), s["doi"].alias("doi"), *map(n, ("materials", "devices", "processes", "experiments", "calculations", "relationships")))


FILTER_FIELDS = ("domain", "source_title", "material_names", "experiment_type", "reaction", "metric", "product", "admission_status", "ownership", "evidence_origin")
SEARCH_FIELDS = ("material_names", "material_formulas", "metric", "reaction", "product", "evidence_snippet")


def _tokens(c: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda t: t != "")


def filter_results(rows: DataFrame, selected: dict[str, list[str]] | None = None, estimated: bool | None = None, text: str = "") -> DataFrame:
    """Result rows by case-blind choices, the estimated flag and a text in any search field."""
    tests = []
    for field, choices in (selected or {}).items():
        wanted = [x.casefold() for x in choices]
        if not wanted:
            continue
        if field == "material_names":
            held = F.transform(F.concat(*map(_tokens, ("material_names", "material_formulas", "material_ids"))), F.lower)
            tests.append(F.arrays_overlap(held, F.array(*map(F.lit, wanted))))
        else:
            tests.append(F.lower(F.coalesce(field, F.lit(""))).isin(*wanted))
    if estimated is not None:
        tests.append(F.coalesce(F.col("estimated"), F.lit(False)) == estimated)
    if text.strip():
        tests.append(O.any_of(*(F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(text.strip().lower())) for f in SEARCH_FIELDS)))
    return rows.filter(O.all_of(*tests))


def filter_options(rows: DataFrame) -> DataFrame:
    """field, choice of everything that occurs."""
    plain = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("choice")) for f in FILTER_FIELDS if f != "material_names"]
    out = rows.select(F.explode(F.array(*plain)).alias("x")).select("x.*").filter("choice <> ''")
    tokens = rows.select(F.lit("material_names").alias("field"), F.explode(F.concat(*map(_tokens, ("material_names", "material_formulas", "material_ids")))).alias("choice"))
    return out.unionByName(tokens).distinct()


def researcher_status() -> Column:
    admission, strength = F.lower(F.coalesce("admission_status", F.lit(""))), F.lower(F.coalesce("evidence_strength", F.lit("")))
    return O.ladder([(admission == "quarantined", "Needs review"), (F.col("estimated"), "Estimated"), (strength.startswith("verified"), "Verified"), (admission.isin("canonical", "admitted"), "Admitted")], "Needs review")


def highlights(rows: DataFrame, limit: int = 3) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must be non-negative")
    first = F.when(F.lower("measurement_role") == "result", 0).otherwise(1)
    return rows.withColumn("researcher_status", researcher_status()).orderBy(first, "record_id").limit(limit)


def graph(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the knowledge graph, the first of each id; attributes are JSON."""
    fields = {"sources": ("source", "source_id", ("title", "doi", "year")), "materials": ("material", "material_id", ("name", "formula", "elements", "phase", "tags")), "devices": ("device", "device_id", ("name", "device_type", "material_ids", "tags")),
              "processes": ("process", "process_id", ("name", "family")), "experiments": ("experiment", "experiment_id", ("experiment_type", "target")), "calculations": ("calculation", "calculation_id", ("calculation_type", "code", "method", "functional"))}
    nodes = [archives.select(F.col("metadata.archive_id").alias("id"), F.lit("archive").alias("type"), F.to_json(F.struct("metadata.domain")).alias("attributes"), F.col("metadata.archive_id").alias("archive_id"))]
    nodes += [explode_list(archives, n).select(F.col(key).alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*names)).alias("attributes"), "archive_id") for n, (kind, key, names) in fields.items()]
    outputs = measurements(archives).filter("measurement_role = 'result'")
    prop = F.concat_ws(":", "parent_id", F.lit("prop"), "m.property", F.col("ordinal").cast("string"))
    nodes.append(outputs.select(prop.alias("id"), F.lit("property").alias("type"), F.to_json("m").alias("attributes"), "archive_id"))
    edges = outputs.select(F.lit(None).cast("string").alias("id"), F.col("parent_id").alias("source"), F.lit("has_property").alias("predicate"), prop.alias("target"), F.lit(None).cast("string").alias("attributes"), "archive_id")
    edges = edges.unionByName(explode_list(archives, "relationships").select(F.col("relation_id").alias("id"), F.col("subject_id").alias("source"), "predicate", F.col("object_id").alias("target"), F.to_json("attributes").alias("attributes"), "archive_id"))
    order = [F.col("archive_id"), F.col("attributes")]
    key = F.coalesce("id", F.concat_ws("|", "source", "predicate", "target"))
    return O.earliest(_union(nodes), ["id"], order).drop("archive_id"), O.earliest(edges.withColumn("edge_key", key), ["edge_key"], order).drop("archive_id", "edge_key")


def exchange_structures(archives: DataFrame) -> DataFrame:
    """Structure resources of a common exchange form; null attributes are left out."""
    rows = archives.select("metadata", F.explode("materials").alias("m"))
    some = F.when(F.size("m.elements") > 0, F.col("m.elements"))
    own = F.struct(F.col("metadata.archive_id").alias("archive_id"), F.col("metadata.domain").alias("domain"), "m.material_id", "m.phase", "m.tags")
    attributes = F.struct(F.col("m.formula").alias("chemical_formula_descriptive"), some.alias("elements"), F.size(some).alias("nelements"), own.alias("_assaylake"))
    return rows.select(F.col("m.material_id").alias("id"), F.lit("structures").alias("type"), F.to_json(attributes).alias("attributes"))


def csv_ready(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ordered columns as escaped cells, nulls empty."""
    return rows.select(*(csv_cell(F.col(c).cast("string")).alias(c) for c in columns))
