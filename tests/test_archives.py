"""Operators on small hand-built archives."""

import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import analytic, archives
from assaylake.plans import nested  # noqa: F401  it registers its queries
from assaylake.plans.registry import QUERIES
from assaylake.schema import ARCHIVE
from assaylake.sources import logs, sinks


def measure(prop, raw=None, value=None, unit=None, evidence=1, conditions=None, **more):
    ev = [{"source_id": "src-1", "page": 2, "source_type": "table", "verbatim_match": True, "text_snippet": f"value {raw}", "table_id": "t1", "confidence": 0.8}] * evidence
    return {"property": prop, "raw_value": raw, "value": value, "unit": unit, "qualifier": "exact", "conditions": conditions or {}, "evidence": ev, **more}


def archive(i, domain="battery", **more):
    return {
        "metadata": {"archive_id": f"arc-{i}", "schema_name": "s", "created_at": f"2024-01-0{i}T00:00:00", "domain": domain},
        "sources": [{"source_id": f"src-{i}", "source_type": "article", "title": f"Paper {i}", "doi": f"10.1/{i}", "year": 2000 + i}],
        "materials": [{"material_id": "m1", "name": "alpha", "formula": "LiFeO2", "elements": ["Li", "Fe", "O"], "structure": {"catalyst_state": "film"}}, {"material_id": "m2", "name": None, "formula": "NaCl", "elements": ["Na", "Cl"], "phase": "cubic"}],
        "devices": [{"device_id": "d1", "device_type": "cell", "material_ids": ["m1"], "configuration": {"layer_stack": [1, 2], "area": 3}}],
        "processes": [{"process_id": "p1", "name": "anneal", "sequence_index": 1, "inputs": ["powder"], "outputs": ["m1", "d1"], "parameters": [measure("temperature", "700 °C", 700, "°C")]}, {"process_id": "p2", "name": "mill", "outputs": [], "parameters": [measure("time", "2 h", 2, "h")]}],
        "experiments": [{"experiment_id": "e1", "experiment_type": "cycling", "material_ids": ["m2", "m1", "gone"], "device_id": "d1", "device_ids": [], "target": "capacity", "conditions": [measure("temperature", "25 °C", 25, "°C", 0)],
                         "outputs": [measure("specific_capacity", "150 mAh/g", 150, "mAh/g", conditions={"cycle": 5, "temperature": {"value": 30, "raw_value": "30 C", "unit": "C"}}), measure("efficiency", "99 %", 99, "%", 0)]}],
        "calculations": [{"calculation_id": "c1", "calculation_type": "dft", "material_ids": [], "method": "PBE", "parameters": [], "outputs": [measure("band_gap", "1.1 eV", 1.1, "eV")]}],
        "relationships": [{"relation_id": "r1", "subject_id": "m1", "predicate": "processed_by", "object_id": "p1"}, {"relation_id": "r2", "subject_id": "m1", "predicate": "layer_of", "object_id": "nowhere"}],
        "domain_payloads": [{"domain": domain, "schema_version": "1", "values": {"quarantine": [{"property": "capacity", "raw_value": "999", "reason": "no_verbatim_evidence"}, {"property": "capacity", "raw_value": "999", "reason": "no_verbatim_evidence"}]}}],
        "quality": {"completeness": 0.0, "provenance_coverage": 0.0, "unit_normalization_coverage": 0.5, "validation_status": "draft"},
        **more,
    }


@pytest.fixture
def table(spark, tmp_path):
    def make(*rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return logs.read_archives(spark, f"file://{path}")

    return make


def test_results(table):
    rows = {r.record_id: r for r in archives.results(table(archive(1))).collect()}
    assert len(rows) == 6
    by = {(r.record_type, r.measurement_role, r.metric): r for r in rows.values()}
    r = by["experiment", "result", "specific_capacity"]
    assert (r.material_ids, r.material_names, r.material_states, r.source_id, r.temperature, r.evidence_strength) == ("m2|m1", "|alpha", "cubic|film", "src-1", "30", "verified_native")
    assert json.loads(r.conditions_json)["cycle"] == "5"
    assert by["experiment", "result", "efficiency"].temperature == "25" and by["experiment", "result", "efficiency"].evidence_strength == "unverified"
    assert by["process", "parameter", "temperature"].material_ids == "m1" and by["calculation", "result", "band_gap"].material_ids is not None
    every = archives.all_results(table(archive(1), archive(2)), include_quarantined=True)
    assert every.filter("admission_status = 'quarantined'").count() == 2 and every.filter("raw_value = '999' and admission_status = 'canonical'").count() == 0


def test_analytic_rows(table):
    rows = analytic.analytic_rows(table(archive(1)))
    got = {(r.property_name, r.material_id): r for r in rows.collect()}
    assert set(got) == {(p, m) for p in ("specific_capacity", "efficiency") for m in ("m1", "m2", "gone")} | {("band_gap", None)}
    c = got["specific_capacity", "m1"].conditions
    assert (c["temperature"], c["temperature_unit"], c["synthesis_temperature"], c["device_type"], c["device_process_temperature"], c["cycle"]) == ("30", "C", "700 °C", "cell", "700", "5")
    assert "synthesis_temperature" not in got["specific_capacity", "m2"].conditions
    assert got["band_gap", None].method == "PBE" and got["specific_capacity", "m1"].value == 150.0
    assert analytic.filter_rows(rows, property_name="specific_capacity", temperature=(30, None), cycle=(None, 5)).count() == 3
    assert analytic.filter_rows(rows, temperature=(26, None)).filter("property_name = 'efficiency'").count() == 0
    assert analytic.filter_rows(rows, material_contains="ALPH", modalities=("experimental",)).count() == 2
    wide = analytic.wide_frame(rows)
    assert {"condition_cycle", "condition_temperature"} <= set(wide.columns)
    spec = analytic.eligibility(rows.filter("property_name = 'specific_capacity'"), "scatter", analytic.condition("cycle"), F.col("value")).first()
    assert (spec.eligible, spec.reason) == (False, "insufficient_numeric_x_variation")


def test_integrity_and_quality(table):
    bad = {(r.rule, r.missing_id) for r in archives.integrity_violations(table(archive(1))).collect()}
    assert bad == {("experiment_materials", "gone"), ("relationship_ends", "nowhere")}
    q = archives.quality(table(archive(1))).first()
    assert q.completeness == 1.0 and q.unit_normalization_coverage == 0.0 and abs(q.extraction_confidence - 0.8) < 1e-9
    assert abs(q.provenance_coverage - 4 / 15) < 1e-9
    empty = archives.quality(table(archive(2, materials=[], devices=[], processes=[], experiments=[], calculations=[], relationships=[], domain_payloads=[]))).first()
    assert (empty.completeness, empty.unit_normalization_coverage, empty.provenance_coverage) == (0.2, 0.5, 0.0)


def test_search_and_scopes(table):
    t = table(archive(1), archive(2, "catalysis"), archive(3, None, sources=[]))
    ids = lambda df: sorted(r[0] for r in df.select("metadata.archive_id").collect())
    assert ids(archives.search(t, domain="catalysis")) == ["arc-2"]
    assert ids(archives.search(t, element="Fe", formula_contains="life", property="band_gap", target="CAPACITY")) == ["arc-1", "arc-2", "arc-3"]
    assert ids(archives.search(t, year_min=2002)) == ["arc-2", "arc-3"]
    assert ids(archives.search(t, property="nothing")) == []
    assert ids(archives.select_scope(t, "selected_sources")) == [] == ids(archives.select_scope(t, "current_extraction"))
    assert ids(archives.select_scope(t, "custom_combination", source_ids=["src-2"])) == ["arc-2"]
    assert ids(archives.select_scope(t, "current_extraction", current=("run", ["arc-1", "arc-3"]))) == ["arc-1", "arc-3"]
    assert ids(archives.select_scope(t, "all_archives", properties=["band_gap"], record_types=["cycling"], domain="battery")) == ["arc-1"]
    roll = {r.domain: r for r in archives.domain_rollup(t, ["battery", "unused"]).collect()}
    assert roll["unused"].archives == 0 and roll["battery"].papers == 1 and roll["unknown_legacy"].papers == 1 and roll["catalysis"].latest == "2024-01-02T00:00:00"
    assert {r.title for r in archives.paper_summary(t).collect()} == {"Paper 1", "Paper 2", "arc-3"}


def test_explorer(table):
    rows = archives.all_results(table(archive(1)), include_quarantined=True)
    assert archives.filter_results(rows, {"material_names": ["NACL"], "metric": ["efficiency"]}).count() == 1
    assert archives.filter_results(rows, estimated=True).count() == 0 and archives.filter_results(rows, text="BAND_").count() == 1
    options = {(r.field, r.choice) for r in archives.filter_options(rows).collect()}
    assert {("material_names", "alpha"), ("material_names", "NaCl"), ("metric", "efficiency")} <= options
    top = archives.highlights(rows).collect()
    assert len(top) == 3 and all(r.measurement_role == "result" for r in top)
    with pytest.raises(ValueError):
        archives.highlights(rows, -1)


def test_graph_exchange_and_csv(table, tmp_path):
    t = table(archive(1), archive(2))
    nodes, edges = archives.graph(t)
    kinds = {r.type: r.n for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["archive"] == 2 and kinds["material"] == 2 and kinds["property"] == 3
    assert edges.filter("predicate = 'has_property'").count() == 3 and edges.filter("id = 'r1'").count() == 1
    x = json.loads(archives.exchange_structures(t).filter("id = 'm1'").first().attributes)
    assert x["nelements"] == 3 and "phase" not in x["_assaylake"]
    tables = sinks.bundle(t)
    assert set(tables) == set(sinks.BUNDLE) and tables["evidence"].count() == 8
    sinks.write_csv(archives.all_results(t), f"file://{tmp_path}/csv", ["record_id", "metric", "raw_value"], bom=True)
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("﻿record_id".encode()) or "﻿record_id".encode() in text


def test_logs(spark, tmp_path):
    (tmp_path / "log").write_text('{"a": 1}\n{"a": 2}\nbroken\n{"a": 3}')
    fates = {r.line: r.fate for r in logs.recover_tail(spark, f"file://{tmp_path}/log").collect()}
    assert fates == {0: "kept", 1: "kept", 2: "corrupt", 3: "completed"}
    good, bad = logs.read_tolerant(spark, f"file://{tmp_path}/log", "a int")
    assert good.count() == 3 and [r.value for r in bad.collect()] == ["broken"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        logs.read_archives(spark, f"file://{tmp_path}/log", "a int").collect()
    path = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    assert logs.append(spark, path, rows(("a", 1), ("b", 2))).count() == 0
    assert logs.append(spark, path, rows(("a", 1), ("c", 3))).count() == 0
    assert [r.id for r in logs.append(spark, path, rows(("a", 9), ("d", 4))).collect()] == ["a"]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    blobs = spark.createDataFrame([(b"%PDF-1", "x"), (b"%PDF-1", "y"), (b"zip", "z")], "content binary, name string")
    assert logs.publish(blobs, b"%PDF").count() == 1 and logs.verify_published(logs.publish(blobs)).count() == 0


def test_schema_round_trip(spark):
    assert spark.createDataFrame([], ARCHIVE).columns[0] == "metadata"


def test_duplicate_ids_and_index(spark, table):
    """Each id comes with how many archives have it; an index is made of a log without such ids only."""
    twice = table(archive(1), archive(2), archive(3), archive(2), archive(1), archive(2))
    assert sorted(logs.duplicate_ids(twice).collect()) == [("arc-1", 2), ("arc-2", 3)]
    with pytest.raises(ValueError, match="duplicate historical archive_id"):
        logs.rebuild_index(twice)
    assert sorted(logs.rebuild_index(table(archive(3), archive(1), archive(2))).collect()) == [("arc-1", 1), ("arc-2", 2), ("arc-3", 0)]


def test_duplicate_orders_are_counted(spark, tmp_path):
    for name in ("orders", "lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey <= 2").orderBy("o_orderkey").limit(1)
    orders.union(orders).write.mode("append").parquet(f"file://{tmp_path}/orders.parquet")
    assert [r.n for r in QUERIES["archive_duplicate_ids"](spark, f"file://{tmp_path}").collect()] == [3]
