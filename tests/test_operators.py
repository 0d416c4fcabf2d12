import datetime as dt
import json
import os

from pyspark.sql import functions as F

from assaylake.operators import evidence, frames, journal, routing, scoring, sensors, tables
from assaylake.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_frames(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, None), ("b", 5, "y")], "k string, seq int, v string")
    assert rows(frames.keep_last_at_first(t, "k", "seq"), "k", "v", "position") == [("a", "z", 1), ("b", "y", 5)]
    assert rows(frames.earliest(t, ["k"], [F.col("seq")]), "k", "v") == [("a", "x"), ("b", "y")] == rows(frames.latest(t.filter("seq < 3"), ["k"], [-F.col("seq")]).unionByName(t.filter("k = 'b'").select("k", "seq", "v")), "k", "v")
    assert rows(frames.only_match(t, ["k"], "v", "m"), "k", "matches", "m") == [("a", 2, None), ("b", 1, "y")]
    assert rows(frames.scalar_or_conflict(t, ["k"], "v"), "k", "scalar", "conflict") == [("a", None, ["x", "z"]), ("b", "y", None)]
    assert rows(t.groupBy("k").agg(frames.sum_if_complete("seq").alias("s"), frames.common_value("v").alias("c"), frames.ordered_list(F.col("v"), F.col("seq")).alias("l")), "k", "s", "c", "l") == [("a", 6, None, ["x", None, "z"]), ("b", 5, "y", ["y"])]
    assert rows(frames.backfill(t, ["k"], "seq", "v", "f"), "k", "seq", "f") == [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "z"), ("b", 5, "y")]
    assert rows(frames.multiset_difference(t.select("k"), t.select("k").distinct())) == [("a", 2)]


def test_evidence(spark):
    s = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon"), (2, "tiny"), (3, "not there at all anywhere")], "sid int, text string")
    p = spark.createDataFrame([(7, "x ALPHA beta gamma delta epsilons y"), (8, "a tiny thing"), (9, None)], "pid int, text string")
    assert rows(evidence.contained(s, p, "sid", "pid")) == [(1, 7), (2, 8)]
    e = spark.createDataFrame([("s", 1, "value −5"), ("s", 2, "value -5"), ("s", None, "twice"), ("s", None, "only"), ("s", 1, ""), ("none", 1, "x")], "source_id string, page int, text_snippet string")
    pages = spark.createDataFrame([("s", 1, "the value -5 here twice"), ("s", 2, "twice and only")], "source_id string, page int, text string")
    got = rows(evidence.verify_snippets(e, pages), "text_snippet", "page", "verbatim_match")
    assert got == sorted([("value −5", 1, True), ("value -5", 2, False), ("twice", None, False), ("only", 2, True), ("", 1, None), ("x", 1, None)], key=str)
    cells = spark.createDataFrame([("t", 0, 0, "1.5  V")], "table_id string, row int, col int, text string")
    claims = spark.createDataFrame([("t", 0, 0, "1.5 V"), ("t", 0, 1, "x"), ("u", 0, 0, "x"), ("t", 0, 0, " "), ("t", 0, 0, "2 V")], "table_id string, row int, col int, claim_text string")
    assert [r.reason for r in evidence.verify_cells(claims, cells).orderBy("table_id", "col", F.col("claim_text").desc()).collect()] == ["cell_text_mismatch", None, "empty_claim", "unknown_cell", "unknown_table"]


def test_tables(spark):
    cells = spark.createDataFrame([("t", 0, 0, "T (K)"), ("t", 0, 1, "10 C"), ("t", 1, 0, "300"), ("t", 1, 1, "5"), ("t", 2, 0, ""), ("t", 2, 1, "6")], "table_id string, row int, col int, text string")
    assert tables.grid(cells).first().grid == [["T (K)", "10 C"], ["300", "5"], ["", "6"]]
    assert rows(tables.row_labels(cells).filter("col = 1"), "row", "row_label") == [(0, "T (K)"), (1, "300"), (2, "300")]
    assert rows(tables.matrix_points(cells), "text", "row_axis", "column_axis") == [("5", "300", "10 C"), ("6", "", "10 C")]
    raw = spark.createDataFrame([("a", ["x (m)", "y"], [["1", "2"]]), ("b", ["x", ""], [["1", "2"]]), ("c", ["x", "x"], [["1", "2"]]), ("d", ["x", "y"], [["1"]]), ("e", ["x"], [])], "table_id string, headers array<string>, rows array<array<string>>")
    got = {r.table_id: r for r in tables.normalize_table(raw).collect()}
    assert {k: r.reason for k, r in got.items()} == {"a": None, "b": "missing_header", "c": "duplicate_headers", "d": "ragged_rows", "e": "empty_table"} and got["a"].records == [{"x (m)": "1", "y": "2"}]
    edges = spark.createDataFrame([(float(i * 10), i) for i in range(20)], "x double, bin int")
    points = spark.createDataFrame([(float(i), i) for i in range(-5, 200, 7)], "x double, i int")
    assert rows(tables.asof(points, edges, "x", "bin", ["i"], 4), "i", "bin") == sorted(((i, i // 10 if i >= 0 else None) for i in range(-5, 200, 7)), key=str)
    p = spark.createDataFrame([("t", 5.0), ("t", 9.0), ("t", 7.0)], "table_id string, value double")
    m = spark.createDataFrame([("t", 5.0 + 1e-10, "a"), ("t", 9.0, "b"), ("t", 9.0, "c")], "table_id string, value double, name string")
    assert rows(tables.match_points(p, m, ["table_id"]).select("value", "matches", "cell.name")) == [(5.0, 1, "a"), (7.0, 0, None), (9.0, 2, None)]
    lines = spark.createDataFrame([("t", i, x) for i, x in enumerate(["a", "b", "", "c", "", "", "d"])], "t string, i int, x string")
    assert rows(tables.trim_after_gap(lines, "t", "i", F.col("x") == ""), "x") == [("a",), ("b",), ("c",)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page_id int, x0 double, y0 double, x1 double, y1 double")
    captions = spark.createDataFrame([(1, "below", 1.0, 12.0, 9.0, 14.0), (1, "aside", 20.0, 10.0, 30.0, 12.0), (1, "far", 0.0, 90.0, 9.0, 95.0)], "page_id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert tables.nearest_caption(boxes, captions).first().caption == "below"


def test_scoring(spark):
    gold = spark.createDataFrame([(1, "m", 5.0, None), (2, "m", 6.0, "V"), (3, "n", 1.0, None)], "id int, metric string, value double, unit string")
    seen = spark.createDataFrame([("m", 5.0, "A"), ("m", 6.0, "A")], "metric string, v double, u string")
    got = scoring.cascade(gold, seen, ["id"], ["metric"], {"property": F.lit(True), "unit": frames.wildcard("unit", "u"), "value": frames.close(F.col("value"), F.col("v"))}).first()
    assert tuple(got) == (3, 2, 1, 1)
    assert rows(scoring.metric_match(gold, seen, ["metric"], {"unit": "u"}), "id") == [(1,)]
    a = spark.createDataFrame([("x", True), ("x", True), ("y", False)], "case_id string, passed boolean")
    assert rows(scoring.closure(scoring.assertion_score(a)), "case_id", "closed") == [("x", True), ("y", False)]
    assert rows(scoring.invariants(a, {"all": F.col("passed"), "named": F.col("case_id").isNotNull()})) == [("all", False), ("named", True)]
    entries = spark.createDataFrame([("a", "f1", "0" * 64, "gold"), ("a", "f2", "x", "odd"), ("b", None, "0" * 64, "gold")], "benchmark_id string, filename string, checksum string, benchmark_role string")
    assert rows(scoring.validate_manifest(entries, ["filename"], ["benchmark_id"], ["gold", "control"])) == [("duplicate_benchmark_id", "a"), ("extra_role", "odd"), ("malformed_checksum", "a"), ("missing_filename", "b"), ("missing_role", "control")]
    want = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, sha256 string")
    assert rows(scoring.artifact_integrity(want, want.filter("path = 'p'").unionByName(spark.createDataFrame([("q", "9")], want.schema)))) == [("p", "verified"), ("q", "mismatched"), ("r", "absent")]
    points = spark.createDataFrame([("s", 300.0, 1.0), ("s", 310.0, 2.0)], "s string, t double, v double")
    assert rows(scoring.series_recall(points, points.filter("t = 300"), ["s"], "t", "v")) == [("s", 2, 1)]


EVENTS = [("a", 1, "PENDING"), ("a", 2, "RUNNING"), ("a", 3, "SUCCEEDED"), ("b", 1, "RUNNING"), ("c", 1, "PENDING"), ("c", 2, "CANCELLED"), ("c", 4, "RUNNING"), ("d", 1, "PENDING"), ("d", 2, "NONSENSE")]


def test_journal(spark):
    e = spark.createDataFrame(EVENTS, "job_id string, version long, state string")
    current, bad = journal.fold_jobs(e)
    assert rows(current, "job_id", "state") == [("a", "SUCCEEDED"), ("b", "RUNNING"), ("c", "RUNNING"), ("d", "NONSENSE")]
    assert rows(bad, "job_id", "version", "reason") == [("a", 3, "corrupt job-state transition record"), ("b", 1, "corrupt job-state creation record"), ("c", 4, "corrupt job-state transition record"), ("d", 2, "corrupt job-state record")]
    t = dt.datetime(2024, 1, 1, 12)
    q = spark.createDataFrame([(i, t + dt.timedelta(minutes=i), "u1" if i < 5 else f"u{i}", "extract") for i in range(12)], "request_id int, at timestamp, owner_key string, action string")
    assert [r.request_id for r in journal.reserve_quota(q, 2, 5).filter("granted").orderBy("request_id").collect()] == [0, 1, 5, 6, 7]
    actions = spark.createDataFrame([("x", 1, "i"), ("x", 2, "i"), ("y", 1, "i"), ("y", 2, "j")], "action_id string, seq int, inputs string")
    first, conflicts = journal.operator_actions(actions)
    assert rows(first, "action_id", "seq") == [("x", 1)] and rows(conflicts, "action_id") == [("y",)]
    plans = journal.safe_to_resume(spark.createDataFrame([("SUCCEEDED", None), ("WAITING_PROVIDER", True), ("RUNNING", False), ("RECONCILIATION_REQUIRED", None)], "state string, open_intent boolean"))
    assert [r.plan for r in plans.collect()] == ["terminal", "uncertain", "resume", "needs_operator"]


def test_job_stream_judges_events_and_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, part in enumerate((EVENTS[:5], [*EVENTS[:2], *EVENTS[5:]])):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"job_id": j, "version": v, "state": s, "at": "2024-01-01T00:00:00"}) + "\n" for j, v, s in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = jobs.fold_stream(spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("folded")
    assert rows(got.filter("accepted"), "job_id", "state") == [("a", "PENDING"), ("a", "RUNNING"), ("c", "CANCELLED"), ("c", "PENDING"), ("d", "PENDING")]
    assert {r.job_id for r in got.filter("not accepted").collect()} >= {"a", "b", "c", "d"}
    (tmp_path / "ev").mkdir()
    events = spark.readStream.schema("event_id string, v int").json(f"file://{tmp_path}/ev")
    (tmp_path / "ev" / "a.json").write_text('{"event_id": "x", "v": 1}\n{"event_id": "x", "v": 1}\n{"event_id": "y", "v": 2}\n')
    for i in range(2):
        jobs.append_stream(events, f"file://{tmp_path}/log", f"file://{tmp_path}/cp2").awaitTermination(120)
        (tmp_path / "ev" / "b.json").write_text('{"event_id": "y", "v": 2}\n{"event_id": "x", "v": 9}\n{"event_id": "z", "v": 3}\n')
    assert rows(spark.read.parquet(f"file://{tmp_path}/log"), "event_id", "v") == [("x", 1), ("y", 2), ("z", 3)]
    assert rows(spark.read.parquet(f"file://{tmp_path}/log_conflicts"), "event_id") == [("x",)]


def test_routing(spark):
    domains = [
        routing.Domain("batteries", ("battery", "cathode", "c-rate"), (("cell_context", 3.0, (("cathode",), ("capacity",))),)),
        routing.Domain("corrosion", ("corrosion", "pitting", "eis"), (("corrosion_context", 3.5, (("corrosion",), ("eis",))),)),
        routing.Domain("photovoltaics", ("solar cell", "efficiency"), (("pv_context", 3.0, (("solar cell",), ("voc",))),), needs_focal=True),
    ]
    docs = spark.createDataFrame([(1, "The battery cathode showed capacity. We measured the cathode."), (2, "Corrosion and EIS. Pitting corrosion."), (3, "efficiency efficiency efficiency battery"), (4, "  "), (5, None), (6, "nothing")], "doc_id int, text string")
    got = {r.doc_id: r for r in routing.route(docs, domains).collect()}
    assert {k: (r.domain, r.reason) for k, r in got.items()} == {1: ("batteries", None), 2: ("corrosion", None), 3: ("generic", "weak_scientific_domain_evidence")}
    assert set(got[1].focal) == {"cathode", "cell_context"} and got[2].matched == ["corrosion", "pitting", "eis"]
    scored = {(r.doc, r.domain): r.score for r in routing.score_domains(docs, domains).collect()}
    assert scored[1, "batteries"] == 1 + 1.25 + 3.0 + 0.5 * 2
    types = routing.paper_types(docs.filter("doc_id = 2"), {"a": ("corrosion",), "b": ("pitting",), "c": ("eis",), "d": ("zzz",)}, 2)
    assert rows(types, "paper_type", "rank") == [("a", 1), ("c", 2)]


def test_sensors(spark):
    q = lambda v, u=None: None if v is None else {"value": float(v), "unit": u}

    def sample(i, rt=None, temp=None, conc=None, entries=(), lod=None, **more):
        return {"sample_id": f"s{i}", "material": "ZnO", "sensor_type": "chemiresistor", "testing": {"target_analyte": "NO2", "concentration": q(conc, "ppb"), "operating_temperature": q(temp, "°C")},
                "performance": {"response_time": {"value": q(rt, "min"), "criterion": None} if rt else None, "limit_of_detection": q(lod, "ppm"), "selectivity": {"entries": [dict(zip(("interferent", "selectivity_ratio", "target_response", "interferent_response"), e, strict=True)) for e in entries]}}, **more}

    record = {"paper": {"title": "P", "doi": "10.1/x"}, "samples": [sample(0, 2, 25, 100, [("CO", 4.0, None, None), ("CO", None, 6.0, 3.0), ("H2", None, None, None)], 0.5), sample(1, 1, 50, 200, lod=0.1), sample(2, 3, 25, 200), sample(3, 4, 50, 100)]}
    t = sensors.normalize(sensors.merge_records(spark.read.schema(sensors.RECORD).json(spark.sparkContext.parallelize([json.dumps(record)]))))
    assert sensors.flatten(t).count() == 6
    assert rows(sensors.selectivity(t), "pair", "ratio") == [("NO2/CO", 3.0)]
    p = {r["sample"]: r for r in sensors.response_points(t).collect()}
    assert (p["P | s0"].response_time, p["P | s0"].concentration_ppm, p["P | s0"].response_time_unit) == (120.0, 0.1, "s")
    assert rows(sensors.response_groups(t), "n", "temperatures", "concentrations") == [(4, 2, 2)]
    warned = rows(sensors.warnings(t), "sample", "warning")
    assert ("s0", "selectivity entry for H2 is qualitative only.") in warned and len(warned) == 5
    assert sensors.radar_groups(t).count() == 0 and sensors.selectivity_matrix(t, ["NO2/CO"]).columns == ["sample", "NO2/CO"]


def test_reviews_and_discovery(spark):
    from assaylake.operators import review

    pages = spark.createDataFrame([("r", 1, "Review\nCorrosion of steel."), ("r", 2, "This review summarizes work. Rates of 5 mm were seen in corrosion [3]. Rates of 5 mm were  seen in corrosion [3]."), ("p", 1, "This review summarizes nothing much here.")], "source_id string, page int, text string")
    signals = review.review_signals(pages)
    assert rows(signals, "source_id", "pure_review") == [("p", False), ("r", True)]
    records = spark.createDataFrame([("r", "focal_work"), ("r", "cited_prior_work"), ("p", "focal_work")], "source_id string, ownership string")
    assert rows(review.guard_ownership(records, signals)) == [("p", "focal_work"), ("r", "cited_prior_work"), ("r", "review_summary")]
    assert review.cited_statements(pages, "corrosion").count() == 1
    found = spark.createDataFrame([("q", [("https://doi.org/10.1000/x", " T ", ""), ("ftp://a", "U", "s"), ("http://a.b/c", None, "s")])], "query string, organic array<struct<link string, title string, snippet string>>")
    got = review.discovery_candidates(found)
    assert rows(got, "title", "doi", "snippet") == [("T", "10.1000/x", None), ("Untitled discovery result", None, "s")]
    assert review.save_candidates(got.limit(1), got).count() == 2
    sources = spark.createDataFrame([("a", "Steel in brine", None, 1999), ("b", "Other", None, None)], "source_id string, title string, doi string, year int")
    hits = spark.createDataFrame([("a", "Steel in Brine.", "10.1/a", 2001), ("a", "Wood", "10.1/w", 2002), ("b", "Unlike", "10.1/b", 2003)], "source_id string, title string, doi string, year int")
    assert rows(review.enrich_titles(sources, hits)) == [("a", "Steel in brine", "10.1/a", 1999), ("b", "Other", None, None)]


EV = "array<struct<text_snippet string, verbatim_match boolean>>"


def test_assembly(spark):
    from assaylake.operators import assembly

    ok, loose = [("seen", True)], [("seen", None)]
    drafts = {
        "materials": spark.createDataFrame([("s", "m1", "NaCl", "focal_work", ok), ("s", "m2", "KCl", "cited_prior_work", ok), ("s", "m3", "LiF", "focal_work", loose), ("t", "m1", "Fe", "focal_work", ok)], f"source_id string, local_id string, formula string, ownership string, evidence {EV}"),
        "processes": spark.createDataFrame([("s", "p1", "mill", [], ["m1"], "focal_work", ok), ("s", "p2", "heat", ["m1"], ["m2"], "focal_work", ok)], f"source_id string, local_id string, name string, inputs array<string>, outputs array<string>, ownership string, evidence {EV}"),
        "experiments": spark.createDataFrame([("s", "e1", "xrd", ["m1"], "focal_work", ok), ("s", "e2", "xrd", ["m1", "m3"], "focal_work", ok), ("t", "e1", "xrd", ["m1"], "focal_work", [])], f"source_id string, local_id string, kind string, material_refs array<string>, ownership string, evidence {EV}"),
    }
    got = assembly.assemble(drafts, "mechanical")
    assert rows(got["quarantine"], "kind", "source_id", "local_id", "reason") == [
        ("experiments", "s", "e2", "entity_dependencies_not_admitted"), ("experiments", "t", "e1", "no_source_evidence"), ("materials", "s", "m2", "ownership_cited_prior_work"), ("materials", "s", "m3", "no_source_evidence"), ("processes", "s", "p2", "entity_dependencies_not_admitted"),
    ]
    assert rows(got["edges"].groupBy("predicate").count()) == [("processed_by", 1), ("produces", 1), ("reported_by", 1), ("tested_in", 1)]
    assert assembly.assemble(drafts, "battery")["experiments"].count() == 2

    groups = spark.createDataFrame([("g1", "x", None), ("g2", "x", "y"), ("g3", None, "z")], "group_id string, a string, b string")
    shared, left = assembly.share_components(groups, ["a", "b"])
    assert rows(shared, "field", "payload") == [("a", "x")] and {r.group_id: (r.a, r.b, len(r.protocol_refs)) for r in left.collect()} == {"g1": (None, None, 1), "g2": (None, "y", 1), "g3": (None, "z", 0)}
    wide = shared.groupBy("protocol_id").pivot("field", ["a", "b"]).agg(F.first("payload"))
    assert rows(assembly.resolve_protocol(left, wide, ["a", "b"]), "group_id", "a", "b") == rows(groups)
    t = spark.createDataFrame([(True, False, True)], "x boolean, y boolean, z boolean")
    assert t.select(assembly.completeness([(F.col("x"), F.col("z")), (F.col("y"), F.col("z")), (F.col("x"), F.col("y"))])).first()[0] == 0.5

    pages = spark.createDataFrame([("s", 2, "second"), ("s", 1, "first"), ("s", 3, None)], "source_id string, page int, text string")
    text = assembly.marked_text(pages)
    assert rows(assembly.split_marked(text), "page", "text") == [(1, "first"), (2, "second"), (3, "")]
    assert len(assembly.marked_text(pages, 30).first().text) == 30
    tables_ = spark.createDataFrame([("s", 1, "a", "rate rate"), ("s", 1, "b", "rate"), ("s", 2, "c", "x")], "source_id string, page int, table_id string, text string")
    assert rows(assembly.relevant_tables(tables_, ["rate"], 2), "table_id", "rank") == [("a", 1), ("b", 2)]
    c = spark.createDataFrame([("c1", "s", 1, "text", "rate was 5.0 and 1,200 units", ["5.0", "1,200"]), ("c2", "s", 1, "text", "rate was 7 units", ["7"]), ("c3", "s", 9, "text", "rate", ["1"])], "candidate_id string, source_id string, page int, origin string, snippet string, numbers array<string>")
    r = spark.createDataFrame([("s", 1, "text", "the rate was 5.0 and 1,200 units", ["5", "1200"]), ("s", 1, "text", "rate was 7 units", ["8"])], "source_id string, page int, origin string, snippet string, numbers array<string>")
    assert rows(assembly.candidate_coverage(c, r), "candidate_id", "covered", "reason") == [("c1", True, "evidence_linked_all_numeric_spans"), ("c2", False, "evidence_linked_missing_numeric_spans"), ("c3", False, "no_contextual_evidence_match")]


def test_append_log_by_one_grouping(spark):
    """Against a plain reading of the rule, with ids that repeat on both sides and rows without an id; no part is joined with another."""
    rows = lambda *x: spark.createDataFrame(x, "id string, body string, n int")
    old = [("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "x", None), (None, "x", 1)]
    new = [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("c", "x", None), ("c", "z", 1), ("d", "x", 1), ("d", "x", 1), ("e", "x", 1), ("e", None, 1), ("f", None, None), (None, "x", 1), (None, "y", 1), (None, "y", 1)]
    add, conflicts = journal.append_log(rows(*old), rows(*new), "id")
    known = {}
    for r in old:
        known.setdefault(r[0], set()).add(r)
    fresh = {r for r in new if r[0] is None or r[0] not in known}
    twice = {k for k in {r[0] for r in fresh} if sum(r[0] == k for r in fresh) > 1}
    clash = {r[0] for r in new if r[0] is not None and known.get(r[0], {r}) != {r}}
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, add.collect()), key=key) == sorted((r for r in fresh if r[0] is None or r[0] not in twice), key=key)
    assert sorted((r.id for r in conflicts.collect()), key=str) == sorted(clash | twice, key=str)
    plan = add._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
