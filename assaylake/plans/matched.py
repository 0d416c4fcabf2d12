"""Queries that run the name, matching and status operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import axes as G
from ..functions import names as A
from ..functions import text as X
from ..operators import matching as M
from ..operators import status as S
from .library import _lines, _sql
from .registry import Tables, query


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'specific_capacity' WHEN 1 THEN 'charge_transfer_resistance' WHEN 2 THEN 'warburg_coefficient' ELSE replace(lower(p_name), ' ', '_') END AS property,
 CASE p_size % 3 WHEN 0 THEN 'state_of_charge' WHEN 1 THEN 'C_rate' ELSE replace(lower(p_name), ' ', '_') END AS condition FROM part""")
def canonical_names(t: Tables):
    """Printed names of properties and conditions under their one name."""
    size, name = F.col("p_size"), F.col("p_name")
    prop = F.when(size % 4 == 0, "Discharge capacity").when(size % 4 == 1, "R_ct: charge-transfer resistance (ohm)").when(size % 4 == 2, "Warburg coefficient, W").otherwise(name)
    cond = F.when(size % 3 == 0, "State-of-charge (SOC)").when(size % 3 == 1, "C-rate").otherwise(name)
    return t.part.select("p_partkey", A.property_name(prop).alias("property"), A.condition_name(cond).alias("condition"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'mmol/g/h' WHEN 1 THEN 'umol/cm2/h' ELSE 'v' END AS unit, CASE WHEN p_size % 2 = 0 THEN 'ua cm-2' ELSE 'ohm cm2' END AS token,
 -p_size / 10 AS volts, CASE p_size % 3 WHEN 0 THEN 'rhe' WHEN 1 THEN 'ag/agcl' END AS scale FROM part""")
def canonical_units(t: Tables):
    """Units in one notation, and potentials as a number and its scale."""
    size = F.col("p_size")
    unit = F.when(size % 3 == 0, "mmol H2 h-1 g-1").when(size % 3 == 1, "µmol/h/cm²").otherwise("V")
    product = F.when(size % 3 == 0, "H2")
    token = F.when(size % 2 == 0, "uA/cm^-2").otherwise("Ω·cm²")
    printed = F.concat(F.lit("-"), (size / 10).cast("string"), F.lit(" V "), F.when(size % 3 == 0, "vs. RHE").when(size % 3 == 1, "(Ag/AgCl)").otherwise(""))
    parts = A.potential_parts(printed)
    unit = F.regexp_replace(A.canonical_unit(unit, product), "^[µμ]", "u")
    return t.part.select("p_partkey", unit.alias("unit"), A.unit_token(token).alias("token"), parts["value"].alias("volts"), parts["reference"].alias("scale"))


@query("SELECT o_orderkey, o_orderstatus <> 'O' AS electrode, o_orderstatus <> 'F' AS named FROM orders")
def label_matches(t: Tables):
    """Labels that are the same by their bracketed short form."""
    electrode = F.when(F.col("o_orderstatus") == "O", "Ag/AgCl").otherwise("SCE")
    named = F.when(F.col("o_orderstatus") == "F", "xy").otherwise("ib")
    return t.orders.select("o_orderkey", A.same_electrode(electrode, F.lit("saturated calomel electrode (SCE)")).alias("electrode"), A.same_name(named, F.lit("Indigo blue (IB)")).alias("named"))


@query(_sql("""SELECT g.o, g.n, s.n AS seen FROM l g JOIN l s ON s.o = g.o AND s.n <> g.n AND s.flag = g.flag AND (g.status = 'O' OR s.status = g.status) AND (g.qty % 2 = 0 OR s.qty % 2 = 1)"""))
def identity_matches(t: Tables):
    """Records whose asserted fields agree and whose parts the other has."""
    parts = F.when(F.col("qty") % 2 == 0, F.array(F.lit("support"))).otherwise(F.array(F.lit("support"), F.lit("promoter")))
    rows = _lines(t).select("o", "n", "flag", "status", parts.alias("components"))
    expected = rows.withColumn("status", F.when(F.col("status") != "O", F.col("status")))
    got = M.identity_matches(expected, rows.withColumnRenamed("n", "seen_id"), ["o"], ["flag", "status"])
    return got.filter("seen_id <> n").select("o", "n", F.col("seen_id").alias("seen"))


@query(_sql("""SELECT d.dimension, (SELECT count(*) FROM l WHERE n <> 2) AS expected, (SELECT count(*) FROM l g WHERE g.n <> 2 AND EXISTS (SELECT 1 FROM l s WHERE s.n = 2 AND s.o = g.o
 AND (d.dimension = 'state' OR s.flag = g.flag) AND (d.dimension = 'kind' OR s.status = g.status))) AS matched FROM (VALUES ('kind'), ('state'), ('both')) d(dimension)"""))
def dimension_matches(t: Tables):
    """Expected rows that an observation meets, by dimension of the comparison."""
    l = _lines(t)  # noqa: E741
    return M.dimension_counts(l.filter("n <> 2"), l.filter("n = 2"), ["o"], {"kind": ["flag"], "state": ["status"], "both": ["flag", "status"]})


@query(_sql("""SELECT count(*) FILTER (status = 'F' AND flag = 'R') AS review_contamination, count(*) FILTER (n > 2 AND (flag = 'A' OR qty < 10)) AS calculation_leakage, count(*) FILTER (qty > 30 AND flag <> 'N') AS conversion_violations FROM l"""))
def admitted_violations(t: Tables):
    """What must never be among admitted rows."""
    rows = _lines(t).select(
        F.when(F.col("status") == "F", "canonical").otherwise("quarantined").alias("admission_status"), F.when(F.col("flag") == "R", "review_summary").otherwise("focal_work").alias("ownership"),
        F.when(F.col("n") > 2, "MeasurementRecord").otherwise("CalculationRecord").alias("record_type"), F.when(F.col("flag") == "A", "band_gap_dft").alias("property"), F.when(F.col("qty") < 10, "DFT").alias("method"),
        F.when(F.col("qty") > 30, 1.0).alias("converted_potential"), F.when(F.col("flag") == "N", "author_reported").alias("conversion_status"),
    )
    return M.violation_counts(rows, ["band_gap_dft"])


@query(_sql("""SELECT o, n, CASE WHEN flag = 'R' THEN 'review_summary' WHEN status = 'F' THEN 'cited_prior_work' ELSE 'focal_work' END AS owner,
 CASE WHEN n % 3 = 0 THEN 'unknown_basis' WHEN n % 3 = 1 THEN 'comparable' ELSE 'not_comparable' END AS compared, qty > 20 AND flag <> 'N' AS tracked FROM l"""))
def ownership_and_basis(t: Tables):
    """Owners of items within their group, bases of comparison, and rows that lead back to a source."""
    group, item = F.when(F.col("flag") == "R", "review_summary").otherwise("focal_work"), F.when(F.col("status") == "F", "cited_prior_work").otherwise("unknown")
    left = M.normalization_key(F.when(F.col("n") % 3 == 0, "unknown").otherwise("mass"), F.lit(None).cast("string"), F.lit("catalyst"))
    right = M.normalization_key(F.lit("mass"), F.when(F.col("n") % 3 == 2, "m1"), F.lit("catalyst"))
    rows = _lines(t).select("*", F.lit("t").alias("source_title"), F.when(F.col("qty") > 20, F.col("n")).alias("source_page"), F.lit("s").alias("evidence_snippet"), F.when(F.col("flag") == "N", "figure_digitized").otherwise("native_text").alias("evidence_origin"))
    return rows.select("o", "n", M.effective_ownership(group, item).alias("owner"), M.comparability(left, right).alias("compared"), M.source_tracked().alias("tracked"))


@query(_sql("SELECT o, flag, count(*) AS measurements, min(n) AS first_item FROM l GROUP BY 1, 2"))
def grouped_experiments(t: Tables):
    """Measurements under the experiment that their context makes."""
    got = M.experiments(_lines(t), ["o", "flag"], ["n", "qty"])
    return got.select("o", "flag", F.size("measurements").cast("long").alias("measurements"), F.array_min("measurements")["n"].alias("first_item"))


@query(_sql("""SELECT o, n, o % 2 = 0 AND (n = 1 OR ((SELECT count(*) FROM l x WHERE x.o = l.o) = 1)) OR (o % 2 = 1 AND (SELECT count(*) FROM l x WHERE x.o = l.o) = 1) AS in_conflict FROM l"""))
def experiments_in_conflict(t: Tables):
    """Rows that an unresolved conflict speaks of."""
    rows = _lines(t).select(F.col("o").alias("document_id"), F.col("n").alias("experiment_id"))
    first = F.col("experiment_id") == 1
    ids = t.orders.select(F.col("o_orderkey").alias("document_id"))
    conflicts = rows.filter(first & (F.col("document_id") % 2 == 0)).withColumn("resolved", F.lit(False))
    loose = ids.filter("document_id % 2 = 1").select("document_id", F.lit(None).cast("int").alias("experiment_id"), F.lit(None).cast("boolean").alias("resolved"))
    solved = rows.filter("experiment_id = 2").withColumn("resolved", F.lit(True))
    single = ids.filter("document_id % 2 = 0").select("document_id", F.lit(None).cast("int").alias("experiment_id"), F.lit(False).alias("resolved"))
    got = M.unresolved_conflicts(rows, conflicts.unionByName(loose).unionByName(solved).unionByName(single))
    return got.select(F.col("document_id").alias("o"), F.col("experiment_id").alias("n"), "in_conflict")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'review_no_focal_data' WHEN o_orderstatus = 'F' THEN 'quarantined_only' ELSE 'no_structured_results' END END AS kind,
 o_custkey % 3 = 0 AND o_orderstatus = 'O' AS due FROM orders""")
def empty_results(t: Tables):
    """Why archives have no results, and reviews that somebody has to read."""
    status, review = F.col("o_orderstatus"), F.col("o_orderstatus") == "O"
    state = S.empty_state(F.when(review, F.array(F.lit("Review"))), F.lit(0), F.when(status == "F", 3), F.col("o_custkey") % 2)
    due = S.review_due(F.when(review, "review_article").otherwise("article"), F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(0), F.lit(0))
    return t.orders.select("o_orderkey", state["kind"].alias("kind"), due.alias("due"))


@query(_sql("""SELECT o, n, CASE WHEN flag = 'A' AND qty < 25 THEN 'retention has no associated cycle' WHEN flag = 'N' AND qty < 25 AND n > 1 THEN 'capacity has neither cycle nor C-rate association'
 WHEN flag = 'R' AND status = 'F' THEN 'impedance/transport value has no method association' END AS lacking FROM l"""))
def values_to_review(t: Tables):
    """What values lack that their property needs."""
    prop = F.when(F.col("flag") == "A", "capacity_retention").when(F.col("flag") == "N", "specific_capacity").otherwise("impedance")
    got = S.condition_reviews(prop, F.when(F.col("qty") >= 25, F.col("qty")), F.when(F.col("n") == 1, 0.1), F.when(F.col("status") == "F", "").otherwise("EIS"))
    return _lines(t).select("o", "n", F.get(got, F.lit(0)).alias("lacking"))


@query(_sql("""SELECT o, count(*) AS records, count(*) FILTER (flag <> 'N') AS with_evidence, round(count(*) FILTER (flag <> 'N') / count(*), 3) AS record_coverage, count(*) FILTER (flag = 'R') AS with_verbatim,
 round(count(*) FILTER (flag = 'R') / count(*), 3) AS verbatim_record_coverage, CAST(2 * count(*) FILTER (flag <> 'N') AS BIGINT) AS snippets, round(count(*) FILTER (flag = 'R') / greatest(2 * count(*) FILTER (flag <> 'N'), 1), 3) AS verbatim_match_coverage FROM l GROUP BY 1"""))
def evidence_coverage(t: Tables):
    """Shares of records with evidence, and of snippets that are verbatim."""
    item = lambda text, hit: F.struct(text.cast("string").alias("text_snippet"), hit.alias("verbatim_match"))
    items = F.array(item(F.lit("a"), F.col("flag") == "R"), item(F.lit("b"), F.lit(None).cast("boolean")), item(F.lit(None), F.lit(True)))
    return S.evidence_coverage(_lines(t).select("o", F.when(F.col("flag") != "N", items).alias("evidence")), ["o"])


@query(_sql("""SELECT status, CAST(sum(c) AS BIGINT) AS quantitative_values, CAST(sum(v) AS BIGINT) AS verbatim_values, CAST(sum(c - 1) AS BIGINT) AS repeated, CAST(sum(greatest(p - 1, 0)) AS BIGINT) AS repeated_outputs
 FROM (SELECT status, part % 50 AS prop, qty, count(*) AS c, count(*) FILTER (n = 1) AS p, count(*) FILTER (flag = 'R') AS v FROM l WHERE qty > 5 GROUP BY 1, 2, 3) GROUP BY 1"""))
def quantitative_totals(t: Tables):
    """Values, verbatim ones and repeats of a signature."""
    kind = F.when(F.col("n") == 1, "scientific_output").otherwise("process_parameter")
    rows = _lines(t).select("status", (F.col("part") % 50).alias("prop"), "qty", kind.alias("kind"), F.when(F.col("qty") > 5, F.col("qty")).alias("value"), (F.col("flag") == "R").alias("verbatim"))
    return S.quantitative_totals(rows, ["status"], ["prop", "qty"])


@query(_sql("""SELECT o, left('Failure summary: ' || (SELECT string_agg(k || '=' || c, ', ' ORDER BY k) FROM (SELECT CASE flag WHEN 'N' THEN 'unknown' ELSE flag END AS k, count(*) AS c FROM l x WHERE x.o = l.o GROUP BY 1))
 || '. Attempts: ' || string_agg('m' || n || ': ' || CASE flag WHEN 'N' THEN 'unknown' ELSE flag END || CASE WHEN status = 'F' THEN ' (' || qty || ')' ELSE '' END, '; ' ORDER BY n), 2000) AS summary FROM l GROUP BY o"""))
def failure_summary(t: Tables):
    """Failures of a run in one text."""
    rows = _lines(t).select("o", "n", F.concat(F.lit("m"), "n").alias("model"), F.when(F.col("flag") != "N", F.col("flag")).alias("failure_class"), F.when(F.col("status") == "F", F.col("qty").cast("string")).otherwise("").alias("message"))
    return S.failure_summary(rows, "o", "n")


@query(_sql("SELECT o, CASE WHEN count(*) FILTER (flag <> 'N') = 0 THEN NULL WHEN count(*) FILTER (flag = 'A') >= count(*) FILTER (flag = 'R') THEN 'A' ELSE 'R' END AS parser FROM l GROUP BY 1"))
def primary_parser(t: Tables):
    """The parser that most pages of a source come from."""
    return S.primary_parser(_lines(t).withColumnRenamed("flag", "parser"), "o", ["A", "R"])


@query(_sql("SELECT o, n, 'd-' || n AS domain, 'p/' || part AS provider, CASE WHEN status = 'F' THEN CAST(qty AS VARCHAR) ELSE 'N/A' END AS score, CASE flag WHEN 'N' THEN 'not standardized' WHEN 'R' THEN 'true' ELSE 'false' END AS schema_valid FROM l WHERE n < 6"))
def shown_provider_runs(t: Tables):
    """Runs as they may be shown."""
    domain = F.when(F.col("n") < 6, F.concat(F.lit("d-"), "n")).otherwise("../d")
    rows = _lines(t).select(domain.alias("domain"), F.concat(F.lit("p/"), "part").alias("provider"), F.lit("a:b").alias("model"), F.concat_ws("-", "o", "n").alias("run_id"), (F.col("status") == "F").alias("payload"), F.col("qty").alias("score"), F.when(F.col("flag") != "N", F.col("flag") == "R").alias("schema_valid"))
    got = S.provider_runs(rows, X.safe_identifier)
    at = lambda i: F.get(F.split("run_id", "-"), F.lit(i))
    return got.select(at(0).cast("long").alias("o"), at(1).cast("int").alias("n"), "domain", "provider", "score", "schema_valid")


@query(_sql("SELECT count(*) AS cases, count(*) FILTER (flag = 'R') AS returned, CAST(sum(qty) AS BIGINT) AS qty, round(count(*) FILTER (flag = 'R') / count(*), 9) AS returned_share FROM l"))
def corpus_summary(t: Tables):
    """Totals over all cases."""
    got = S.corpus_summary(_lines(t), {"returned": F.col("flag") == "R"}, ["qty"])
    return got.withColumn("returned_share", F.round("returned_share", 9))


@query(_sql("SELECT o, n, CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 0 END AS violations FROM l"))
def safety_counts(t: Tables):
    """Counts under the first alias that is reported."""
    listed = F.when(F.col("flag") == "R", F.create_map(F.lit("graph"), F.array(F.lit("a"), F.lit("b"))))
    none = F.create_map(F.lit("graph_contamination"), F.array().cast("array<string>"))
    reported = listed.when(F.col("flag") == "A", none).otherwise(F.create_map(F.lit("other"), F.array(F.lit("a"))))
    return _lines(t).select("o", "n", S.first_of(["graph_contamination", "graph"], reported).alias("violations"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN -p_size WHEN 2 THEN 1.0 / p_size END AS value,
 CASE WHEN p_size % 2 = 0 THEN 'charge_transfer_resistance' END AS property, CASE WHEN p_size % 2 = 0 THEN 'charge_transfer' ELSE 'unknown' END AS role FROM part WHERE p_size > 0""")
def axis_values(t: Tables):
    """Axis values as numbers, and terms of impedance tables."""
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, F.concat("p_size", F.lit(" %"))).when(size % 4 == 1, F.concat(F.lit("−"), "p_size", F.lit(" °C"))).when(size % 4 == 2, F.concat(F.lit("C/"), "p_size")).otherwise(F.concat(F.lit("5 to "), "p_size"))
    prop = F.when(size % 4 == 0, "state_of_charge").when(size % 4 == 1, "temperature").when(size % 4 == 2, "C_rate").otherwise("cycle")
    term = G.circuit_term(F.when(size % 2 == 0, "R ct").otherwise("R9"))
    return t.part.filter("p_size > 0").select("p_partkey", G.axis_scalar(raw, prop).alias("value"), term["property"].alias("property"), term["role"].alias("role"))


@query(_sql("""SELECT o, n, concat_ws('|', CASE WHEN flag <> 'N' AND qty > 25 THEN 'percentage_greater_than_100' END, CASE WHEN flag = 'R' THEN 'normalization_basis_unknown' END, CASE WHEN status = 'F' AND n > 1 THEN 'potential_reference_unknown' END) AS warnings FROM l"""))
def reported_warnings(t: Tables):
    """What reported values are to be warned of."""
    got = G.metric_warnings(F.when(F.col("n") > 1, "onset_potential").otherwise("yield"), F.col("qty") * 4, F.when(F.col("flag") != "N", "%"), F.when(F.col("flag") == "R", "unknown"), F.when(F.col("status") == "F", "unknown").otherwise("rhe"))
    return _lines(t).select("o", "n", F.array_join(got, "|").alias("warnings"))
