"""Queries that run the scoring, table, journal, assembly and review operators and the column functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import assembly, journal, review, scoring, tables
from ..operators import evidence as E
from .registry import Tables, query

#: One row for each order and line number, in both engines.
_LINES = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supp, CAST(min(l_quantity) AS BIGINT) AS qty, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)"


def _lines(t: Tables):
    least = [F.min(c).alias(a) for c, a in (("l_partkey", "part"), ("l_suppkey", "supp"), ("l_returnflag", "flag"), ("l_linestatus", "status"))]
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(*least, F.min("l_quantity").cast("long").alias("qty"))


def _sql(text: str) -> str:
    return f"WITH {_LINES} {text}"


@query(_sql("SELECT g.o, g.n FROM l g WHERE EXISTS (SELECT 1 FROM l s WHERE s.n = 2 AND s.o = g.o AND s.status = g.status AND (g.flag = 'N' OR s.flag = g.flag)) AND g.n <> 2"))
def gold_metric_match(t: Tables):
    """Gold rows that some observation meets in the fields that the gold asserts."""
    gold = _lines(t).filter("n <> 2").withColumn("unit", F.when(F.col("flag") != "N", F.col("flag")))
    seen = _lines(t).filter("n = 2").select("o", F.col("status").alias("kind"), F.col("flag").alias("found"))
    return scoring.metric_match(gold, seen, ["o"], {"status": "kind", "unit": "found"}).select("o", "n")


@query(_sql("SELECT o AS case_id, count(*) AS assertions, count(*) FILTER (flag <> 'R') AS matched, round(count(*) FILTER (flag <> 'R') / count(*), 9) AS score, count(*) FILTER (flag <> 'R') = count(*) AS closed FROM l GROUP BY 1"))
def case_closure(t: Tables):
    """Share of assertions that hold by case; a case closes only if all do."""
    cases = scoring.assertion_score(_lines(t).select(F.col("o").alias("case_id"), (F.col("flag") != "R").alias("passed")))
    return scoring.closure(cases).withColumn("score", F.round("score", 9))


@query(_sql("SELECT 'positive' AS name, bool_and(qty > 0) AS holds FROM l UNION ALL SELECT 'never_returned', bool_and(flag <> 'R') FROM l"))
def corpus_invariants(t: Tables):
    """Named invariants over all rows."""
    return scoring.invariants(_lines(t), {"positive": F.col("qty") > 0, "never_returned": F.col("flag") != "R"})


@query(_sql("""SELECT 'p' || (supp % 7) AS provider, count(*) AS runs, count(*) FILTER (status = 'F') AS succeeded, round(count(*) FILTER (status = 'F') / count(*), 9) AS success_rate,
 round(count(*) FILTER (status = 'F' AND qty > 25) / nullif(count(*) FILTER (status = 'F'), 0), 9) AS schema_valid_rate, count(DISTINCT flag) AS models FROM l GROUP BY 1"""))
def provider_summary(t: Tables):
    """Runs by provider with rates over the runs that have what a rate is of."""
    runs = _lines(t).select(F.concat(F.lit("p"), F.col("supp") % 7).alias("provider"), F.when(F.col("status") == "F", "succeeded").otherwise("failed").alias("status"), (F.col("qty") > 25).alias("valid"), F.col("flag").alias("model"))
    rate = lambda c: F.round(c, 9).alias(c)
    return scoring.provider_groups(runs).select("provider", "runs", "succeeded", rate("success_rate"), rate("schema_valid_rate"), F.size("models").cast("long").alias("models"))


@query("SELECT o_orderkey AS path, 'current' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'historic' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def current_over_history(t: Tables):
    """Current rows, and historic ones without a current one."""
    at = lambda by, name: t.orders.filter(F.col("o_orderkey") % by == 0).select(F.col("o_orderkey").alias("path"), F.lit(name).alias("origin"))
    return scoring.latest_over_history(at(3, "current"), at(2, "historic"), "path")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'absent' WHEN o_orderkey % 5 = 0 THEN 'mismatched' ELSE 'verified' END AS status FROM orders")
def artifact_status(t: Tables):
    """Artifacts that are absent, mismatched or verified."""
    key = F.col("o_orderkey")
    expected = t.orders.select(key.cast("string").alias("path"), F.sha2(key.cast("string"), 256).alias("sha256"))
    found = t.orders.filter(key % 4 != 0).select(key.cast("string").alias("path"), F.sha2(F.when(key % 5 == 0, F.lit("other")).otherwise(key.cast("string")), 256).alias("sha256"))
    return scoring.artifact_integrity(expected, found)


@query("""WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS slug, o_orderpriority AS role FROM orders)
SELECT 'duplicate_slug' AS rule, slug AS key FROM e GROUP BY slug HAVING count(*) > 1 UNION ALL SELECT 'missing_role', 'never' UNION ALL SELECT 'extra_role', role FROM e WHERE role <> '5-LOW'""")
def manifest_violations(t: Tables):
    """Duplicates, and missing and extra roles of a manifest."""
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("slug"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("checksum"), F.col("o_orderpriority").alias("benchmark_role"))
    return scoring.validate_manifest(rows, ["slug"], ["slug"], ["5-LOW", "never"])


@query(_sql("SELECT o, count(*) AS expected, count(*) FILTER (n % 2 = 0) AS found FROM l GROUP BY 1"))
def series_points_found(t: Tables):
    """Points of each series that were observed at their coordinate."""
    gold = _lines(t).select("o", F.col("n").cast("double").alias("x"), F.col("qty").cast("double").alias("y"))
    seen = gold.select("o", "x", F.when(F.col("x") % 2 == 0, F.col("y") + 1e-10).otherwise(F.col("y") + 1).alias("y"))
    return scoring.series_recall(gold, seen, ["o"], "x", "y")


@query(_sql("SELECT o AS table_id, max(n) + 1 AS height, count(*) AS filled, max(n) + 1 - count(*) AS gaps FROM l GROUP BY 1"))
def dense_grid(t: Tables):
    """Cells as a dense list of rows, gaps null."""
    cells = _lines(t).select(F.col("o").alias("table_id"), F.col("n").alias("row"), F.lit(0).alias("col"), F.col("flag").alias("text"))
    flat = F.flatten("grid")
    full = F.size(F.filter(flat, lambda x: x.isNotNull())).cast("long")
    return tables.grid(cells).select("table_id", F.size("grid").alias("height"), full.alias("filled"), (F.size(flat) - full).cast("long").alias("gaps"))


@query(_sql("SELECT o AS table_id, n AS row, max(CASE WHEN flag <> 'N' THEN n * 10 + CASE flag WHEN 'A' THEN 1 ELSE 2 END END) OVER (PARTITION BY o ORDER BY n) AS code FROM l"))
def merged_row_labels(t: Tables):
    """Cells with the last label at or above their row."""
    cells = _lines(t).select(F.col("o").alias("table_id"), F.col("n").alias("row"), F.lit(0).alias("col"), F.when(F.col("flag") == "N", F.lit(" ")).otherwise((F.col("n") * 10 + F.when(F.col("flag") == "A", 1).otherwise(2)).cast("string")).alias("text"))
    return tables.row_labels(cells).select("table_id", "row", F.col("row_label").cast("int").alias("code"))


@query(_sql("SELECT b.o AS table_id, b.n AS row, h.flag AS column_axis, CAST(b.qty AS VARCHAR) AS text, b.status AS row_axis FROM l b JOIN l h ON h.o = b.o AND h.n = 1 WHERE b.n > 1"))
def matrix_cells(t: Tables):
    """Body cells bound to their row's first cell and their column's header."""
    l = _lines(t)  # noqa: E741
    cell = lambda row, col, text: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"))
    head, side, body = cell(F.lit(0), 1, F.col("flag")), cell(F.col("n"), 0, F.col("status")), cell(F.col("n"), 1, F.col("qty"))
    cells = l.select(F.col("o").alias("table_id"), F.explode(F.when(F.col("n") == 1, F.array(head)).otherwise(F.array(side, body))).alias("c")).select("table_id", "c.*")
    return tables.matrix_points(cells).select("table_id", "row", "column_axis", "text", "row_axis")


@query(_sql("SELECT p.o, p.n, (SELECT count(*) FROM l m WHERE m.o = p.o AND m.qty = p.qty) AS matches FROM l p"))
def point_cell_matches(t: Tables):
    """How many cells of its table have a point's value; only one binds it."""
    l = _lines(t)  # noqa: E741
    points, cells = l.select("o", "n", F.col("qty").cast("double").alias("value")), l.select("o", F.col("n").alias("at"), F.col("qty").cast("double").alias("value"))
    return tables.match_points(points, cells, ["o"]).select("o", "n", "matches")


@query(_sql("SELECT o, n, max(CASE WHEN status = 'F' THEN n END) OVER (PARTITION BY o ORDER BY n) AS heading FROM l"))
def section_of_point(t: Tables):
    """Points with the last heading at or before their place."""
    l = _lines(t)  # noqa: E741
    marks = l.filter("status = 'F'").select("o", "n", F.col("n").cast("string").alias("heading"))
    return tables.section_at(marks, l.select("o", "n"), "o", "n", "heading").select("o", "n", F.col("heading").cast("int").alias("heading"))


@query(_sql("SELECT o, flag AS name, n AS value FROM l"))
def zipped_series(t: Tables):
    """Parallel lists as points; lists of unequal length are refused."""
    rows = _lines(t).groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", "flag"))).alias("x"))
    rows = rows.select("o", F.col("x.flag").alias("names"), F.col("x.n").alias("numbers"))
    odd = rows.withColumn("numbers", F.slice("numbers", 2, 1 << 20))
    return tables.zip_series(rows.unionByName(odd), "names", "numbers").select("o", "name", "value")


@query(_sql("""SELECT o AS table_id, CASE WHEN count(*) = 1 THEN 'empty_table' WHEN count(*) FILTER (flag = 'N') > 0 THEN 'missing_header' WHEN count(DISTINCT flag) <> count(*) THEN 'duplicate_headers' END AS reason FROM l GROUP BY 1"""))
def table_refusals(t: Tables):
    """Why a table is refused: no rows, a missing or repeated header."""
    per = _lines(t).groupBy(F.col("o").alias("table_id")).agg(F.collect_list(F.when(F.col("flag") == "N", F.lit(" ")).otherwise(F.col("flag"))).alias("headers"))
    rows = per.withColumn("rows", F.when(F.size("headers") == 1, F.expr("filter(array(headers), x -> false)")).otherwise(F.array("headers")))
    return tables.normalize_table(rows).select("table_id", "reason")


@query("""WITH e AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'VALIDATING' END AS state FROM events)
SELECT job_id, max(version) AS version, arg_max(state, version) AS state, CASE arg_max(state, version) WHEN 'FAILED' THEN 'terminal' ELSE 'resume' END AS plan FROM e GROUP BY 1""")
def job_fold(t: Tables):
    """Each job's current state and what may be done with it."""
    return journal.safe_to_resume(journal.fold_jobs(_jobs(t))[0].withColumn("open_intent", F.lit(False))).select("job_id", "version", "state", "plan")


def _jobs(t: Tables):
    from pyspark.sql import Window

    state = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "error", "FAILED").otherwise("VALIDATING")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t.events.select(F.col("user_id").alias("job_id"), version.alias("version"), state.alias("state"))


@query("""WITH e AS (SELECT user_id AS job_id, row_number() OVER w AS version, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'VALIDATING' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY version) AS prev FROM e)
SELECT job_id, version, CASE WHEN prev IS NULL THEN 'corrupt job-state creation record' ELSE 'corrupt job-state transition record' END AS reason FROM p
WHERE (prev IS NULL AND state <> 'PENDING') OR (prev IS NOT NULL AND state <> prev AND prev || '>' || state NOT IN ('PENDING>RUNNING', 'PENDING>FAILED', 'RUNNING>VALIDATING', 'RUNNING>FAILED', 'VALIDATING>FAILED'))""")
def job_violations(t: Tables):
    """Job events that may not follow the one before."""
    return journal.fold_jobs(_jobs(t))[1].select("job_id", "version", "reason")


@query("""SELECT user_id AS action_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def action_conflicts(t: Tables):
    """Action ids that came with several inputs."""
    return journal.operator_actions(t.events.select(F.col("user_id").alias("action_id"), F.col("event_type").alias("inputs"), F.col("event_id").alias("seq")))[1]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 3 = 1 AS conflict FROM orders WHERE o_orderkey % 3 <> 2")
def idempotent_append(t: Tables):
    """What an append adds, and known ids that come with another row; known rows are no news."""
    row = lambda cond, by: t.orders.filter(cond).select(F.col("o_orderkey").cast("string").alias("id"), by.alias("body"))
    key = F.col("o_orderkey")
    old = row(key % 3 != 0, F.col("o_orderpriority"))
    new = row(F.lit(True), F.when(key % 3 == 1, F.lit("changed")).otherwise(F.col("o_orderpriority")))
    add, conflicts = journal.append_log(old, new, "id")
    return add.select("id", F.lit(False).alias("conflict")).unionByName(conflicts.select("id", F.lit(True).alias("conflict")))


@query(_sql("SELECT o, n, round((CAST(qty > 10 AS INTEGER) + CAST(flag = 'R' AND status = 'F' AS INTEGER)) / (1 + CAST(flag = 'R' AS INTEGER)), 9) AS complete, round((CAST(qty > 10 AS INTEGER) + CAST(flag = 'R' AND status = 'F' AS INTEGER)) / (1 + CAST(flag = 'R' AS INTEGER)) * n / (n + 3), 9) AS admitted FROM l"))
def completeness_of_applicable(t: Tables):
    """Share of the checks that hold of those that apply, and that scaled by admission."""
    own = assembly.completeness([(F.lit(True), F.col("qty") > 10), (F.col("flag") == "R", F.col("status") == "F")])
    return _lines(t).select("o", "n", F.round(own, 9).alias("complete"), F.round(assembly.admitted_share(own, F.col("n"), F.lit(3)), 9).alias("admitted"))


@query("SELECT conv_id AS source_id, CAST(turn AS INTEGER) AS page, length(trim(text)) AS n FROM conversations WHERE turn <= 2 AND text NOT LIKE '%=====%'")
def marked_pages(t: Tables):
    """Pages joined under markers and told apart again."""
    pages = t.conversations.filter("turn <= 2 and text not like '%=====%'").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), F.trim("text").alias("text"))
    return assembly.split_marked(assembly.marked_text(pages, 1 << 30)).select("source_id", "page", F.length("text").cast("long").alias("n"))


@query(_sql("SELECT o, n, coalesce(CASE WHEN flag <> 'N' THEN flag END, CASE WHEN n > 1 THEN 'shared' END) AS method FROM l"))
def shared_protocols(t: Tables):
    """Fields of a group: inline if given, else from its first protocol that has them."""
    groups = _lines(t).select(F.concat_ws(":", "o", "n").alias("group_id"), "o", "n", F.when(F.col("flag") != "N", F.col("flag")).alias("method"), F.when(F.col("n") > 1, F.array(F.lit("p0"), F.lit("p1"))).otherwise(F.array(F.lit("p0"))).alias("protocol_refs"))
    protocols = t.region.limit(1).select(F.explode(F.array(F.struct(F.lit("p0").alias("protocol_id"), F.lit(None).cast("string").alias("method")), F.struct(F.lit("p1").alias("protocol_id"), F.lit("shared").alias("method")))).alias("p")).select("p.*")
    return assembly.resolve_protocol(groups, protocols, ["method"]).select("o", "n", "method")


@query("SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'O' THEN 'review_summary' ELSE CASE o_orderstatus WHEN 'O' THEN 'cited_prior_work' WHEN 'F' THEN 'focal_work' ELSE 'unknown' END END AS ownership FROM orders")
def review_ownership(t: Tables):
    """Records of pure reviews that were held focal or of unknown owner."""
    own = F.when(F.col("o_orderstatus") == "O", "cited_prior_work").when(F.col("o_orderstatus") == "F", "focal_work").otherwise("unknown")
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("source_id"), own.alias("ownership"))
    label = F.when(F.col("c_custkey") % 2 == 0, "Review\nThis review summarizes much.").otherwise("Review\nMethods")
    signals = review.review_signals(t.customer.select(F.col("c_custkey").alias("source_id"), F.lit(1).alias("page"), label.alias("text")))
    return review.guard_ownership(records, signals).select("record_id", "ownership")


@query("SELECT p_partkey AS id, 'https://doi.org/10.1000/' || p_partkey AS url, '10.1000/' || p_partkey AS doi, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Untitled discovery result' END AS title FROM part WHERE p_partkey % 3 <> 0")
def discovered_papers(t: Tables):
    """Search results as candidates; unsafe links are left out."""
    key = F.col("p_partkey").cast("string")
    link = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("javascript:"), key)).otherwise(F.concat(F.lit("https://doi.org/10.1000/"), key))
    hit = F.struct(link.alias("link"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit(" ")).alias("title"), F.lit("").alias("snippet"))
    got = review.discovery_candidates(t.part.select(key.alias("query"), F.array(hit).alias("organic")))
    return got.select(F.col("query").cast("long").alias("id"), "url", "doi", "title")


@query(_sql("SELECT o, n, CASE WHEN n > 5 THEN 'unknown_table' WHEN n = 5 THEN 'unknown_cell' WHEN qty < 5 THEN 'empty_claim' WHEN flag = 'R' THEN 'cell_text_mismatch' END AS reason FROM l"))
def cell_claims(t: Tables):
    """Claims about table cells with the reason for which they are rejected."""
    claims = _lines(t).select("o", "n", F.when(F.col("n") > 5, "t9").otherwise("t0").alias("table_id"), F.col("n").alias("row"), F.lit(0).alias("col"), F.when(F.col("qty") < 5, "").when(F.col("flag") == "R", "other").otherwise(F.concat(F.lit("cell "), F.col("n"))).alias("claim_text"))
    cells = t.region.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row")).select(F.lit("t0").alias("table_id"), "row", F.lit(0).alias("col"), F.concat(F.lit("cell  "), F.col("row")).alias("text"))
    return E.verify_cells(claims, cells).select("o", "n", "reason")


@query("""SELECT p_partkey, replace(p_name, ' ', '-') AS slug, upper(p_name[1]) || substr(p_name, 2, position(' ' IN p_name) - 1) || upper(substr(p_name, position(' ' IN p_name) + 1, 1)) || substr(p_name, position(' ' IN p_name) + 2) AS shown,
 CAST(p_size AS DOUBLE) AS value, 'mA' AS unit, 1.0 / p_size AS rate, p_size || ' °C' AS raw FROM part WHERE p_size > 0""")
def scalar_texts(t: Tables):
    """Names as slugs and words, quantities and C-rates as numbers."""
    q = N.parse_quantity(F.concat(F.lit("~"), F.col("p_size"), F.lit(" mA")))
    rate, heat = N.scalar_condition(F.concat(F.lit("C/"), F.col("p_size"))), N.scalar_condition(F.concat("p_size", F.lit(" °C")))
    return t.part.filter("p_size > 0").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.humanize(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("shown"), q["value"].alias("value"), q["unit"].alias("unit"), rate["value"].alias("rate"), heat["raw"].alias("raw"))


@query("""SELECT p_partkey, (p_size - 1) * 10 AS linear, p_size = 7 AS printed, CASE WHEN p_size % 2 = 0 THEN 'unit' || p_size END AS header_unit, length('x' || p_partkey) > 2 AND p_size > 3 AS overlaps FROM part""")
def measured_texts(t: Tables):
    """Pixels as data, numbers that a text prints, units of headers, snippets that hold one another."""
    size = F.col("p_size")
    header = F.concat(F.lit("Rate"), F.when(size % 2 == 0, F.concat(F.lit(" (unit"), size, F.lit(")"))).otherwise(""))
    a, b = F.concat(F.lit("x"), F.col("p_partkey")), F.concat(F.lit("see x"), F.col("p_partkey"))
    linear = N.pixel_to_data(size.cast("double"), F.lit(1.0), F.lit(11.0), F.lit(0.0), F.lit(100.0))
    return t.part.select("p_partkey", F.round(linear).cast("int").alias("linear"), N.supports_value(F.concat(F.lit("about "), size, F.lit(" units")), F.lit(7.0)).alias("printed"), X.header_unit(header).alias("header_unit"), (X.snippet_overlap(a, b) & (F.length(a) > 2) & (size > 3)).alias("overlaps"))
