"""Queries of what readers look at: calculations, charts, captions, runs and identities of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import status as S
from ..operators import views as U
from .nested import corpus
from .registry import Tables, query


@query("""WITH l AS (SELECT l_orderkey AS o, min(l_extendedprice) AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT 'arc-' || o AS archive_id, 'c-1' AS calculation_id, CASE WHEN o % 4 > 0 THEN 'band_gap' ELSE '' END AS calculated_property, CASE WHEN o % 4 > 0 THEN CAST(CAST(round(price) AS BIGINT) AS VARCHAR) END AS value, CASE WHEN o % 4 > 0 THEN 'eV' ELSE '' END AS unit, 'PBE' AS method,
 'Paper ' || o_custkey AS source_title, 'src-' || o_custkey AS source_id, CASE WHEN o % 4 > 0 THEN 1 END AS source_page, CASE WHEN o % 4 > 0 THEN 'text' ELSE '' END AS evidence_origin, CASE WHEN o % 4 > 0 THEN 'verified_native' ELSE 'unverified' END AS evidence_strength
FROM l JOIN orders ON o_orderkey = o""")
def calculation_rows(t: Tables):
    """Calculations by output; those without outputs keep a row."""
    bare = F.col("metadata.archive_id").rlike("(?:[02468][048]|[13579][26]|-[048])$")
    archives = corpus(t).withColumn("calculations", F.transform("calculations", lambda c: F.when(bare, c.withField("outputs", F.filter(c["outputs"], lambda _: F.lit(False)))).otherwise(c)))
    return U.calculation_view(archives).select("archive_id", "calculation_id", "calculated_property", "value", "unit", "method", "source_title", "source_id", "source_page", "evidence_origin", "evidence_strength")


def _analytic(t: Tables):
    q = F.round("l_quantity").cast("long")
    heat = F.when(q % 4 > 0, q.cast("string")).otherwise("warm")
    conditions = F.map_filter(F.create_map(F.lit("temperature"), F.when(q % 6 > 0, heat), F.lit("temperature_unit"), F.when(q % 3 > 0, F.when(F.col("l_suppkey") % 5 == 0, "K").otherwise("°C")), F.lit("label"), F.when(q % 5 > 0, F.when(q % 2 == 0, "a").otherwise(""))), lambda _, v: v.isNotNull())
    return t.lineitem.select(
        F.col("l_suppkey").alias("archive_id"), F.when(q % 7 > 0, F.concat(F.lit("s"), F.col("l_partkey") % 3)).alias("source_id"), F.when(F.col("l_suppkey") % 2 == 0, "yield_strength").otherwise(F.when(q % 2 == 0, "x").otherwise("y")).alias("property_name"),
        F.when(q % 9 > 0, F.col("l_extendedprice")).alias("value"), F.lit("MPa").alias("unit"), F.when(F.col("l_suppkey") % 3 == 0, F.when(q % 2 == 0, "Pa")).alias("normalized_unit"), conditions.alias("conditions"),
    )


_R = """r AS (SELECT l_suppkey AS a, CAST(round(l_quantity) AS BIGINT) AS q, l_partkey % 3 AS p, l_suppkey AS s FROM lineitem),
f AS (SELECT *, q % 6 > 0 AND q % 4 > 0 AND q % 9 > 0 AS drawn, q % 9 > 0 AS valued FROM r)"""


@query(f"""WITH {_R} SELECT a AS archive_id, CASE WHEN count(DISTINCT CASE WHEN q % 3 > 0 THEN CASE WHEN s % 5 = 0 THEN 'K' ELSE '°C' END END) = 1 THEN min(CASE WHEN q % 3 > 0 THEN CASE WHEN s % 5 = 0 THEN 'K' ELSE '°C' END END) END AS x_unit,
 CASE WHEN count(DISTINCT CASE WHEN valued THEN CASE WHEN s % 3 = 0 AND q % 2 = 0 THEN 'Pa' ELSE 'MPa' END END) = 1 THEN min(CASE WHEN valued THEN CASE WHEN s % 3 = 0 AND q % 2 = 0 THEN 'Pa' ELSE 'MPa' END END) END AS y_unit,
 count(DISTINCT CASE WHEN q % 7 > 0 THEN p END) AS source_count, count(*) AS record_count, count(*) FILTER (drawn) AS drawn_count, 'Temperature' AS x_label,
 CASE WHEN a % 2 = 0 THEN 'Yield Strength' WHEN bool_and(q % 2 = 0) THEN 'X' WHEN bool_and(q % 2 = 1) THEN 'Y' ELSE 'Value' END AS y_label, CASE WHEN a % 2 = 0 THEN 'Yield Strength' WHEN bool_and(q % 2 = 0) THEN 'X' WHEN bool_and(q % 2 = 1) THEN 'Y' ELSE 'Value' END || ' vs Temperature' AS title FROM f GROUP BY a""")
def chart_specifications(t: Tables):
    """A scatter chart for each archive: labels, single units, counts and title."""
    return U.chart_specs(_analytic(t), ["archive_id"], "scatter", "conditions.temperature", "value").select("archive_id", "x_unit", "y_unit", "source_count", "record_count", "drawn_count", "x_label", "y_label", "title")


@query(f"""WITH {_R} SELECT a AS archive_id, CASE WHEN q % 5 > 0 AND q % 2 = 0 THEN 'a' ELSE 'Unspecified' END AS series, count(*) AS n FROM f WHERE drawn GROUP BY 1, 2""")
def chart_series(t: Tables):
    """The rows that a chart can draw, by series."""
    return U.chart_rows(_analytic(t), "line", "conditions.temperature", "value", series="conditions.label").groupBy("archive_id", "series").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT o_custkey AS page_id, o_orderkey AS box, o_orderkey % 100 AS y0 FROM orders),
c AS (SELECT o_custkey AS page_id, o_orderkey % 90 AS y1, 'Table ' || o_orderkey || '. About ' || o_custkey AS caption, CAST(o_orderkey AS VARCHAR) AS num FROM orders WHERE o_orderkey % 3 > 0),
m AS (SELECT page_id, y1, min(caption) AS caption FROM c GROUP BY 1, 2)
SELECT b.page_id, b.box, m.caption, regexp_extract(m.caption, '^Table ([0-9]+)', 1) AS table_number FROM b LEFT JOIN m ON m.page_id = b.page_id AND m.y1 = (SELECT max(y1) FROM m x WHERE x.page_id = b.page_id AND x.y1 <= b.y0)""")
def captions_above(t: Tables):
    """The nearest caption that ends above each box of a page."""
    key, page = F.col("o_orderkey"), F.col("o_custkey").alias("page_id")
    boxes = t.orders.select(page, key.alias("box"), (key % 100).cast("double").alias("y0"))
    text = F.when(key % 3 > 0, F.concat(F.lit(" Table  "), key, F.lit(".\n About "), "o_custkey")).otherwise("Tables are below")
    blocks = t.orders.select(page, (key % 90).cast("double").alias("y1"), text.alias("text"))
    return U.caption_above(boxes, blocks).select("page_id", "box", "caption", "table_number")


@query("""SELECT o_orderdate AS run_id, count(DISTINCT o_orderkey) AS archives, list_aggregate(list_sort(list(DISTINCT 's' || o_custkey)), 'string_agg', ',') AS source_ids, list_aggregate(list_sort(list(DISTINCT lower(substr(o_orderpriority, 3)))), 'string_agg', ',') AS domains FROM orders GROUP BY 1""")
def run_identities(t: Tables):
    """What each day's run extracted: archives, sources and domains."""
    archives = t.orders.select(F.col("o_orderdate").alias("run_id"), F.col("o_orderkey").alias("archive_id"), F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.lower(F.substring("o_orderpriority", 3, 99)).alias("domain"))
    return U.run_identity(archives).select("run_id", "archives", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("domains", ",").alias("domains"))


@query("""WITH r AS (SELECT 'p' || l_linenumber AS property, CASE WHEN l_suppkey % 2 = 0 THEN '%' END AS unit, l_partkey % 4 AS sample, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS medium, l_quantity AS value FROM lineitem)
SELECT property, unit, sample, medium, count(*) AS results, count(DISTINCT value) AS values FROM r GROUP BY 1, 2, 3, 4""")
def result_identities(t: Tables):
    """Results that may be compared, by all dimensions that keep them apart."""
    part = F.col("l_partkey")
    conditions = F.map_filter(F.create_map(F.lit("sample_label"), (part % 4).cast("string"), F.lit("medium"), F.when(part % 3 > 0, (part % 3).cast("string")), F.lit("note"), F.col("l_orderkey").cast("string")), lambda _, v: v.isNotNull())
    rows = t.lineitem.select(F.concat(F.lit("p"), "l_linenumber").alias("property"), F.when(F.col("l_suppkey") % 2 == 0, "%").alias("unit"), F.lit(None).cast("string").alias("method"), conditions.alias("conditions"), F.col("l_quantity").alias("value"))
    return U.result_groups(rows).select("identity.property", "identity.unit", F.col("identity.sample_label").cast("long").alias("sample"), F.col("identity.medium").cast("long").alias("medium"), "results", "values")


@query("""WITH j AS (SELECT *, o_orderkey % 6 AS k, o_orderkey % 5 AS s FROM orders)
SELECT CASE WHEN k = 0 THEN NULL ELSE 'job-' || o_orderkey END AS job_id, CASE s WHEN 0 THEN 'RECONCILIATION_REQUIRED' WHEN 1 THEN 'WAITING_PROVIDER' ELSE 'FAILED' END AS state, CASE s WHEN 0 THEN 'Reconciliation Required' WHEN 1 THEN 'Waiting Provider' ELSE 'Failed' END AS stage,
 CASE k WHEN 0 THEN 'paper.pdf' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'key [REDACTED].pdf' WHEN 4 THEN NULL ELSE 'a b.pdf' END AS source_filename, CASE WHEN k % 2 = 0 THEN left(sha256(CAST(o_orderkey AS VARCHAR)), 12) END AS source_sha256_prefix,
 s = 0 OR (s = 1 AND k > 2) AS reconciliation_required, CASE WHEN s = 0 OR (s = 1 AND k > 2) THEN 'outcome_uncertain' WHEN s = 2 THEN 'provider timeout' END AS status_reason FROM j""")
def shown_jobs(t: Tables):
    """Jobs without paths, keys or anything that is no plain identifier."""
    key = F.col("o_orderkey")
    k, s, no = key % 6, key % 5, F.lit(None).cast("string")
    jobs = t.orders.select(
        F.when(k == 0, F.concat(F.lit("/etc/"), key)).otherwise(F.concat(F.lit("job-"), key)).alias("job_id"), no.alias("run_id"), F.when(s == 0, "RECONCILIATION_REQUIRED").when(s == 1, "WAITING_PROVIDER").otherwise("FAILED").alias("state"), no.alias("domain"), no.alias("provider"), no.alias("model"),
        F.when(s == 2, "provider_timeout").alias("error_class"), F.col("o_orderdate").alias("created_at"), F.when(k == 0, "paper.pdf").when(k == 1, "../x.pdf").when(k == 2, "C:\\x.pdf").when(k == 3, "key sk-abcdefgh1234.pdf").when(k == 5, "a b.pdf").alias("filename"),
        F.when(k % 2 == 0, F.sha2(key.cast("string"), 256)).otherwise("zz").alias("sha256"), F.when(k > 2, "call").alias("uncertain_action"),
    )
    return S.shown_jobs(jobs).select("job_id", "state", "stage", "source_filename", "source_sha256_prefix", "reconciliation_required", "status_reason")


@query("""SELECT l_orderkey || '-' || l_linenumber AS run_id, l_linenumber % 3 AS case_id, m.score, m.version FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l LEFT JOIN (SELECT o_orderkey, max(o_custkey) AS score, 'v' || max(o_custkey) % 2 AS version FROM orders GROUP BY 1) m ON m.o_orderkey = l_orderkey AND l_linenumber = 2""")
def frozen_run_scores(t: Tables):
    """Runs with what is frozen for exactly their case, run and model."""
    run = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    runs = t.lineitem.select(run.alias("run_id"), (F.col("l_linenumber") % 3).alias("case_id"), F.lit("m").alias("exact_model")).distinct()
    manifest = t.orders.select(F.concat("o_orderkey", F.lit("-2")).alias("run_id"), F.lit(2).alias("case_id"), F.lit("m").alias("exact_model"), F.col("o_custkey").alias("score"), F.concat(F.lit("v"), F.col("o_custkey") % 2).alias("version"))
    return S.frozen_runs(runs, manifest, ["score", "version"]).select("run_id", "case_id", "score", "version")
