"""Queries of sensor records, routing and files: an order is a paper, its lines are samples; texts say what their numbers decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as G
from ..operators import sensors as N
from ..sources import sinks
from ..sources.settled import shared_folder
from .registry import Tables, query


def _lines(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.round(F.min("l_quantity")).cast("long").alias("q"), (F.min("l_partkey") % 3).alias("m"))


def _records(t: Tables):
    """Papers with samples that lack one thing or another, in several units."""
    n, q, m = F.col("n"), F.col("q"), F.col("m")
    quantity = lambda v, u: F.struct(v.cast("double").alias("value"), u.alias("unit"), F.lit(None).cast("double").alias("normalized_value"), F.lit(None).cast("string").alias("normalized_unit"))
    none = F.lit(None).cast(N._QUANTITY)
    unit = F.when(q % 3 == 0, "min").when(q % 3 == 1, "s").otherwise("cycles")
    heat = F.when(q % 4 > 0, quantity(q % 2 * 100 + 25, F.lit("°C"))).otherwise(none)
    much = F.when(q % 5 > 0, quantity(q % 2 + 1, F.when(q % 2 == 0, "ppb").otherwise("ppm"))).otherwise(none)
    timed = lambda held: F.when(held, F.struct(quantity(q, unit).alias("value"), F.when(q % 6 > 0, "t90").alias("criterion"), none.alias("concentration"), F.when(q % 8 == 0, quantity(F.lit(300), F.lit("°C"))).otherwise(none).alias("operating_temperature")))
    entry = lambda name, ratio, a, b: F.struct(name.alias("interferent"), ratio.cast("double").alias("selectivity_ratio"), a.cast("double").alias("target_response"), b.cast("double").alias("interferent_response"))
    no = F.lit(None)
    entries = F.when(q % 3 == 0, F.array(entry(F.lit("H2"), q, no, no), entry(F.lit("CO"), no, q, F.when(q % 2 == 0, F.lit(2))))).when(q % 3 == 1, F.array(entry(no.cast("string"), no, no, no)))
    kind = "array<struct<interferent string, selectivity_ratio double, target_response double, interferent_response double>>"
    sample = F.struct(
        F.when(q % 2 == 0, F.concat(F.lit("s"), n)).alias("sample_id"), F.concat(F.lit("M"), m).alias("material"), F.lit("oxide").alias("material_category"), F.when(q % 9 > 0, "resistive").alias("sensor_type"), F.when(q % 7 == 0, "Own title").alias("source_paper_title"), F.lit(None).cast("string").alias("source_doi"),
        F.struct(F.lit("wet").alias("method_family"), F.lit("spin").alias("method"), F.lit("x").alias("method_variant"), F.lit("Si").alias("substrate")).alias("deposition"), F.struct(F.concat(F.lit("gas"), n % 2).alias("target_analyte"), much.alias("concentration"), heat.alias("operating_temperature")).alias("testing"),
        F.struct(
            F.struct(F.when(q % 5 > 0, quantity(q, F.lit("%"))).otherwise(none).alias("value"), F.lit("f").alias("formula"), (q % 10 > 2).alias("has_evidence")).alias("sensitivity"), F.when(q % 4 == 0, quantity(q, F.lit("ppb"))).otherwise(none).alias("limit_of_detection"),
            timed(q % 11 > 0).alias("response_time"), timed(q % 2 == 0).alias("recovery_time"), F.struct(F.when(q % 2 == 0, "NO2").alias("target_analyte"), entries.cast(kind).alias("entries")).alias("selectivity"),
        ).alias("performance"),
    )
    rows = _lines(t).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", sample.alias("x")))).alias("s"))
    held = rows.select(F.struct(F.concat(F.lit("Paper "), "o").alias("title"), F.concat(F.lit("10.1/"), "o").alias("doi")).alias("paper"), F.transform("s", lambda s: s["x"]).alias("samples"))
    return N.normalize(N.merge_records(held))


_S = r"""
l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(round(min(l_quantity)) AS BIGINT) AS q, min(l_partkey) % 3 AS m FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN q % 7 = 0 THEN 'Own title' ELSE 'Paper ' || o END AS title, 'M' || m AS material, CASE WHEN q % 9 > 0 THEN 'resistive' END AS sensor_type, 'gas' || n % 2 AS target, CASE WHEN q % 2 = 0 THEN 's' || n END AS sid,
  CAST(CASE q % 3 WHEN 0 THEN q * 60 ELSE q END AS DOUBLE) AS secs, q % 11 > 0 AS responds, CAST(CASE WHEN q % 5 > 0 THEN CASE WHEN q % 2 = 0 THEN 0.001 ELSE 2.0 END END AS DOUBLE) AS ppm, CAST(CASE WHEN q % 8 = 0 THEN 300 WHEN q % 4 > 0 THEN q % 2 * 100 + 25 END AS DOUBLE) AS heat FROM l),
p AS (SELECT *, title || ' | ' || coalesce(sid, material) AS label FROM s)
"""


@query(f"""WITH {_S} SELECT label AS sample, pair, avg(ratio) AS ratio FROM (
 SELECT label, CASE WHEN q % 2 = 0 THEN 'NO2' ELSE target END || '/H2' AS pair, CAST(q AS DOUBLE) AS ratio FROM p WHERE q % 3 = 0
 UNION ALL SELECT label, 'NO2/CO', q / 2.0 FROM p WHERE q % 3 = 0 AND q % 2 = 0) GROUP BY 1, 2""")
def sensor_selectivity(t: Tables):
    """Mean selectivity of each sample and pair, computed where both responses are given."""
    return N.selectivity(_records(t))


@query(f"""WITH {_S} SELECT label AS sample, title AS source_paper, material, sensor_type, target AS target_analyte, heat AS temperature_C, ppm AS concentration_ppm, secs AS response_time, CASE q % 3 WHEN 2 THEN 'cycles' ELSE 's' END AS response_time_unit FROM p WHERE responds""")
def sensor_response_points(t: Tables):
    """Response times in seconds, at their own or the test's temperature, concentrations in ppm."""
    return N.response_points(_records(t)).select("sample", "source_paper", "material", "sensor_type", "target_analyte", "temperature_C", "concentration_ppm", "response_time", "response_time_unit")


@query(f"""WITH {_S} SELECT material, target AS target_analyte, sensor_type, count(*) AS n, count(DISTINCT heat) AS temperatures, count(DISTINCT ppm) AS concentrations FROM p WHERE responds AND heat IS NOT NULL AND ppm IS NOT NULL GROUP BY 1, 2, 3
HAVING count(*) >= 4 AND count(DISTINCT heat) >= 2 AND count(DISTINCT ppm) >= 2""")
def sensor_response_groups(t: Tables):
    """Groups of samples dense enough for a contour of response times."""
    return N.response_groups(_records(t))


@query(f"""WITH {_S}, r AS (SELECT label AS sample, target AS target_analyte, sensor_type, CASE WHEN q % 3 = 0 THEN CAST(q AS DOUBLE) END AS selectivity, CASE WHEN responds THEN 1.0 / secs END AS response_speed, CASE WHEN q % 2 = 0 THEN 1.0 / secs END AS recovery_speed,
  CASE WHEN q % 5 > 0 THEN CAST(q AS DOUBLE) END AS sensitivity, CASE WHEN q % 4 = 0 THEN 1.0 / q END AS detection_capability FROM p WHERE sensor_type IS NOT NULL),
e AS (SELECT *, count(*) OVER (PARTITION BY target_analyte, sensor_type) AS k FROM r WHERE CAST(selectivity IS NOT NULL AS INT) + CAST(response_speed IS NOT NULL AS INT) + CAST(recovery_speed IS NOT NULL AS INT) + CAST(sensitivity IS NOT NULL AS INT) + CAST(detection_capability IS NOT NULL AS INT) >= 3)
SELECT sample, target_analyte, sensor_type, selectivity, response_speed, recovery_speed, sensitivity, detection_capability FROM e WHERE k >= 2""")
def sensor_radar_groups(t: Tables):
    """Samples with three metrics or more, of targets with two samples or more."""
    return N.radar_groups(_records(t))


@query(f"""WITH {_S}, w AS (SELECT coalesce(sid, material) AS sample, unnest([CASE WHEN q % 5 > 0 AND q % 10 <= 2 THEN 'sensitivity' END, CASE WHEN responds AND q % 6 = 0 THEN 'response-time' END, CASE WHEN q % 2 = 0 AND q % 6 = 0 THEN 'recovery-time' END, CASE WHEN q % 3 = 1 THEN 'selectivity' END]) AS about FROM s)
SELECT sample, about, count(*) AS n FROM w WHERE about IS NOT NULL GROUP BY 1, 2""")
def sensor_warnings(t: Tables):
    """What keeps the values of samples from being compared, by sample and kind."""
    return N.warnings(_records(t)).select("sample", F.regexp_extract("warning", r"^(\S+)", 1).alias("about")).groupBy("sample", "about").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_S}, f AS (SELECT 'Paper ' || o AS paper_title, coalesce(sid, 'sample_' || row_number() OVER (PARTITION BY o ORDER BY n)) AS sample_id, material, q, CASE q % 3 WHEN 0 THEN ['H2', 'CO'] ELSE [NULL] END AS gases FROM s)
SELECT paper_title, sample_id, material, CASE WHEN q % 5 > 0 THEN CAST(q AS DOUBLE) END AS sensitivity_value, gas AS selectivity_interferent, CASE WHEN gas = 'H2' THEN CAST(q AS DOUBLE) END AS selectivity_ratio FROM f, unnest(gases) u(gas)""")
def sensor_rows(t: Tables):
    """Samples flattened by their selectivity entries, one row for those without any."""
    return N.flatten(_records(t)).select("paper_title", "sample_id", "material", "sensitivity_value", "selectivity_interferent", "selectivity_ratio")


_DOMAINS = [
    G.Domain("batteries", ("battery", "cathode", "c-rate"), (("cell_context", 3.0, (("cathode",), ("capacity",))),)),
    G.Domain("corrosion", ("corrosion", "pitting", "eis"), (("corrosion_context", 3.5, (("corrosion",), ("eis",))),)),
    G.Domain("photovoltaics", ("solar cell", "efficiency"), (("pv_context", 3.0, (("solar cell",), ("voc",))),), needs_focal=True),
]


def _texts(t: Tables):
    """Texts whose words follow from the line's numbers: repeated terms, cited work, own work, nothing."""
    n, q = F.col("n"), F.col("q")
    parts = [
        F.when(q % 2 == 0, F.repeat(F.lit("The battery. "), (q % 7).cast("int"))), F.when(q % 3 == 0, "We measured the cathode. "), F.when(q % 5 == 0, "capacity was high. "), F.when(q % 4 == 1, F.repeat(F.lit("Corrosion and EIS. "), (n % 3 + 1).cast("int"))),
        F.when(q % 6 == 5, "In prior work pitting was cited. "), F.when(q % 7 == 3, "A solar cell of good efficiency. "), F.when(q % 9 == 1, "Voc was measured. We measured the solar cell. "),
    ]
    return _lines(t).select(F.concat("o", F.lit("-"), "n").alias("doc_id"), F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).alias("text"), "n", "q")


_W = lambda x: f"(CASE WHEN {x} > 0 THEN 1 + 0.25 * least({x} - 1, 4) ELSE 0 END)"


@query(f"""WITH {_S}, c AS (SELECT o || '-' || n AS doc_id, CASE WHEN q % 2 = 0 THEN q % 7 ELSE 0 END AS bat, CAST(q % 3 = 0 AS INT) AS cat, q % 5 = 0 AS cap, CASE WHEN q % 4 = 1 THEN n % 3 + 1 ELSE 0 END AS cor, CAST(q % 6 = 5 AS INT) AS pit, CAST(q % 7 = 3 AS INT) AS eff, CAST(q % 7 = 3 AS INT) + CAST(q % 9 = 1 AS INT) AS sol, q % 9 = 1 AS voc FROM l)
SELECT doc_id, d.domain, CAST(CASE d.domain WHEN 'batteries' THEN greatest(0, {_W('bat')} + {_W('cat')} + CASE WHEN cat > 0 AND cap THEN 3 ELSE 0 END + 0.5 * (cat + CAST(cat > 0 AND cap AS INT)))
  WHEN 'corrosion' THEN greatest(0, {_W('cor')} * 2 + {_W('pit')} + CASE WHEN cor > 0 THEN 4.0 ELSE 0 END - 0.75 * pit) ELSE greatest(0, {_W('sol')} + {_W('eff')} + CASE WHEN sol > 0 AND voc THEN 3.5 ELSE 0 END + 0.5 * CAST(voc AS INT)) END AS DOUBLE) AS score
FROM c, (VALUES ('batteries'), ('corrosion'), ('photovoltaics')) d(domain) WHERE bat + cat + cor + pit + eff + sol > 0 OR cap""")
def domain_scores(t: Tables):
    """Scores of three domains for texts with repeated, cited and focal terms."""
    return G.score_domains(_texts(t), _DOMAINS).select(F.col("doc").alias("doc_id"), "domain", "score")


@query(f"""WITH {_S}, c AS (SELECT o || '-' || n AS doc_id, CASE WHEN q % 2 = 0 THEN q % 7 ELSE 0 END AS bat, CASE WHEN q % 4 = 1 THEN n % 3 + 1 ELSE 0 END AS cor FROM l),
k AS (SELECT doc_id, 'cell' AS paper_type, CAST({_W('bat')} AS DOUBLE) AS score FROM c UNION ALL SELECT doc_id, 'study', CAST({_W('cor')} AS DOUBLE) FROM c UNION ALL SELECT doc_id, 'surface', CAST({_W('cor')} AS DOUBLE) FROM c)
SELECT doc_id, paper_type, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, paper_type DESC) AS INTEGER) AS rank FROM k WHERE score > 0 QUALIFY rank <= 2""")
def paper_type_ranks(t: Tables):
    """The two best paper types of each text; ties go to the last by name."""
    types = {"cell": ("battery",), "study": ("corrosion",), "surface": ("eis",)}
    return G.paper_types(_texts(t), types, 2)


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '''=1+' || c_custkey WHEN c_custkey % 5 = 2 THEN '-' || c_custkey WHEN c_custkey % 5 = 3 THEN 'a "b", c' ELSE '''@x' END AS cell, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def csv_round_trip(t: Tables):
    """A table written for spreadsheets and read back: blanks for nulls, cells that can't be taken for formulas, quotes kept."""
    spark = t.customer.sparkSession
    key = F.col("c_custkey")
    cell = F.when(key % 5 == 1, F.concat(F.lit("=1+"), key)).when(key % 5 == 2, F.concat(F.lit("-"), key)).when(key % 5 == 3, 'a "b", c').when(key % 5 == 4, "@x")
    folder = shared_folder(spark, "csv")
    sinks.write_csv(t.customer.select(key.alias("key"), cell.alias("cell"), F.col("c_nationkey").alias("nation")), folder)
    back = spark.read.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(folder)
    return back.select(F.col("key").cast("long").alias("key"), F.coalesce("cell", F.lit("")).alias("cell"), "nation")
