"""Queries of source bundles: a customer is a source, its orders are pages, tables and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bundles as B
from .registry import Tables, query


def _parts(t: Tables) -> dict:
    key, who = F.col("o_orderkey"), F.concat(F.lit("s"), "o_custkey").alias("source_id")
    enough = F.repeat(F.lit("word 12 "), 15)
    poor = F.repeat(F.lit(". "), 60)
    orders = t.orders
    first = orders.filter("o_orderkey % 7 > 0").select(who, key.alias("page"), F.when(key % 3 == 0, enough).when(key % 3 == 1, poor).alias("text"), F.lit("a").alias("parser"))
    second = orders.filter("o_orderkey % 5 > 0").select(who, key.alias("page"), F.when(key % 4 == 0, F.concat(enough, F.lit("b"))).otherwise(F.concat(enough, F.repeat(F.lit("�"), 20))).alias("text"), F.lit("b").alias("parser"))
    sources = t.customer.select(F.concat(F.lit("s"), "c_custkey").alias("source_id"), F.concat(F.lit("k"), "c_custkey").alias("checksum"))
    stale = F.when(key % 6 == 0, "old").otherwise(F.concat(F.lit("k"), "o_custkey")).alias("source_checksum")
    recognised = orders.filter("o_orderkey % 2 = 0").select(who, stale, key.alias("page"), F.concat(enough, F.lit("ocr")).alias("raw_text"), F.when(key % 10 > 0, "succeeded").otherwise("failed").alias("status"))
    return {"first": first, "second": second, "sources": sources, "recognised": recognised}


_P = """o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
ab AS (SELECT k, c, k % 7 > 0 AS has_a, k % 5 > 0 AS has_b, k % 7 > 0 AND k % 3 = 0 AS good_a, k % 5 > 0 AND k % 4 = 0 AS good_b, CASE WHEN k % 7 > 0 THEN CASE k % 3 WHEN 0 THEN 120 WHEN 1 THEN 120 ELSE 0 END ELSE 0 END AS la, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 4 = 0 THEN 121 ELSE 140 END ELSE 0 END AS lb FROM o WHERE k % 7 > 0 OR k % 5 > 0),
pg AS (SELECT *, NOT good_a AND (good_b OR lb > la) AS takes_b FROM ab),
ef AS (SELECT *, CASE WHEN takes_b THEN good_b ELSE good_a END AS good, NOT CASE WHEN takes_b THEN good_b ELSE good_a END AND k % 2 = 0 AND k % 6 > 0 AND k % 10 > 0 AS ocr FROM pg)"""


@query(f"""WITH {_P} SELECT 's' || c AS source_id, k AS page, CASE WHEN ocr THEN 'ocr' WHEN takes_b THEN 'b' WHEN has_a THEN 'a' END AS parser, CASE WHEN ocr THEN 'ocr_extracted' ELSE 'native_text' END AS origin, good OR ocr AS sufficient,
 CASE WHEN ocr THEN 123 WHEN takes_b THEN lb ELSE la END AS chars, CASE WHEN good OR ocr THEN '' WHEN takes_b THEN 'replacement_character_ratio_exceeded' WHEN la = 0 THEN 'normalized_text_below_minimum,alphanumeric_text_below_minimum' ELSE 'alphanumeric_text_below_minimum' END AS reasons FROM ef""")
def source_pages(t: Tables):
    """Each page's text from the first parser, the second or recognition, with what is wrong with it."""
    x = _parts(t)
    pages = B.effective_pages(B.native_pages(x["first"], x["second"]), x["recognised"], x["sources"])
    return pages.select("source_id", "page", "parser", "origin", "sufficient", F.char_length("text").alias("chars"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_P}, p AS (SELECT c, count(*) AS pages, count(*) FILTER (ocr) AS recognised, count(*) FILTER (NOT good AND NOT ocr) AS insufficient FROM ef GROUP BY 1),
b AS (SELECT c, count(*) FILTER (k % 3 = 0) AS tables, count(*) FILTER (k % 4 = 0) AS figures, count(*) FILTER (k % 2 = 0 AND k % 6 > 0) AS ocr_blocks, count(*) FILTER (k % 8 = 0) AS digitizations FROM o GROUP BY 1)
SELECT 's' || c_custkey AS source_id, coalesce(pages, 0) AS pages, coalesce(recognised, 0) AS recognised, coalesce(insufficient, 0) AS insufficient, coalesce(tables, 0) AS tables, coalesce(figures, 0) AS figures, coalesce(ocr_blocks, 0) AS ocr_blocks, coalesce(digitizations, 0) AS digitizations
FROM customer LEFT JOIN p ON p.c = c_custkey LEFT JOIN b ON b.c = c_custkey""")
def source_bundles(t: Tables):
    """What each source has: pages by origin, and objects of its sidecar by kind."""
    x = _parts(t)
    pages = B.effective_pages(B.native_pages(x["first"], x["second"]), x["recognised"], x["sources"])
    own = lambda m, name: t.orders.filter(F.col("o_orderkey") % m == 0).select(F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.col("o_orderkey").alias(name))
    objects = B.source_objects(own(3, "table_id"), own(4, "figure_id"), B.current(x["recognised"], x["sources"]), own(8, "digitization_id"))
    return B.bundle_summary(x["sources"], pages, objects)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), a AS (SELECT *, o % 4 AS k FROM l)
SELECT o || '-' || n AS request_id, CASE WHEN k IN (0, 1) AND hit THEN CAST(want AS INTEGER) END AS row, CASE WHEN k IN (0, 1) AND hit THEN 0 END AS col, CASE WHEN k IN (0, 1) AND hit THEN 'v' || want END AS text,
 CASE WHEN k = 2 THEN 'unknown_table' WHEN k = 3 THEN 'no_cell_named' WHEN NOT hit THEN 'unknown_cell' END AS reason FROM (SELECT a.*, n + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS want, EXISTS (FROM l WHERE l.o = a.o AND l.n = a.n + CASE WHEN a.n % 3 = 0 THEN 1 ELSE 0 END) AS hit FROM a)""")
def asked_cells(t: Tables):
    """Cells of sidecar tables by id or place, and why some are not found."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()
    o, n = F.col("o"), F.col("n")
    cells = lines.select(F.lit("s").alias("source_id"), o.cast("string").alias("table_id"), n.cast("int").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("c"), n).alias("cell_id"), F.concat(F.lit("v"), n).alias("text"))
    want = n + F.when(n % 3 == 0, 1).otherwise(0)
    asked = lines.select(F.concat("o", F.lit("-"), "n").alias("request_id"), F.lit("s").alias("source_id"), F.when(o % 4 == 2, "none").otherwise(o.cast("string")).alias("table_id"), F.when(o % 4 == 1, want.cast("int")).alias("row"), F.when(o % 4 == 1, 0).alias("col"), F.when(o % 4 == 0, F.concat(F.lit("c"), want)).alias("cell_id"))
    return B.asked_cells(asked, cells)
