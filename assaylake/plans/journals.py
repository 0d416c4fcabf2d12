"""Queries over hash-chained logs, ordered replay, versioned tables and merged answers: an order is a log, its lines the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import dispositions as D
from ..sources.settled import shared_folder
from ..sources.versions import VersionedTables, append_once
from .registry import Tables, query


def _logs(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("log_id"), F.col("l_linenumber").alias("n")).agg(F.round(F.min("l_quantity")).cast("long").alias("qty"))
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("n"))
    return lines.select("log_id", place.alias("ordinal"), F.concat(F.lit("q"), "qty").alias("payload"))


def _spoilt(logs):
    """The chained logs with changed, missing, swapped and doubled events."""
    k, n = F.col("log_id") % 7, F.col("ordinal")
    rows = C.chained(logs).filter(~((k == 1) & (n == 2)) & ~((k == 3) & (n == 3)))
    rows = rows.withColumn("payload", F.when((k == 0) & (n == 2), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    rows = rows.withColumn("ordinal", F.when((k == 2) & n.isin(1, 2), 3 - n).otherwise(n))
    return rows.unionByName(rows.filter((k == 4) & (n == 1)))


_C = r"""
l AS (SELECT l_orderkey AS log_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ordinal, 'q' || CAST(round(min(l_quantity)) AS BIGINT) AS payload FROM lineitem GROUP BY l_orderkey, l_linenumber),
c(log_id, ordinal, payload, prev_hash, hash) AS (SELECT log_id, ordinal, payload, '', sha256(chr(31) || payload) FROM l WHERE ordinal = 1
  UNION ALL SELECT l.log_id, l.ordinal, l.payload, c.hash, sha256(c.hash || chr(31) || l.payload) FROM c JOIN l ON l.log_id = c.log_id AND l.ordinal = c.ordinal + 1),
s0 AS (SELECT log_id, CASE WHEN log_id % 7 = 2 AND ordinal <= 2 THEN 3 - ordinal ELSE ordinal END AS ordinal, CASE WHEN log_id % 7 = 0 AND ordinal = 2 THEN payload || '!' ELSE payload END AS payload, prev_hash, hash FROM c
  WHERE NOT (log_id % 7 = 1 AND ordinal = 2) AND NOT (log_id % 7 = 3 AND ordinal = 3)),
s AS (FROM s0 UNION ALL FROM s0 WHERE log_id % 7 = 4 AND ordinal = 1)
"""


@query(f"""WITH RECURSIVE {_C}, w AS (SELECT *, lag(ordinal) OVER v AS po, lag(hash) OVER v AS ph, count(*) OVER (PARTITION BY log_id, ordinal) AS same FROM s WINDOW v AS (PARTITION BY log_id ORDER BY ordinal)),
b AS (SELECT log_id, ordinal, CASE WHEN same > 1 THEN 'place_taken_twice' WHEN hash <> sha256(prev_hash || chr(31) || payload) THEN 'tampered' WHEN ordinal > 1 AND (po IS NULL OR po < ordinal - 1) THEN 'predecessor_missing'
    WHEN ordinal > 1 AND ph <> prev_hash OR ordinal = 1 AND prev_hash <> '' THEN 'not_linked' END AS reason FROM w),
x AS (SELECT DISTINCT log_id, ordinal, reason FROM b WHERE reason IS NOT NULL UNION ALL SELECT log_id, ordinal, 'tail_missing' FROM (SELECT * FROM c QUALIFY ordinal = max(ordinal) OVER (PARTITION BY log_id)) e WHERE NOT EXISTS (FROM s WHERE s.log_id = e.log_id AND s.ordinal = e.ordinal AND s.hash = e.hash)),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY ordinal, reason) = 1)
SELECT g.log_id, g.events, coalesce(f.ordinal - 1, g.last) AS verified, f.ordinal AS broken_at, f.reason FROM (SELECT log_id, count(*) AS events, max(ordinal) AS last FROM s GROUP BY 1) g LEFT JOIN f USING (log_id)""")
def verified_logs(t: Tables):
    """How far each hash-chained log can be trusted, with changed, missing, swapped, doubled and cut-off events found."""
    logs = _logs(t)
    tails = C.chained(logs).groupBy("log_id").agg(F.max("ordinal").alias("ordinal"), F.max_by("hash", "ordinal").alias("hash"))
    return C.verified_prefix(_spoilt(logs), tails).select("log_id", "events", F.col("verified").cast("long").alias("verified"), F.col("broken_at").cast("long").alias("broken_at"), "reason")


@query(f"""WITH RECURSIVE {_C}, a AS (SELECT log_id, ordinal, min(hash) AS h FROM s WHERE log_id % 7 <> 4 GROUP BY 1, 2), b AS (SELECT log_id, ordinal, hash AS h FROM c WHERE log_id % 7 <> 4)
SELECT coalesce(a.log_id, b.log_id) AS log_id, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'added' ELSE 'changed' END AS difference FROM a FULL JOIN b USING (log_id, ordinal) WHERE a.h IS DISTINCT FROM b.h""")
def log_differences(t: Tables):
    """Where a copy of the logs differs from the original, found by segments first."""
    logs = _logs(t)
    own, other = _spoilt(logs).filter("log_id % 7 <> 4"), C.chained(logs).filter("log_id % 7 <> 4")
    return C.log_differences(own, other, 2).select("log_id", F.col("ordinal").cast("long").alias("ordinal"), "difference")


@query(r"""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), att AS (SELECT o, n, CASE WHEN (o + n) % 5 = 0 THEN 'CONFIRMED_NO_RESULT' WHEN (o + n) % 17 = 0 THEN 'UNCERTAIN' ELSE 'RAW_PERSISTED' END AS status, CASE WHEN (o + n) % 23 > 0 THEN 'raw-' || o || '-' || n END AS raw_ref FROM l),
st AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) AS p FROM att WHERE status <> 'CONFIRMED_NO_RESULT'),
rq AS (SELECT o, n AS position, n + (o + n) // 5 - o // 5 AS guess FROM l),
want AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY n) AS position, n FROM l),
k AS (SELECT w.o, w.position, CASE WHEN st.o IS NULL THEN 'no_durable_response' WHEN (w.o * 3 + w.position) % 19 = 0 THEN 'request_differs' WHEN st.status <> 'RAW_PERSISTED' OR st.raw_ref IS NULL THEN 'not_replayable' END AS why, st.raw_ref FROM want w LEFT JOIN st ON st.o = w.o AND st.p = w.position),
z AS (SELECT o, min(position) AS stop FROM k WHERE why IS NOT NULL GROUP BY 1)
SELECT k.o AS log_id, k.position, stop IS NULL OR position < stop AS replayed, CASE WHEN position = stop THEN why WHEN position > stop THEN 'not_reached' END AS reason, CASE WHEN stop IS NULL OR position < stop THEN raw_ref END AS raw_ref FROM k LEFT JOIN z USING (o)""")
def replayed_requests(t: Tables):
    """Stored outcomes replayed in order, up to the first request that differs or cannot be replayed."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()
    mix = F.col("o") + F.col("n")
    status = F.when(mix % 5 == 0, "CONFIRMED_NO_RESULT").when(mix % 17 == 0, "UNCERTAIN").otherwise("RAW_PERSISTED")
    attempts = lines.select(F.col("o").alias("log_id"), F.col("n").alias("ordinal"), F.lit("m").alias("model"), F.lit("primary").alias("phase"), status.alias("status"), F.when(mix % 23 > 0, F.concat(F.lit("raw-"), "o", F.lit("-"), "n")).alias("raw_ref"))
    stored = C.ranked(attempts.filter("status <> 'CONFIRMED_NO_RESULT'"), "log_id", "ordinal", "p").select("log_id", "ordinal", F.concat(F.lit("h"), "p").alias("request_hash"))
    attempts = attempts.join(stored, ["log_id", "ordinal"], "left")
    place = F.row_number().over(Window.partitionBy("o").orderBy("n")).cast("long")
    asked = lines.select(F.col("o").alias("log_id"), place.alias("position"))
    said = F.when((F.col("log_id") * 3 + F.col("position")) % 19 == 0, "other").otherwise(F.concat(F.lit("h"), "position"))
    requests = asked.select("log_id", "position", F.lit("m").alias("model"), F.lit("primary").alias("phase"), said.alias("request_hash"))
    return C.replay(requests, attempts).select("log_id", "position", "replayed", "reason", "raw_ref")


@query("""WITH o AS (SELECT o_orderkey % 3 AS b, o_custkey AS id, o_orderkey AS k, o_orderstatus AS v FROM orders),
d AS (SELECT DISTINCT b, id, v FROM o), u AS (SELECT b, id, count(*) AS n, min(v) AS v FROM d GROUP BY 1, 2),
s0 AS (SELECT id, v FROM u WHERE b = 0 AND n = 1),
s1 AS (FROM s0 UNION ALL SELECT id, v FROM u WHERE b = 1 AND n = 1 AND id NOT IN (SELECT id FROM s0)),
s2 AS (FROM s1 UNION ALL SELECT id, v FROM u WHERE b = 2 AND n = 1 AND id NOT IN (SELECT id FROM s1)),
c AS (SELECT 0 AS b, id FROM u WHERE b = 0 AND n > 1 UNION ALL SELECT DISTINCT 1, id FROM d LEFT JOIN s0 USING (id) JOIN u USING (b, id) WHERE b = 1 AND (s0.v <> d.v OR s0.v IS NULL AND n > 1) UNION ALL SELECT DISTINCT 2, id FROM d LEFT JOIN s1 USING (id) JOIN u USING (b, id) WHERE b = 2 AND (s1.v <> d.v OR s1.v IS NULL AND n > 1))
SELECT 'row' AS part, id, v, 1 AS n FROM s2 UNION ALL SELECT 'conflict', id, NULL, CAST(count(*) AS INTEGER) FROM c GROUP BY id""")
def versioned_rows(t: Tables):
    """Three batches appended as versions, the second one twice: each row once, each conflict once for each batch."""
    spark = t.orders.sparkSession
    tables = VersionedTables(spark, shared_folder(spark, "versions"))
    orders = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("v"), (F.col("o_orderkey") % 3).alias("b"))
    for number in (0, 1, 1, 2):
        append_once(tables, orders.filter(F.col("b") == number).drop("b"), "id", "orders", number)
    rows = tables.read("rows", "id long, v string").select(F.lit("row").alias("part"), "id", "v", F.lit(1).alias("n"))
    conflicts = tables.read("conflicts", "id long").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return rows.unionByName(conflicts.select(F.lit("conflict").alias("part"), "id", F.lit(None).cast("string").alias("v"), "n"))


_DISPOSED = r"""
l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) % 4 AS p, min(l_suppkey) % 3 AS s, CAST(round(min(l_quantity)) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, 'c' || CASE WHEN qty % 11 = 0 THEN n - 1 ELSE n END AS cand, qty % 7 = 0 AS no, qty % 5 <> 0 AS proven, CASE WHEN qty % 13 > 0 THEN 's' || s END AS ident FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY o, cand ORDER BY n) AS turn, EXISTS (FROM l WHERE l.o = a.o AND 'c' || l.n = cand AND l.qty % 19 > 0) AS there FROM a),
j AS (SELECT *, CASE WHEN NOT there OR turn > 1 THEN 'unknown_or_duplicate_candidate_id' WHEN no THEN 'not relevant' END AS early FROM k),
f(o, n, held, accepted) AS (
  SELECT o, 0, CASE WHEN o % 3 = 0 THEN MAP {'p1': 's0'} ELSE MAP {} END, false FROM (SELECT DISTINCT o FROM l)
  UNION ALL SELECT f.o, x.n, CASE WHEN x.early IS NULL AND x.proven AND (x.ident IS NULL OR coalesce(f.held['p' || x.p], x.ident) = x.ident) AND x.ident IS NOT NULL THEN map_concat(f.held, MAP {'p' || x.p: x.ident}) ELSE f.held END,
    x.early IS NULL AND x.proven AND (x.ident IS NULL OR coalesce(f.held['p' || x.p], x.ident) = x.ident)
  FROM f JOIN j x ON x.o = f.o AND x.n = (SELECT min(n) FROM j y WHERE y.o = f.o AND y.n > f.n))
"""


@query(f"WITH RECURSIVE {_DISPOSED} SELECT f.o AS doc_id, f.n AS seq, cand AS candidate_id, accepted, coalesce(early, CASE WHEN NOT accepted THEN 'candidate_evidence_or_identity_mismatch' END) AS reason FROM f JOIN j ON j.o = f.o AND j.n = f.n")
def merged_answers(t: Tables):
    """Answers about candidates, each accepted as a whole or refused, in the order of their documents."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg((F.min("l_partkey") % 4).alias("p"), (F.min("l_suppkey") % 3).alias("s"), F.round(F.min("l_quantity")).cast("long").alias("qty"))
    qty = F.col("qty")
    known = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("p1").alias("local_id"), F.lit("s0").alias("identity"))
    candidates = lines.filter(qty % 19 > 0).select("doc_id", F.concat(F.lit("c"), "seq").alias("candidate_id"), F.lit("The value was 5 here").alias("snippet"))
    answers = lines.select("doc_id", "seq", F.concat(F.lit("c"), F.when(qty % 11 == 0, F.col("seq") - 1).otherwise(F.col("seq"))).alias("candidate_id"), F.when(qty % 7 == 0, "rejected").otherwise("added").alias("status"), F.lit("not relevant").alias("reason"))
    additions = lines.select("doc_id", "seq", F.concat(F.lit("p"), "p").alias("local_id"), F.when(qty % 13 > 0, F.concat(F.lit("s"), "s")).alias("identity"), F.when(qty % 5 > 0, "value was 5").otherwise("value was 6").alias("snippet"))
    return D.merge_dispositions(known, candidates, answers, additions)[1]
