"""Analytic summaries, chart eligibility, scoring, tables and event journals over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import analytic as A
from ..operators import frames as O
from ..operators import journal as J
from ..operators import scoring as S
from .registry import Tables, query
from .relational import OUTPUTS, total


@query("""
SELECT field, count(v) AS observations, count(DISTINCT v) AS unique_values, count(*) - count(v) AS missing FROM (
 SELECT unnest(['size','price','quantity']) AS field, unnest([CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END, p_retailprice, CASE WHEN l_quantity > 3 THEN l_quantity END]) AS v
 FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def numeric_dimension_summary(t: Tables):
    """Observed, distinct and missing values of each numeric dimension."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    values = {"size": F.when(F.col("p_size") > 5, F.col("p_size").cast("double")), "price": F.col("p_retailprice"), "quantity": F.when(F.col("l_quantity") > 3, F.col("l_quantity"))}
    return A.dimension_summary(rows.select(*(v.alias(k) for k, v in values.items())), list(values))


@query("""
SELECT count(*) AS records, count_if(x IS NOT NULL AND y IS NOT NULL) AS joint_xy, count(xyz) AS joint_xyz, count(DISTINCT CASE WHEN xyz = 1 THEN x END) AS unique_x,
 count(DISTINCT CASE WHEN xyz = 1 THEN y END) AS unique_y, count(DISTINCT CASE WHEN xyz = 1 THEN (x, y) END) AS unique_coordinates,
 count(xyz) - count(DISTINCT CASE WHEN xyz = 1 THEN (x, y) END) AS duplicate_coordinates
FROM (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL THEN 1 END AS xyz FROM
 (SELECT CASE WHEN p_size > 10 THEN p_size END AS x, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS y, l_quantity AS z FROM lineitem JOIN part ON l_partkey = p_partkey))""")
def surface_coverage(t: Tables):
    """Joint coverage of three dimensions."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.when(F.col("p_size") > 10, F.col("p_size")).alias("x"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("y"), F.col("l_quantity").alias("z"))
    return A.surface_coverage(rows, "x", "y", "z").drop("complete_rectangular_grid")


@query("""
SELECT l_linenumber AS y, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS "A", CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS "N",
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS "R" FROM lineitem GROUP BY 1""")
def observed_grid(t: Tables):
    """A grid of counts: one coordinate down, the other across."""
    return t.lineitem.groupBy(F.col("l_linenumber").alias("y")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)


@query("""
SELECT l_returnflag AS chart, l_linestatus AS part, CASE WHEN count(*) < 1 THEN 'no_records' WHEN count(DISTINCT l_linenumber) > 7 THEN 'incompatible_cross_domain_records'
 WHEN count(CASE WHEN l_quantity > 49 THEN 1 END) = 0 THEN 'missing_numeric_axes' WHEN count(DISTINCT CASE WHEN l_tax > 0.07 THEN l_linenumber END) > 6 THEN 'incompatible_value_units'
 WHEN count(DISTINCT l_suppkey) < 2 THEN 'insufficient_numeric_x_variation' ELSE 'eligible' END AS reason FROM lineitem GROUP BY 1, 2""")
def chart_eligibility_reasons(t: Tables):
    """The first reason, in order, why a chart can't be drawn."""
    n = F.count(F.lit(1))
    rules = [
        (n < 1, "no_records"), (F.countDistinct("l_linenumber") > 7, "incompatible_cross_domain_records"), (F.count(F.when(F.col("l_quantity") > 49, 1)) == 0, "missing_numeric_axes"),
        (F.countDistinct(F.when(F.col("l_tax") > 0.07, F.col("l_linenumber"))) > 6, "incompatible_value_units"), (F.countDistinct("l_suppkey") < 2, "insufficient_numeric_x_variation"),
    ]
    return t.lineitem.groupBy(F.col("l_returnflag").alias("chart"), F.col("l_linestatus").alias("part")).agg(O.ladder(rules, "eligible").alias("reason"))


@query("""
SELECT s_nationkey AS sample, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS "A", round(avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), 6) AS "N", round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS "R"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def selectivity_pivot_mean(t: Tables):
    """Mean ratio of each sample and pair as a matrix."""
    rows = t.lineitem.select("l_suppkey", "l_returnflag", "l_discount").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("sample")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_discount"), 6))


@query("""
SELECT l_partkey AS grp, count(*) AS n, count(DISTINCT l_suppkey) AS temps, count(DISTINCT l_linenumber) AS concs FROM lineitem GROUP BY 1
HAVING count(*) >= 4 AND count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_linenumber) >= 2""")
def contour_groups_having(t: Tables):
    """Groups dense enough for a contour."""
    got = t.lineitem.groupBy(F.col("l_partkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("temps"), F.countDistinct("l_linenumber").alias("concs"))
    return got.filter("n >= 4 and temps >= 2 and concs >= 2")


@query("""
SELECT s_suppkey, metric, CASE WHEN hi = lo THEN 1.0 ELSE round((v - lo) / (hi - lo), 6) END AS scaled FROM (
 SELECT *, min(v) OVER (PARTITION BY metric) AS lo, max(v) OVER (PARTITION BY metric) AS hi FROM (
  SELECT s_suppkey, unnest(['balance','nation','one']) AS metric, unnest([s_acctbal, CAST(s_nationkey AS DOUBLE), 1.0]) AS v FROM supplier))""")
def radar_minmax(t: Tables):
    """Each metric scaled to its own range; a constant one is 1."""
    rows = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"), F.lit(1.0).alias("one"))
    rows = rows.unpivot(["s_suppkey"], ["balance", "nation", "one"], "metric", "v")
    return A.minmax(rows, "metric", "v").select("s_suppkey", "metric", F.round("scaled", 6).alias("scaled"))


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) || ' mm' AS raw, CAST(p_size AS DOUBLE) AS value, 'mm' AS unit,
 CASE WHEN p_size % 3 = 0 THEN 'approx' WHEN p_size % 3 = 1 THEN 'lower_bound' ELSE 'exact' END AS qualifier FROM part""")
def number_unit_parse(t: Tables):
    """Compact quantities as value, unit and qualifier."""
    mark = F.when(F.col("p_size") % 3 == 0, "~").when(F.col("p_size") % 3 == 1, ">").otherwise("")
    rows = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" mm")).alias("raw"), mark.alias("mark"))
    q = N.parse_quantity(F.concat("mark", "raw"))
    return rows.select("p_partkey", "raw", q["value"].alias("value"), q["unit"].alias("unit"), q["qualifier"].alias("qualifier"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) * CAST(0.001 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) * CAST(60 AS DOUBLE) END AS normalized, 's' AS unit FROM part""")
def unit_conversion(t: Tables):
    """Time quantities in seconds."""
    unit = F.when(F.col("p_size") % 2 == 0, "ms").otherwise("min")
    value, to = N.sensor_units(F.col("p_size").cast("double"), unit)
    return t.part.select("p_partkey", value.alias("normalized"), to.alias("unit"))


@query("""
SELECT doc_id, length(text) >= 200 AND regexp_matches(text, '[A-Za-z]') AS sufficient,
 CASE WHEN length(text) < 200 THEN 'too_short' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no_letters' END AS reason FROM documents""")
def text_sufficiency_gate(t: Tables):
    """Whether a page has text enough, and why not."""
    reason = O.ladder([(F.length("text") < 200, "too_short"), (~F.col("text").rlike("[A-Za-z]"), "no_letters")])
    return t.documents.select("doc_id", reason.isNull().alias("sufficient"), reason.alias("reason"))


#: Terms of a small lexical router.
TERMS = (("en", "there"), ("en", "inger"), ("fr", "treau"), ("fr", "ement"), ("de", "schen"), ("de", "heit "), ("es", "aquel"), ("es", "mente"))


def _router_sql(tail: str) -> str:
    count = lambda t: f"len(regexp_extract_all(lower(text), '{chr(92) + 'b' + t + chr(92) + 'b' if len(t) <= 4 else t}'))"
    score = lambda d: " + ".join(f"CASE WHEN {count(t)} > 0 THEN 1 + 0.25 * least({count(t)} - 1, 4) ELSE 0 END" for k, t in TERMS if k == d)
    each = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, CAST({score(d)} AS DOUBLE) AS score FROM documents" for d in sorted({k for k, _ in TERMS}))
    return f"WITH s AS ({each}) {tail}"


@query(_router_sql("SELECT doc_id, domain, score FROM s"))
def lexical_router_scores(t: Tables):
    """Weighted term counts of each document and domain."""
    low = F.lower("text")
    score = lambda d: sum((X.term_score(X.term_count(low, term)) for k, term in TERMS if k == d), F.lit(0.0))
    domains = sorted({k for k, _ in TERMS})
    rows = t.documents.select("doc_id", *(score(d).alias(d) for d in domains))
    return rows.unpivot(["doc_id"], domains, "domain", "score")


@query(_router_sql("SELECT doc_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS r FROM s) WHERE r = 1"))
def router_argmax(t: Tables):
    """The best domain of each document; ties go to the first by name."""
    rows = lexical_router_scores(t)
    best = F.min_by(F.struct("domain", "score"), F.struct(-F.col("score"), "domain"))
    return rows.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.domain", "b.score")


@query("""
SELECT doc_id, term, n, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term DESC) AS r FROM (
 SELECT doc_id, unnest(['the','ing','de','und','la']) AS term, unnest([len(string_split(lower(text), 'the')) - 1, len(string_split(lower(text), 'ing')) - 1, len(string_split(lower(text), 'de')) - 1, len(string_split(lower(text), 'und')) - 1, len(string_split(lower(text), 'la')) - 1]) AS n FROM documents)) WHERE r <= 3""")
def paper_type_topk(t: Tables):
    """The three most frequent terms of each document; ties by name, last first."""
    low = F.lower("text")
    terms = ("the", "ing", "de", "und", "la")
    counts = F.array(*(F.struct(F.lit(x).alias("term"), F.regexp_count(low, F.lit(x)).cast("long").alias("n")) for x in terms))
    order = F.reverse(F.array_sort(F.transform(counts, lambda c: F.struct(c["n"].alias("n"), c["term"].alias("term")))))
    top = t.documents.select("doc_id", F.posexplode(F.slice(order, 1, 3)).alias("p", "c"))
    return top.select("doc_id", "c.term", "c.n", (F.col("p") + 1).cast("long").alias("r"))


@query("SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE length(b.text) > 20")
def evidence_verbatim_join(t: Tables):
    """Snippets found verbatim: candidates share a rare word window, then containment decides."""
    from ..operators.evidence import contained

    return contained(t.benchmark.filter(F.length("text") > 20), t.documents, "item_id", "doc_id").distinct()


@query("""
SELECT item_id, count(DISTINCT doc_id) AS matches, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS doc_id
FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE length(b.text) > 20 GROUP BY 1""")
def unique_page_match(t: Tables):
    """The page of a snippet if exactly one holds it."""
    return O.only_match(evidence_verbatim_join(t), ["item_id"], "doc_id", "doc_id")


@query("""
SELECT a.conv_id, a.turn, CASE WHEN length(a.text) > 0 AND (contains(lower(a.text), lower(b.text)) OR contains(lower(b.text), lower(a.text))) THEN true ELSE false END AS contains_other
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def snippet_containment(t: Tables):
    """Whether a text holds the next one or is held by it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a, b = F.lower("text"), F.lower("next")
    rows = t.conversations.select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"), F.lead("turn").over(w).alias("t2")).filter("t2 = turn + 1")
    return rows.select("conv_id", "turn", F.coalesce((F.length("text") > 0) & (F.contains(a, b) | F.contains(b, a)), F.lit(False)).alias("contains_other"))


@query("""
SELECT doc_id, regexp_matches(lower(text), 'the|und|que') AND regexp_matches(text, '[0-9]') AS guarded, regexp_matches(text, '[0-9]') AS numeric FROM documents""")
def review_guard_two_signal(t: Tables):
    """Two signals together, never one alone."""
    number = F.col("text").rlike("[0-9]")
    return t.documents.select("doc_id", (F.lower("text").rlike("the|und|que") & number).alias("guarded"), number.alias("numeric"))


_GOLD = """g AS (SELECT l_orderkey AS case_id, l_linenumber AS k, l_partkey AS metric, l_quantity AS value, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS unit FROM lineitem WHERE l_linenumber <= 2),
o AS (SELECT l_orderkey AS case_id, l_partkey AS metric, l_quantity AS value, l_returnflag AS unit, l_tax AS tracked FROM lineitem WHERE l_tax < 0.06)"""


@query(f"""
WITH {_GOLD}, m AS (SELECT g.case_id, g.k, max(CASE WHEN o.metric IS NOT NULL THEN 1 ELSE 0 END) AS property, max(CASE WHEN o.metric IS NOT NULL AND (g.unit IS NULL OR g.unit = o.unit) THEN 1 ELSE 0 END) AS unit,
 max(CASE WHEN o.metric IS NOT NULL AND (g.unit IS NULL OR g.unit = o.unit) AND abs(g.value - o.value) <= 1e-9 THEN 1 ELSE 0 END) AS value,
 max(CASE WHEN o.metric IS NOT NULL AND (g.unit IS NULL OR g.unit = o.unit) AND abs(g.value - o.value) <= 1e-9 AND o.tracked > 0.01 THEN 1 ELSE 0 END) AS tracked
 FROM g LEFT JOIN o ON g.case_id = o.case_id AND g.metric = o.metric GROUP BY 1, 2)
SELECT count(*) AS expected, CAST(sum(property) AS BIGINT) AS property, CAST(sum(unit) AS BIGINT) AS unit, CAST(sum(value) AS BIGINT) AS value, CAST(sum(tracked) AS BIGINT) AS tracked FROM m""")
def gold_cascade_funnel(t: Tables):
    """How many gold assertions survive each step of a cascade of ever stricter matches."""
    gold = t.lineitem.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("metric"), F.col("l_quantity").alias("value"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("unit"))
    seen = t.lineitem.filter("l_tax < 0.06").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("metric"), F.col("l_quantity").alias("o_value"), F.col("l_returnflag").alias("o_unit"), F.col("l_tax").alias("o_tracked"))
    steps = {"property": F.lit(True), "unit": O.wildcard("unit", "o_unit"), "value": O.close(F.col("value"), F.col("o_value"), 0.0, 1e-9), "tracked": F.col("o_tracked") > 0.01}
    return S.cascade(gold, seen, ["case_id", "k"], ["case_id", "metric"], steps)


@query("""
SELECT l_orderkey, arg_min(l_linenumber, (-rk * 100 + l_linenumber)) AS best FROM (SELECT *, CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.04 AS INT) + CAST(l_quantity > 25 AS INT) AS rk FROM lineitem) GROUP BY 1""")
def best_candidate_rank(t: Tables):
    """The candidate that meets most criteria; the first of equals."""
    rank = sum((c.cast("int") for c in (F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 25)), F.lit(0))
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(-rank, F.col("l_linenumber"))).alias("best"))


@query("""
SELECT count_if(p AND g) AS true_positive, count_if(p AND NOT g) AS false_positive, count_if(NOT p AND g) AS false_negative, count_if(NOT p AND NOT g) AS true_negative,
 coalesce(round(CAST(count_if(p AND g) AS DOUBLE) / nullif(count_if(p), 0), 3), 0.0) AS "precision" FROM (SELECT quality = 1 AS g, length(text) > 300 AS p FROM labels JOIN documents USING (doc_id))""")
def confusion_counts_precision(t: Tables):
    """Decisions against gold."""
    rows = t.labels.join(t.documents.select("doc_id", F.length("text").alias("n")), "doc_id")
    return S.confusion(rows, F.col("n") > 300, F.col("quality") == 1)


@query("""
SELECT k, v, sum(s) AS difference FROM (SELECT l_returnflag AS k, l_linenumber AS v, 1 AS s FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_returnflag, l_linenumber, -1 FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1, 2 HAVING sum(s) <> 0""")
def multiset_equality(t: Tables):
    """Where two multisets differ, and by how many."""
    part = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("v"))
    return O.multiset_difference(part("F"), part("O"))


@query("""
SELECT l_orderkey, round(max(abs(p.v * q.v - r.v) / nullif(abs(r.v), 0)), 9) AS worst FROM
 (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem) p JOIN (SELECT l_orderkey, l_linenumber, l_tax AS v FROM lineitem) q USING (l_orderkey, l_linenumber)
 JOIN (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem) r USING (l_orderkey, l_linenumber) GROUP BY 1""")
def derived_value_relative_error(t: Tables):
    """A derived value recomputed from aligned series, and its largest relative error."""
    series = lambda c, n: t.lineitem.select("l_orderkey", "l_linenumber", F.col(c).alias(n))
    rows = series("l_quantity", "p").join(series("l_tax", "q"), ["l_orderkey", "l_linenumber"]).join(series("l_extendedprice", "r"), ["l_orderkey", "l_linenumber"])
    error = F.abs(F.col("p") * F.col("q") - F.col("r")) / F.nullif(F.abs("r"), F.lit(0.0))
    return rows.groupBy("l_orderkey").agg(F.round(F.max(error), 9).alias("worst"))


@query("""
SELECT l_orderkey, count(*) AS n, sha256(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY 1""")
def series_digest(t: Tables):
    """Length and digest of an ordered series."""
    point = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    got = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), O.ordered_list(point, F.struct("l_linenumber", "l_partkey")).alias("s"))
    return got.select("l_orderkey", "n", F.sha2(F.array_join("s", ","), 256).alias("digest"))


@query("""
WITH e AS (SELECT s_suppkey, s_acctbal AS low, lead(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS high FROM supplier)
SELECT c_custkey, s_suppkey AS bin FROM customer JOIN e ON c_acctbal >= low AND (c_acctbal < high OR high IS NULL)""")
def interval_column_binning(t: Tables):
    """Points into the interval that holds them: an as-of lookup on a union, ordered within value ranges."""
    from ..operators.tables import asof

    edges = t.supplier.select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("bin"))
    points = t.customer.select(F.col("c_acctbal").alias("x"), "c_custkey")
    return asof(points, edges, "x", "bin", ["c_custkey"]).filter("bin is not null").select("c_custkey", "bin")


@query("""
SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A','N','R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def relational_division(t: Tables):
    """Cells for which every asserted condition resolves."""
    wanted = t.spark.createDataFrame([("A",), ("N",), ("R",)], "l_returnflag string")
    rows = t.lineitem.select("l_orderkey", "l_returnflag").join(F.broadcast(wanted), "l_returnflag")
    return rows.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n")).filter("n = 3").select("l_orderkey")


@query("""
SELECT l_partkey, bool_and(NOT list_has_any(ins, outs)) AS directional, count(*) AS steps FROM (SELECT l_partkey, l_suppkey, list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS i, list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R') AS o,
 coalesce(i, []) AS ins, coalesce(o, []) AS outs FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def lineage_direction_constraint(t: Tables):
    """No step may have the same entity as input and output."""
    side = lambda c: F.collect_set(F.when(c, F.col("l_linenumber")))
    steps = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(side(F.col("l_returnflag") == "R").alias("ins"), side(F.col("l_returnflag") != "R").alias("outs"))
    return steps.groupBy("l_partkey").agg(F.every(~F.arrays_overlap("ins", "outs")).alias("directional"), F.count(F.lit(1)).alias("steps"))


@query("""
SELECT user_id, count(*) AS versions, arg_max(event_type, (ts, event_id)) AS state, CAST(count_if(prev IS NOT NULL AND prev = event_type) AS BIGINT) AS repeats
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1""")
def job_fold_current_state(t: Tables):
    """A journal folded to each key's current state."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("user_id", "event_type", "ts", "event_id", F.lag("event_type").over(w).alias("prev"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("prev") == F.col("event_type")).alias("repeats"))


@query("""
SELECT event_id, user_id, prev, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NOT NULL AND (prev || '>' || event_type) NOT IN ('view>click','click>cart','cart>purchase','view>view','login>view','purchase>login','view>cart')""")
def illegal_transitions(t: Tables):
    """Events whose step from the previous state is not allowed, kept aside instead of raised."""
    allowed = {"view": ("click", "view", "cart"), "click": ("cart",), "cart": ("purchase",), "login": ("view",), "purchase": ("login",)}
    return J.illegal(t.events, "user_id", ["ts", "event_id"], "event_type", allowed).select("event_id", "user_id", "prev", "event_type")


@query("""
SELECT user_id, event_id AS intent_id, nxt AS outcome_id, CASE WHEN nxt_type = 'purchase' THEN 'RESULT_PERSISTED' ELSE 'RECONCILIATION_REQUIRED' END AS status FROM (
 SELECT *, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS nxt_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click'""")
def intent_outcome_pairing(t: Tables):
    """Each recorded intent with the outcome that follows it; others need reconciling."""
    return J.pair_intents(t.events, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "click", "event_type", "purchase")


@query("""
SELECT event_id, user_id, day, CASE WHEN u <= 3 AND g <= 30 THEN true ELSE false END AS granted FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day,
 row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS g FROM events)""")
def daily_quota_positions(t: Tables):
    """Requests within a user's and the day's quota, by position."""
    day, order = F.to_date("ts").alias("day"), ["ts", "event_id"]
    rows = t.events.select("event_id", "user_id", "ts", day)
    place = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(*order))
    # A day's first 30 are among the first 30 of each of its parts, so no task sees a whole day.
    part = F.pmod(F.xxhash64("event_id"), F.lit(64))
    first = rows.withColumn("part", part).withColumn("g", place("day", "part")).filter("g <= 30").withColumn("g", place("day")).filter("g <= 30")
    first = first.select("event_id", F.lit(True).alias("early"))
    out = rows.withColumn("u", place("day", "user_id")).join(first, "event_id", "left")
    return out.select("event_id", "user_id", "day", ((F.col("u") <= 3) & F.coalesce("early", F.lit(False))).alias("granted"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day FROM events), u AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, event_id) AS u FROM e),
g AS (SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS g FROM u WHERE u <= 3)
SELECT e.event_id, e.user_id, e.day, coalesce(g.g <= 30, false) AS granted FROM e LEFT JOIN g USING (event_id)""")
def quota_reservation(t: Tables):
    """Requests within a user's and the day's quota; a refused request takes no place."""
    rows = t.events.select(F.lit("extract").alias("action"), F.col("user_id").alias("owner_key"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    return J.reserve_quota(rows, per_user=3, per_day=30).select(F.col("request_id").alias("event_id"), F.col("owner_key").alias("user_id"), "day", "granted")


@query("""
SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(max(turn) + 1 - count(DISTINCT turn) AS BIGINT) AS gaps FROM conversations GROUP BY 1""")
def conversation_log_fold(t: Tables):
    """A log folded to one row for each key, with its gaps."""
    return t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), (F.max("turn") + 1 - F.countDistinct("turn")).alias("gaps")
    )


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_asof(t: Tables):
    """The heading that a position falls under."""
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("heading"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "turn", F.last("heading", ignorenulls=True).over(w).alias("section"))


@query("""
SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(CAST(prev IS NULL OR prev <> event_type AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
 SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, run""")
def gap_terminated_runs(t: Tables):
    """Runs of equal rows, numbered by a running sum of starts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("o"), (F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).alias("same"))
    runs = O.islands(rows, ["user_id"], "o", ~F.col("same"), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).drop("run")


@query("""
SELECT l_orderkey, l_linenumber, arg_min(c, (abs(c - l_linenumber) * 100 + c)) AS nearest FROM lineitem JOIN (SELECT l_orderkey AS o, l_linenumber AS c FROM lineitem WHERE l_returnflag = 'R') ON o = l_orderkey GROUP BY 1, 2""")
def nearest_caption_range(t: Tables):
    """The nearest caption on the same page."""
    captions = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("c"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber").join(captions, "l_orderkey")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("c", F.struct(F.abs(F.col("c") - F.col("l_linenumber")), "c")).alias("nearest"))


@query("""
SELECT l_partkey AS x, median(l_quantity) AS y FROM lineitem GROUP BY 1""")
def median_trace(t: Tables):
    """The median of each column of a trace."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("x")).agg(F.median("l_quantity").alias("y"))


@query("""
SELECT r, g, b, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, r, g, b) AS k FROM (SELECT CAST(floor(l_quantity / 16) * 16 AS BIGINT) AS r, CAST(floor(l_linenumber / 2) * 2 AS BIGINT) AS g, CAST(floor(l_tax * 100 / 4) * 4 AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)) WHERE k <= 8""")
def color_histogram_top8(t: Tables):
    """The eight most frequent quantised colours."""
    step = lambda c, s: (F.floor(c / s) * s).cast("long")
    got = t.lineitem.groupBy(step(F.col("l_quantity"), 16).alias("r"), step(F.col("l_linenumber"), 2).alias("g"), step(F.col("l_tax") * 100, 4).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return got.orderBy(F.col("n").desc(), "r", "g", "b").limit(8)


@query("""
SELECT event_type, CASE WHEN value > 95 THEN 'timeout' WHEN value > 80 THEN 'provider_rate_limited' WHEN event_type = 'login' THEN 'provider_authentication' ELSE 'unknown_internal_failure' END AS class, count(*) AS n FROM events GROUP BY 1, 2""")
def failure_classes(t: Tables):
    """Ordered failure classes and their counts."""
    kind = O.ladder([(F.col("value") > 95, "timeout"), (F.col("value") > 80, "provider_rate_limited"), (F.col("event_type") == "login", "provider_authentication")], "unknown_internal_failure")
    return t.events.groupBy("event_type", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_type IS NULL THEN 'unknown_property' WHEN p_size < 5 THEN 'missing_raw_value' WHEN p_retailprice > 1500 THEN 'parsed_value_mismatch' WHEN p_brand LIKE '%1' THEN 'invalid_unit_for_mass' END AS reason,
 NOT (p_type IS NULL OR p_size < 5 OR p_retailprice > 1500 OR p_brand LIKE '%1') AS admitted FROM part""")
def admission_ladder(t: Tables):
    """The first failing reason of an ordered admission rule."""
    reason = O.ladder([(F.col("p_type").isNull(), "unknown_property"), (F.col("p_size") < 5, "missing_raw_value"), (F.col("p_retailprice") > 1500, "parsed_value_mismatch"), (F.col("p_brand").like("%1"), "invalid_unit_for_mass")])
    return t.part.select("p_partkey", reason.alias("reason"), reason.isNull().alias("admitted"))


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, length(html) AS n_chars FROM pages""")
def safe_urls(t: Tables):
    """Scheme and host of http(s) URLs."""
    url = X.http_url(F.col("url"))
    return t.pages.select("page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.length("html").alias("n_chars"))


@query("""
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR, true) AS gap FROM events)) GROUP BY user_id, s""")
def session_windows(t: Tables):
    """Sessions that end after an hour without events."""
    got = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.min("ts").alias("session_start"), F.count(F.lit(1)).alias("n"))
    return got.select("user_id", "session_start", "n")


@query("""
SELECT l_returnflag AS status, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS n, count(DISTINCT l_partkey) AS materials FROM lineitem GROUP BY 1""")
def archive_summary(t: Tables):
    """Conditional totals of admitted and quarantined observations."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("status")).agg(total(OUTPUTS[0][1]).alias("quantity"), total(OUTPUTS[1][1]).alias("price"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("materials"))
