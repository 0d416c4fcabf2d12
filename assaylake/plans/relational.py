"""Search, projections, joins, rollups and dedup over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames as O
from .registry import Tables, query

#: The four outputs of a line item, as property and column.
OUTPUTS = (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))


def money(c, scale: int = 2):
    return F.col(c).cast(f"decimal(18,{scale})") if isinstance(c, str) else c.cast(f"decimal(18,{scale})")


def total(c, scale: int = 2):
    """An exact sum of amounts, as double."""
    return F.sum(money(c, scale)).cast("double")


@query("""
SELECT o_orderpriority AS domain, count(*) AS rows_found, count(DISTINCT o_custkey) AS sources, count(DISTINCT l_partkey) AS materials,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, CAST(max(l_extendedprice) AS DOUBLE) AS best_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_extendedprice >= 20000 AND l_quantity >= 10 AND p_size >= 10 GROUP BY 1""")
def measurement_search(t: Tables):
    """A property with value and condition bounds, joined to sources and materials, by domain."""
    lines = t.lineitem.filter("l_extendedprice >= 20000 and l_quantity >= 10").select("l_orderkey", "l_partkey", "l_extendedprice")
    found = lines.join(t.part.filter("p_size >= 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    found = found.join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy(F.col("o_orderpriority").alias("domain")).agg(
        F.count(F.lit(1)).alias("rows_found"), F.countDistinct("o_custkey").alias("sources"), F.countDistinct("l_partkey").alias("materials"),
        total("l_extendedprice").alias("total_value"), F.max("l_extendedprice").alias("best_value"),
    )


@query("""
SELECT o_orderkey, o_orderpriority AS domain FROM orders
WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) BETWEEN 1994 AND 1996
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND lower(p_name) LIKE '%a%' AND l_quantity > 30)""")
def archive_search_predicates(t: Tables):
    """Optional predicates, all of which have to hold; nested ones are semi joins."""
    archives = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & F.year("o_orderdate").between(1994, 1996))
    with_name = t.lineitem.filter("l_quantity > 30").join(t.part.filter(F.contains(F.lower("p_name"), F.lit("a"))), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return archives.join(with_name.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", F.col("o_orderpriority").alias("domain"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def archive_point_lookup(t: Tables):
    """The archive with an id: a pushed-down equality."""
    first = t.orders.agg(F.min("o_orderkey")).first()[0]
    return t.orders.filter(F.col("o_orderkey") == first).select("o_orderkey", "o_custkey", "o_orderpriority").limit(1)


@query("""
SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_signature_audit(t: Tables):
    """Signatures that several records share."""
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order")).filter("n > 1")


@query("""
SELECT l_orderkey, l_linenumber, property, value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, ord, value) - 1 AS ordinal
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, unnest(['quantity','price','discount','tax']) AS property, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value, unnest([0,1,2,3]) AS ord
      FROM lineitem WHERE l_returnflag <> 'R')""")
def results_rows_canonical(t: Tables):
    """One row for each output of each admitted record, with its ordinal in the archive."""
    pairs = F.array(*(F.struct(F.lit(name).alias("property"), F.col(c).alias("value")) for name, c in OUTPUTS))
    rows = t.lineitem.filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.posexplode(pairs).alias("o", "m"))
    ordinal = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "o", "m.value")) - 1
    return rows.select("l_orderkey", "l_linenumber", "m.property", "m.value", ordinal.alias("ordinal"))


@query("""
SELECT l_orderkey, l_linenumber, 'canonical' AS admission_status, CAST(NULL AS VARCHAR) AS reason, l_quantity AS value FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'quarantined', 'returned', NULL FROM lineitem WHERE l_returnflag = 'R'""")
def results_rows_all(t: Tables):
    """Canonical rows and quarantined ones, whose values stay out of the value column."""
    at = ("l_orderkey", "l_linenumber")
    good = t.lineitem.filter("l_returnflag <> 'R'").select(*at, F.lit("canonical").alias("admission_status"), F.col("l_quantity").alias("value"))
    held = t.lineitem.filter("l_returnflag = 'R'").select(*at, F.lit("quarantined").alias("admission_status"), F.lit("returned").alias("reason"))
    return good.unionByName(held, allowMissingColumns=True).select(*at, "admission_status", "reason", "value")


@query("""
SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE lower(l_shipmode_) IN ('n','a') AND list_has_any(string_split(lower(p_name), ' '), ['red','blue','green','steel']) ORDER BY 1, 2""".replace("l_shipmode_", "l_returnflag"))
def explorer_filter(t: Tables):
    """Case-blind choices, and a choice among the tokens of a multi-valued cell."""
    choice = F.array(*map(F.lit, ("red", "blue", "green", "steel")))
    parts = t.part.filter(F.arrays_overlap(F.split(F.lower("p_name"), " "), choice)).select("p_partkey", "p_name")
    rows = t.lineitem.filter(F.lower("l_returnflag").isin("n", "a"))
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("""
SELECT 'brand' AS field, p_brand AS choice, count(*) AS n FROM part GROUP BY 2
UNION ALL SELECT 'token', tok, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS tok FROM part) WHERE tok <> '' GROUP BY 2""")
def filter_options(t: Tables):
    """The choices that occur, cells of several tokens being taken apart."""
    brands = t.part.groupBy(F.lit("brand").alias("field"), F.col("p_brand").alias("choice")).agg(F.count(F.lit(1)).alias("n"))
    tokens = t.part.select(F.explode(F.split("p_name", " ")).alias("choice")).filter("choice <> ''")
    return brands.unionByName(tokens.groupBy(F.lit("token").alias("field"), "choice").agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT CASE WHEN l_returnflag = 'R' THEN 'Needs review' WHEN l_tax >= 0.07 THEN 'Estimated' WHEN l_linestatus = 'F' THEN 'Verified'
  WHEN l_returnflag IN ('A','N') THEN 'Admitted' ELSE 'Needs review' END AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def trust_label_distribution(t: Tables):
    """Quarantined before estimated before verified before admitted."""
    label = O.ladder([(F.col("l_returnflag") == "R", "Needs review"), (F.col("l_tax") >= 0.07, "Estimated"), (F.col("l_linestatus") == "F", "Verified"), (F.col("l_returnflag").isin("A", "N"), "Admitted")], "Needs review")
    return t.lineitem.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_orderkey, l_linenumber LIMIT 3""")
def highlights_top3(t: Tables):
    """Results first, then by id."""
    first = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    return t.lineitem.orderBy(first, "l_orderkey", "l_linenumber").limit(3).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT o_orderkey FROM orders WHERE 1 = 0")
def scope_selection_empty_is_empty(t: Tables):
    """A scope of selected sources without any selection finds nothing, rather than everything."""
    selected: list[int] = []
    scope = F.col("o_custkey").isin(*selected) if selected else F.lit(False)
    return t.orders.filter(scope).select("o_orderkey")


@query("""
WITH a AS (SELECT o_orderpriority AS domain, count(*) AS archives, count(DISTINCT coalesce(CAST(o_custkey AS VARCHAR), o_orderkey || ':0')) AS papers,
  strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY 1),
c AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-UNUSED']) AS domain)
SELECT c.domain, coalesce(archives, 0) AS archives, coalesce(papers, 0) AS papers, latest FROM c LEFT JOIN a USING (domain)""")
def domain_rollup_with_empty_domains(t: Tables):
    """Archives and distinct papers of each configured domain, those without any included."""
    catalog = t.spark.createDataFrame([(d,) for d in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-UNUSED")], "domain string")
    paper = F.coalesce(F.col("o_custkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(":0")))
    a = t.orders.groupBy(F.col("o_orderpriority").alias("domain")).agg(F.count(F.lit(1)).alias("archives"), F.countDistinct(paper).alias("papers"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("latest"))
    return F.broadcast(catalog).join(a, "domain", "left").fillna(0, ["archives", "papers"])


@query("""
SELECT l_orderkey AS archive, count(*) AS measurements, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS provenance,
  CASE WHEN count_if(l_discount > 0) > 0 THEN round(CAST(count_if(l_discount > 0 AND l_tax > 0) AS DOUBLE) / count_if(l_discount > 0), 6) END AS normalization,
  round((1 + CAST(count_if(l_returnflag = 'N') > 0 AS INT) + CAST(count_if(l_quantity > 40) > 0 AS INT) + 1 + CAST(count(*) > 2 AS INT)) / 5.0, 6) AS completeness
FROM lineitem GROUP BY 1""")
def quality_ratios(t: Tables):
    """Coverage ratios of each archive; a ratio without a denominator stays null."""
    unit, both = F.col("l_discount") > 0, (F.col("l_discount") > 0) & (F.col("l_tax") > 0)
    block = lambda c: (F.count_if(c) > 0).cast("int")
    blocks = 2 + block(F.col("l_returnflag") == "N") + block(F.col("l_quantity") > 40) + (F.count(F.lit(1)) > 2).cast("int")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("archive")).agg(
        F.count(F.lit(1)).alias("measurements"), F.round(F.avg((F.col("l_linestatus") == "F").cast("double")), 6).alias("provenance"),
        F.round(O.ratio(F.count_if(both), F.count_if(unit)), 6).alias("normalization"), F.round(blocks / 5.0, 6).alias("completeness"),
    )


@query("""
SELECT l_orderkey, string_agg(coalesce(p_name, ''), '|' ORDER BY l_linenumber, l_partkey) AS material_names, string_agg(p_brand, '|' ORDER BY l_linenumber, l_partkey) AS material_brands
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def material_context_ordered_join(t: Tables):
    """Ids joined to their entities, dangling ones dropped, order kept, as cells."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    held = rows.groupBy("l_orderkey").agg(O.ordered_list(F.struct("p_name", "p_brand"), F.struct("l_linenumber", "l_partkey")).alias("m"))
    return held.select("l_orderkey", O.pipe_join(F.col("m.p_name")).alias("material_names"), O.pipe_join(F.col("m.p_brand")).alias("material_brands"))


@query("""
SELECT o_orderkey, coalesce(c_name, 'primary') AS source_title, coalesce(c_mktsegment, 'unknown') AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def source_fallback_left_join(t: Tables):
    """The evidence's own source, else the primary one."""
    known = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    rows = t.orders.select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.lit("primary")).alias("source_title"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("""
SELECT l_partkey AS material, CASE WHEN count(DISTINCT s_nationkey) = 1 THEN min(s_nationkey) END AS scalar,
  CASE WHEN count(DISTINCT s_nationkey) > 1 THEN array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') END AS conflict
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def lineage_unambiguous_or_conflict(t: Tables):
    """A process value that all of a material's processes share, else the list of alternatives."""
    edges = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    rows = edges.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("material"), "s_nationkey")
    return O.scalar_or_conflict(rows, ["material"], "s_nationkey").withColumn("conflict", F.array_join(F.col("conflict").cast("array<string>"), ","))


@query("""
SELECT s_suppkey AS device, n_name AS place, count(DISTINCT l_partkey) AS materials, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def device_fabrication_context(t: Tables):
    """Devices with what was made on them."""
    made = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("materials"), total("l_quantity").alias("quantity"))
    devices = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return devices.join(made, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").alias("device"), F.col("n_name").alias("place"), "materials", "quantity")


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority END, x.flag) AS protocol FROM orders LEFT JOIN
(SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS flag FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) x ON l_orderkey = o_orderkey""")
def protocol_first_non_null(t: Tables):
    """An inline protocol wins; else the first reference in order."""
    first = t.lineitem.filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("flag"))
    rows = t.orders.select("o_orderkey", "o_orderpriority").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inline = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority"))
    return rows.select("o_orderkey", F.coalesce(inline, "flag").alias("protocol"))


@query("""
SELECT 'order' AS rule, l_orderkey AS record, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2
UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 2
UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2""")
def integrity_left_anti(t: Tables):
    """References that resolve to nothing, by rule."""

    def rule(name, child, key, parent, other):
        gone = child.select(key).join(parent.select(other), F.col(key) == F.col(other), "left_anti")
        return gone.groupBy(F.lit(name).alias("rule"), F.col(key).alias("record")).agg(F.count(F.lit(1)).alias("n"))

    a = rule("order", t.lineitem, "l_orderkey", t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey")
    b = rule("part", t.lineitem, "l_partkey", t.part.filter("p_size <= 45"), "p_partkey")
    return a.unionByName(b).unionByName(rule("customer", t.orders, "o_custkey", t.customer, "c_custkey"))


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS position FROM events GROUP BY 1""")
def dedup_keep_last(t: Tables):
    """The last instance of each id, at the place of the first."""
    return O.keep_last_at_first(t.events.select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id", "position")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def dedup_keep_first(t: Tables):
    """The first instance of each key."""
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return O.earliest(rows, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 25 THEN l_quantity ELSE p_size END AS DOUBLE) AS size,
  p_brand AS brand, CASE WHEN l_tax > 0.04 THEN l_returnflag ELSE p_type END AS kind
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def condition_layer_merge(t: Tables):
    """Condition layers merged, the narrowest winning: a later map's keys replace an earlier one's."""
    layer = lambda **kv: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in kv.items())), lambda e: e["value"].isNotNull()))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    parent = layer(size=F.col("p_size").cast("double"), brand=F.col("p_brand"), kind=F.col("p_type"))
    point = layer(size=F.when(F.col("l_quantity") > 25, F.col("l_quantity")), kind=F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")))
    rest = F.map_filter(parent, lambda k, v: ~F.map_contains_key(point, k))
    merged = F.map_concat(rest, point)
    return rows.select("l_orderkey", "l_linenumber", merged.alias("c")).select("l_orderkey", "l_linenumber", F.col("c")["size"].cast("double").alias("size"), F.col("c")["brand"].alias("brand"), F.col("c")["kind"].alias("kind"))


@query("""
SELECT id, type, label FROM (SELECT 'order-' || o_orderkey AS id, 'archive' AS type, o_orderpriority AS label FROM orders
UNION ALL SELECT 'part-' || p_partkey, 'material', p_name FROM part UNION ALL SELECT 'supplier-' || s_suppkey, 'process', s_name FROM supplier
UNION ALL SELECT DISTINCT 'item-' || l_orderkey || '-' || l_linenumber, 'experiment', l_returnflag FROM lineitem)""")
def graph_nodes(t: Tables):
    """Typed nodes of the knowledge graph; the first of an id wins."""
    node = lambda df, i, kind, label: df.select(i.alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
    name = lambda p, *c: F.concat_ws("-", F.lit(p), *c)
    out = node(t.orders, name("order", "o_orderkey"), "archive", "o_orderpriority").unionByName(node(t.part, name("part", "p_partkey"), "material", "p_name"))
    out = out.unionByName(node(t.supplier, name("supplier", "s_suppkey"), "process", "s_name"))
    return out.unionByName(node(t.lineitem, name("item", "l_orderkey", "l_linenumber"), "experiment", "l_returnflag").distinct())


@query("""
SELECT DISTINCT 'item-' || l_orderkey || '-' || l_linenumber AS source, p AS predicate, CASE p WHEN 'tested_in' THEN 'part-' || l_partkey WHEN 'processed_by' THEN 'supplier-' || l_suppkey ELSE 'order-' || l_orderkey END AS target
FROM lineitem, (SELECT unnest(['tested_in','processed_by','reported_by']) AS p)""")
def graph_edges(t: Tables):
    """Typed edges, each once."""
    name = lambda p, *c: F.concat_ws("-", F.lit(p), *c)
    targets = {"tested_in": name("part", "l_partkey"), "processed_by": name("supplier", "l_suppkey"), "reported_by": name("order", "l_orderkey")}
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), v.alias("target")) for p, v in targets.items()))
    rows = t.lineitem.select(name("item", "l_orderkey", "l_linenumber").alias("source"), F.explode(pairs).alias("e"))
    return rows.select("source", "e.predicate", "e.target").distinct()


@query("""
SELECT p_partkey AS id, 'structures' AS type, p_name AS chemical_formula_descriptive, array_to_string(string_split(p_name, ' '), ',') AS elements, len(string_split(p_name, ' ')) AS nelements FROM part""")
def exchange_structures(t: Tables):
    """One structure resource for each material."""
    elements = F.split("p_name", " ")
    return t.part.select(F.col("p_partkey").alias("id"), F.lit("structures").alias("type"), F.col("p_name").alias("chemical_formula_descriptive"), F.array_join(elements, ",").alias("elements"), F.size(elements).cast("long").alias("nelements"))


@query("""
SELECT o_orderpriority AS priority, CASE WHEN count(o_totalprice) = count(*) THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS complete_total,
  CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) = count(*) THEN count(*) END AS strict_total,
  round(CAST(count_if(o_orderstatus = 'F') AS DOUBLE) / nullif(count_if(o_orderstatus IN ('F','O')), 0), 6) AS finished_rate,
  round(CAST(count_if(o_orderstatus = 'F') AS DOUBLE) / nullif(count_if(o_orderstatus = 'X'), 0), 6) AS no_rate
FROM orders GROUP BY 1""")
def integer_or_null_sum_and_rates(t: Tables):
    """Sums that are null unless every case reports; rates that are null without a denominator."""
    s = F.col("o_orderstatus")
    n = F.count(F.lit(1))
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.when(F.count("o_totalprice") == n, total("o_totalprice")).alias("complete_total"),
        F.when(F.count(F.when(s != "P", 1)) == n, n).alias("strict_total"),
        O.ratio(F.count_if(s == "F"), F.count_if(s.isin("F", "O")), 6).alias("finished_rate"), O.ratio(F.count_if(s == "F"), F.count_if(s == "X"), 6).alias("no_rate"),
    )


@query("""
SELECT event_type AS type, count(*) AS n, count(k) AS with_key, CAST(min(k) AS BIGINT) AS low, CAST(max(k) AS BIGINT) AS high, count(DISTINCT k) AS distinct_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_condition_extract(t: Tables):
    """A condition inside a JSON cell, tolerant of what is not there."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.select("event_type", k.alias("k")).groupBy(F.col("event_type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.count("k").alias("with_key"), F.min("k").alias("low"), F.max("k").alias("high"), F.countDistinct("k").alias("distinct_k")
    )


@query("""
SELECT event_id, CAST(value AS DOUBLE) AS value, CASE WHEN event_type = 'click' THEN k END AS condition_click, CASE WHEN event_type = 'view' THEN k END AS condition_view,
 CASE WHEN event_type NOT IN ('click','view') THEN k END AS condition_other FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def comparison_frame_wide(t: Tables):
    """Long conditions as one column for each name."""
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    rows = t.events.select("event_id", "value", F.create_map(kind, F.get_json_object("props", "$.k").try_cast("long")).alias("c"))
    return rows.select("event_id", "value", *(F.try_element_at("c", F.lit(k)).alias(f"condition_{k}") for k in ("click", "view", "other")))


@query("""
SELECT s_suppkey AS case_id, property, value FROM (SELECT s_suppkey, unnest(['balance','nation']) AS property, unnest([s_acctbal, CAST(s_nationkey AS DOUBLE)]) AS value FROM supplier) WHERE value IS NOT NULL""")
def wide_to_long_expectations(t: Tables):
    """Wide gold columns as one expectation a row."""
    rows = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return rows.unpivot(["s_suppkey"], ["balance", "nation"], "property", "value").filter("value is not null").withColumnRenamed("s_suppkey", "case_id")


@query("""
SELECT n_name AS nation, r_name AS region, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS archives
FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def catalog_flatten(t: Tables):
    """A hierarchy flattened, members without archives included."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    held = t.customer.select("c_custkey", "c_nationkey").join(t.orders.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = places.join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("archives"))


@query("""
SELECT r_name AS region, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""")
def benchmark_matrix(t: Tables):
    """The names of each group as one list."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def set_overlap_semi_anti(t: Tables):
    """Sources with one kind of record and without another."""
    by = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(by("1-URGENT"), "c_custkey", "left_semi").join(by("5-LOW"), "c_custkey", "left_anti")


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[=+@-]') THEN '''' || p_name ELSE p_name END AS name_cell, printf('%.2f', p_retailprice) AS price_cell,
 CASE WHEN regexp_matches(p_brand, '^[=+@-]') THEN '''' || p_brand ELSE coalesce(p_brand, '') END AS brand_cell FROM part""")
def csv_escape(t: Tables):
    """Cells that a spreadsheet can't take for formulas."""
    from ..functions.text import csv_cell

    return t.part.select("p_partkey", csv_cell(F.col("p_name")).alias("name_cell"), F.format_string("%.2f", "p_retailprice").alias("price_cell"), csv_cell(F.col("p_brand")).alias("brand_cell"))


@query("""
SELECT 'src-' || substr(sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_nationkey), 1, 16) AS stable_id, c_custkey FROM customer""")
def stable_export_ids(t: Tables):
    """Ids from a digest of the parts that name a record."""
    from ..functions.identity import export_id

    return t.customer.select(export_id("src", F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("stable_id"), "c_custkey")


@query("""
SELECT o_orderpriority AS domain, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, grouping(o_orderpriority) + grouping(year(o_orderdate)) AS level FROM orders
GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))""")
def rollup_domain_year(t: Tables):
    """Subtotals by domain and year."""
    rows = t.orders.select(F.col("o_orderpriority").alias("domain"), F.year("o_orderdate").cast("long").alias("y"))
    out = rows.rollup("domain", "y").agg(F.count(F.lit(1)).alias("n"), (F.grouping("domain") + F.grouping("y")).cast("long").alias("level"))
    return out.select("domain", "y", "n", "level")
