"""Two-dimensional tables: which column is the row axis, what the headers say of the other, and what binds.

A table is a matrix if one column under a header that names a quantity holds values of it, and the nearest
headers of at least two wholly numeric columns name values of another. Where the headers were lost in parsing,
the page's lines below the caption may give them. A matrix binds to what was drafted about it only
if one group, one property and one unit are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import axis_scalar, single_number
from ..functions.numbers import reported_numbers
from ..functions.text import evidence_key, once
from ..sources.settled import settled
from . import frames as O

#: Quantities that an axis may show, in order, with their unit and the words that name them.
AXES = [
    ("state_of_charge", "%", r"\bsoc\b|state of charge"), ("depth_of_discharge", "%", r"\bdod\b|depth of discharge"), ("temperature", "°C", "temperature"),
    ("current_density", None, "current density"), ("concentration", None, "concentration"), ("pressure", None, "pressure"), ("composition", None, "composition"), ("cycle", None, "cycle"),
]
#: How a condition's column may be headed.
CONDITION_WORDS = {"stateofcharge": ("soc", "state of charge"), "depthofdischarge": ("dod", "depth of discharge"), "crate": ("rate",), "cycle": ("cycle",), "currentdensity": ("current density",)}
#: Lines below a caption in which lost headers are sought.
REPAIR_LINES = 4
_DEGREES = r"(?i)([−–—-]?\s*\d+(?:\.\d+)?)\s*[°◦]\s*C"


def axis_semantics(text: Column) -> Column:
    """(property, unit) of each quantity that a header or caption names, in the order of AXES."""
    def named(key: Column, words: Column) -> Column:
        each = [F.when(F.rlike(words, F.lit(p)) | (F.rlike(key, F.lit("[°◦]c")) if name == "temperature" else F.lit(False)), F.struct(F.lit(name).alias("property"), F.lit(unit).cast("string").alias("unit"))) for name, unit, p in AXES]
        rate = F.when(F.contains(words, F.lit("rate")) & F.rlike(words, F.lit(r"(?:^|\s)c(?:\s|$)")), F.struct(F.lit("C_rate").alias("property"), F.lit("C").alias("unit")))
        return F.array_compact(F.array(*each, rate))

    return once(evidence_key(text), lambda key: once(F.btrim(F.regexp_replace(key, "[^a-z0-9%]+", " ")), lambda words: named(key, words)))


def row_axes(cells: DataFrame) -> DataFrame:
    """(table_id, property, unit, axis_col, row, raw, value): the row axis of each table that has one.

    Of all headers that name a quantity, the one with most values of it below counts; ties go to the
    leftmost column, then the upper header. How many values stand below each header is a running count.
    """
    # Each quantity is named by letters, so cells of digits and signs alone name none.
    lettered = cells.filter(F.rlike("text", F.lit(r"[A-Za-z]|[^\x00-\x7F]")))
    named = lettered.select("table_id", "col", "row", F.posexplode(axis_semantics(F.col("text"))).alias("ord", "s"))
    named = settled(named.select("table_id", "col", "row", "ord", "s.property", "s.unit"))
    asked = named.select("table_id", "col", "property", "unit").distinct()
    values = cells.join(asked, ["table_id", "col"]).withColumn("value", axis_scalar(F.col("text"), F.col("property")))
    below = Window.partitionBy("table_id", "col", "property").orderBy(F.col("row").desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_below", F.count("value").over(below))
    heads = values.join(named.drop("unit"), ["table_id", "col", "row", "property"]).filter("_below >= 2")
    order = F.struct("_below", -F.col("col"), -F.col("row"), -F.col("ord"))
    best = heads.groupBy("table_id").agg(F.max_by(F.struct("property", "col", F.col("row").alias("head")), order).alias("b")).select("table_id", "b.*")
    return values.join(best, ["table_id", "col", "property"]).filter("row > head and value is not null").select("table_id", "property", "unit", F.col("col").alias("axis_col"), "row", F.col("text").alias("raw"), "value")


def page_headers(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(table_id, n, raws, values): the first line of temperatures below a table's caption on its page, for each number n of them."""
    lines = pages.select("source_id", "page", F.posexplode(F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)), lambda x: x != "")).alias("at", "line"))
    near = tables.join(lines, ["source_id", "page"])
    number = F.concat(F.lit(r"(?i)^Table\s+\Q"), F.col("table_number"), F.lit(r"\E\b"))
    captions = near.filter(F.coalesce(F.rlike("line", number), F.lit(False)) | (evidence_key(F.col("line")) == evidence_key(F.col("caption")))).select("table_id", "source_id", "page", F.col("at").alias("caption_at"))
    after = captions.withColumn("at", F.explode(F.sequence(F.col("caption_at") + 1, F.col("caption_at") + REPAIR_LINES)))
    found = after.join(lines, ["source_id", "page", "at"])
    raws, digits = F.regexp_extract_all("line", F.lit(_DEGREES), F.lit(0)), F.regexp_extract_all("line", F.lit(_DEGREES), F.lit(1))
    values = F.transform(digits, lambda d: F.replace(F.translate(d, "−–—", "---"), F.lit(" "), F.lit("")).cast("double"))
    found = found.select("table_id", F.size(raws).alias("n"), F.struct("caption_at", "at", raws.alias("raws"), values.alias("values")).alias("x")).filter("n > 0")
    return found.groupBy("table_id", "n").agg(F.min("x").alias("x")).select("table_id", "n", "x.raws", "x.values")


def matrix_cells(tables: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """The cells of each matrix with their value and the property, value, unit and raw text of both axes.

    ``tables``: table_id (unique), source_id, page, table_number, caption; ``cells``: table_id, row, col, text (one of each
    place); ``pages``: source_id, page, text. Null cells are empty; tables that are no matrix give no rows.
    """
    rows = settled(row_axes(cells))
    size = rows.groupBy("table_id").agg(F.first("property").alias("row_property"), F.first("axis_col").alias("axis_col"), F.count(F.lit(1)).alias("_rows"), F.min("row").alias("_first"))
    body = cells.join(rows.select("table_id", "row"), ["table_id", "row"]).withColumn("_number", single_number(F.col("text")))
    body = settled(body.join(size.select("table_id", "axis_col", "_rows"), "table_id").filter("col <> axis_col"))
    columns = body.groupBy("table_id", "col").agg(F.count("_number").alias("_n"), F.first("_rows").alias("_rows")).filter("_n = _rows").select("table_id", "col")
    wide = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("_columns")).filter("_columns >= 2")

    above = cells.join(size.select("table_id", "_first"), "table_id").filter(F.col("row") < F.col("_first")).join(columns, ["table_id", "col"])
    heads = above.groupBy("table_id", "col").agg(F.max_by(F.coalesce("text", F.lit("")), "row").alias("raw"))
    context = heads.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "raw"))).alias("_heads")).join(wide, "table_id").filter(F.size("_heads") == F.col("_columns"))
    context = context.join(tables.select("table_id", "caption"), "table_id").join(size.select("table_id", "row_property"), "table_id")
    said = F.concat_ws(" ", "caption", F.transform("_heads", lambda h: h["raw"]))
    options = context.select("table_id", "_heads", "_columns", "row_property", F.posexplode(axis_semantics(said)).alias("ord", "s")).filter(F.col("s.property") != F.col("row_property"))
    each = options.select("table_id", "_columns", "ord", "s.property", "s.unit", F.explode("_heads").alias("h")).withColumn("value", axis_scalar(F.col("h.raw"), F.col("property")))
    direct = each.groupBy("table_id", "_columns", "ord", "property", "unit").agg(
        F.count("value").alias("_n"), F.count_distinct("value").alias("_d"), F.array_sort(F.collect_list(F.struct(F.col("h.col").alias("col"), F.col("h.raw").alias("raw"), "value"))).alias("axis")
    )
    repaired = page_headers(tables, pages).withColumnRenamed("n", "_columns").withColumn("property", F.lit("temperature")).filter(F.size(F.array_distinct("values")) == F.size("values"))
    direct = direct.join(repaired, ["table_id", "_columns", "property"], "left")
    given = (F.col("_n") == F.col("_columns")) & (F.col("_d") == F.col("_columns"))
    mended = F.transform("axis", lambda a, i: F.struct(a["col"].alias("col"), F.get("raws", i).alias("raw"), F.get("values", i).alias("value")))
    axis = F.when(given, F.col("axis")).when(F.col("raws").isNotNull(), mended)
    chosen = direct.withColumn("axis", axis).filter("axis is not null").groupBy("table_id").agg(F.min_by(F.struct("property", "unit", "axis"), "ord").alias("c"))
    across = chosen.select("table_id", F.col("c.property").alias("column_property"), F.col("c.unit").alias("column_unit"), F.explode("c.axis").alias("a"))
    across = across.select("table_id", "column_property", "column_unit", F.col("a.col").alias("col"), F.col("a.raw").alias("column_raw"), F.col("a.value").alias("column_value"))

    down = rows.select("table_id", "row", F.col("property").alias("row_property"), F.col("unit").alias("row_unit"), F.col("raw").alias("row_raw"), F.col("value").alias("row_value"))
    out = body.select("table_id", "row", "col", F.col("text").alias("raw"), F.col("_number").alias("value"))
    return out.join(across, ["table_id", "col"]).join(down, ["table_id", "row"])


def table_bindings(matrices: DataFrame, seeds: DataFrame) -> DataFrame:
    """(table_id, group_id, property, unit, reason) of each matrix: what its drafted points agree on, or why nothing binds.

    ``seeds``: point_id, table_id, group_id, property, unit; null properties and units don't count.
    """
    drafted = seeds.groupBy("table_id").agg(
        F.count_distinct("group_id").alias("_groups"), F.count_distinct("property").alias("_properties"), F.count_distinct("unit").alias("_units"),
        F.min("group_id").alias("group_id"), F.min("property").alias("property"), F.min("unit").alias("unit"),
    )
    rows = matrices.select("table_id").distinct().join(drafted, "table_id", "left")
    reason = O.ladder([
        (F.col("_groups").isNull(), "no_points"), (F.col("_groups") != 1, "several_groups"), (F.col("_properties") != 1, F.when(F.col("_properties") == 0, "no_property").otherwise("several_properties")),
        (F.col("_units") != 1, F.when(F.col("_units") == 0, "no_unit").otherwise("several_units")),
    ])
    return rows.select("table_id", *(F.when(reason.isNull(), F.col(c)).alias(c) for c in ("group_id", "property", "unit")), reason.alias("reason"))


def _bucket(c: Column) -> Column:
    return F.floor(F.log(F.abs(c) + 1) * 1e6)


def _same(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-9), F.abs(a) * 1e-9)


def seed_cells(seeds: DataFrame, matrices: DataFrame) -> DataFrame:
    """(point_id, table_id, row, col): the only matrix cell of a point's value whose axes agree with what the point says of them.

    ``seeds`` also have value and axes (map of property to value). The tolerance join goes by buckets.
    """
    cells = matrices.select("table_id", "row", "col", F.col("value").alias("_v"), "row_property", "row_value", "column_property", "column_value")
    cells = cells.withColumn("_b", F.explode(F.array(*(_bucket(F.col("_v")) + d for d in (-1, 0, 1)))))
    met = seeds.withColumn("_b", _bucket(F.col("value"))).join(cells, ["table_id", "_b"]).filter(_same(F.col("value"), F.col("_v")))
    agrees = lambda p, v: F.coalesce(_same(F.try_element_at("axes", F.col(p)), F.col(v)), F.lit(True))
    met = met.filter(agrees("row_property", "row_value") & agrees("column_property", "column_value"))
    hits = met.groupBy("point_id", "table_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "col")).alias("c")).filter("_n = 1")
    return hits.select("point_id", "table_id", "c.row", "c.col")


def recover_matrices(matrices: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row for each cell of each bound matrix: the drafted point that it is, or a new one, with what all points agree on.

    ``seeds`` also have method, cycle and ownership. Of several points at one cell the least id counts.
    """
    matrices = settled(matrices)
    bound = table_bindings(matrices, seeds).filter("reason is null").drop("reason")
    own = seeds.join(bound.select("table_id", "property"), ["table_id", "property"])
    shared = lambda c, kind: F.when(F.count_distinct(kind) == 1, F.min(kind)).alias(c)
    common = own.groupBy("table_id").agg(shared("method", F.col("method")), shared("cycle", F.col("cycle")), shared("ownership", F.when(F.col("ownership") != "unknown", F.col("ownership"))))
    taken = seed_cells(own, matrices).groupBy("table_id", "row", "col").agg(F.min("point_id").alias("point_id"))
    return matrices.join(bound, "table_id").join(common, "table_id").join(taken, ["table_id", "row", "col"], "left")


def _printed(text: Column) -> Column:
    """What ``cell_matches`` compares of a text: its key, how many numbers it has, and the number if it has one."""
    one = lambda numbers: F.struct(F.size(numbers).alias("n"), F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0))).alias("one"))
    read = lambda key: once(reported_numbers(F.coalesce(text, F.lit(""))), lambda x: once(one(x), lambda o: F.struct(key.alias("key"), o["n"].alias("n"), o["one"].alias("one"))))
    return once(evidence_key(text), read)


def _matches(cell: Column, said: Column, value: Column) -> Column:
    near = lambda a, b: F.coalesce(F.abs(a - b) <= F.greatest(F.lit(1e-9), F.abs(b) * 1e-9), F.lit(False))
    within = (F.length(cell["key"]) > 0) & (F.length(said["key"]) > 0) & (F.contains(cell["key"], said["key"]) | F.contains(said["key"], cell["key"]))
    bare = (cell["n"] == 0) & (said["n"] == 0)
    by_text = within & ((cell["key"] == said["key"]) | bare | near(cell["one"], said["one"]))
    return by_text | near(cell["one"], value)


def cell_matches(text: Column, raw: Column, value: Column) -> Column:
    """A cell shows what was reported: the same text, text within the other without another number, or the same number."""
    return _matches(_printed(text), _printed(raw), value)


def condition_cells(results: DataFrame, conditions: DataFrame, cells: DataFrame) -> DataFrame:
    """(point_id, property, table_id, row, col, found, axis_row, axis_col): the cells that show a condition of a result's cell.

    ``results``: point_id, table_id, row, col; ``conditions``: point_id, property, raw, value. A condition whose column may be
    headed by known words is sought in the nearest such column to the left; others to the left in the row and
    above in the column. Headings of several cells count: the words of one span three cells at most.
    """
    plain = F.regexp_replace(F.lower("property"), "[^a-z0-9]+", "")
    words = F.create_map(*(x for k, v in CONDITION_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    # Texts are read once, before they meet: each cell meets several conditions.
    asked = settled(results.join(conditions.select("point_id", "property", _printed(F.col("raw")).alias("_said"), F.col("value").alias("_value"), F.try_element_at(words, plain).alias("_words")), "point_id"))
    filled = cells.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    w = Window.partitionBy("table_id", "col").orderBy("row")
    run = evidence_key(F.concat_ws(" ", F.lag("text", 2).over(w), F.lag("text", 1).over(w), F.col("text")))
    headed = filled.select("table_id", "col", "row", run.alias("_run"))
    listed = lambda run: F.array_compact(F.array(*(F.when(F.contains(run, F.lit(x)), F.lit(x)) for x in sorted({x for v in CONDITION_WORDS.values() for x in v}))))
    headed = headed.select("table_id", "col", "row", F.explode(once(F.col("_run"), listed)).alias("_word")).groupBy("table_id", "col", "_word").agg(F.min("row").alias("_since"))
    key = ["point_id", "property", "table_id", "row", "col"]
    left = asked.select(*key, F.explode("_words").alias("_word")).join(headed.withColumnRenamed("col", "_col"), ["table_id", "_word"])
    left = left.filter((F.col("_col") < F.col("col")) & (F.col("_since") < F.col("row"))).groupBy(*key).agg(F.max("_col").alias("_column"))
    asked = asked.join(left, key, "left")
    other = settled(cells.select(F.col("table_id").alias("_t"), F.col("row").alias("_r"), F.col("col").alias("_c"), _printed(F.col("text")).alias("_cell")))
    here = F.col("table_id") == F.col("_t")
    beside = here & (F.col("row") == F.col("_r")) & (F.col("_c") < F.col("col")) & (F.col("_column").isNull() | (F.col("_column") == F.col("_c")))
    in_row = asked.join(other, beside)
    in_col = asked.filter("_column is null").join(other, here & (F.col("col") == F.col("_c")) & (F.col("_r") < F.col("row")))
    met = in_row.unionByName(in_col).filter(_matches(F.col("_cell"), F.col("_said"), F.col("_value")))
    hits = met.groupBy(*key).agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("_r", "_c")).alias("_at"))
    out = asked.select(*key).join(hits, key, "left")
    alone = F.when(F.col("found") == 1, F.col("_at"))
    return out.select(*key, F.coalesce("found", F.lit(0).cast("long")).alias("found"), alone["_r"].alias("axis_row"), alone["_c"].alias("axis_col"))


def enrich_conditions(points: DataFrame, conditions: DataFrame, cells: DataFrame) -> DataFrame:
    """(point_id, property, table_id, row, col, axis_row, axis_col) of the conditions that the only viable result cell of a point proves.

    ``points``: point_id, table_id, raw, value. A cell that shows the value is viable if each condition
    has a cell beside or above it; with no or several viable ones a point stays as it is.
    """
    said = points.select("point_id", "table_id", "value", _printed(F.col("raw")).alias("_said"))
    met = said.join(cells.select("table_id", "row", "col", _printed(F.col("text")).alias("_cell")), "table_id")
    shown = settled(met.filter(_matches(F.col("_cell"), F.col("_said"), F.col("value"))).select("point_id", "table_id", "row", "col"))
    axes = settled(condition_cells(shown, conditions, cells))
    failed = axes.filter("found = 0").select("point_id", "table_id", "row", "col").distinct()
    viable = shown.join(failed, ["point_id", "table_id", "row", "col"], "left_anti")
    alone = viable.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("point_id")
    return axes.join(viable, ["point_id", "table_id", "row", "col"]).join(alone, "point_id").filter("found = 1").drop("found")
