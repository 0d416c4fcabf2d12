"""What readers look at: calculations one by one, chart specifications and their rows, captions above tables, runs and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import stable_id
from ..functions.text import chart_title, field_name
from .evidence import semantics

#: The dimensions of a biomaterials result that scoring must not merge.
RESULT_CONDITIONS = (
    "sample_label", "specimen_type", "process", "cell_line", "organism", "strain", "assay", "exposure_time", "dilution", "medium", "scientific_type",
    "shear_rate_per_s", "temperature_C", "crosslinking", "co_culture", "surface_model", "biomolecule", "solvent",
)
CAPTION = r"(?i)^\s*(Table\s+(\d+[A-Za-z]?)[.:\s]+.+)$"


def calculation_view(archives: DataFrame) -> DataFrame:
    """A row for each output of a calculation, and one for a calculation without any; its evidence, else the calculation's, says where it is from."""
    rows = archives.select(F.col("metadata.archive_id").alias("archive_id"), F.try_element_at("sources", F.lit(1)).alias("s"), "materials", F.explode("calculations").alias("c"))
    rows = rows.select("archive_id", "s", "materials", "c", F.posexplode_outer("c.outputs").alias("ordinal", "m"))
    known = F.map_from_entries(F.transform("materials", lambda m: F.struct(m["material_id"].alias("key"), F.coalesce(F.nullif(m["name"], F.lit("")), F.nullif(m["formula"], F.lit("")), m["material_id"]).alias("value"))))
    names = F.array_compact(F.transform(F.coalesce("c.material_ids", F.array().cast("array<string>")), lambda i: F.try_element_at(known, i)))
    first = F.when(F.col("m").isNotNull(), F.try_element_at("m.evidence", F.lit(1))).otherwise(F.try_element_at("c.evidence", F.lit(1)))
    rows = rows.withColumn("e", first)
    text = lambda c: F.coalesce(c, F.lit(""))
    origin = text(F.coalesce("e.original_source_type", "e.source_type"))
    return rows.select(
        "archive_id", F.col("c.calculation_id").alias("calculation_id"), F.col("c.calculation_type").alias("calculation_type"), F.array_join(names, " | ").alias("material"), text(F.col("m.property")).alias("calculated_property"),
        F.try_variant_get("m.value", "$", "string").alias("value"), text(F.col("m.raw_value")).alias("raw_value"), text(F.col("m.unit")).alias("unit"), text(F.coalesce(F.nullif("m.method", F.lit("")), F.col("c.method"))).alias("method"),
        text(F.col("c.functional")).alias("functional"), text(F.col("c.code")).alias("software"), text(F.col("s.title")).alias("source_title"), text(F.coalesce(F.nullif("e.source_id", F.lit("")), F.col("s.source_id"))).alias("source_id"),
        F.col("e.page").alias("source_page"), origin.alias("evidence_origin"), F.when(F.col("e").isNotNull(), semantics(F.col("e"))["strength"]).otherwise("unverified").alias("evidence_strength"), text(F.col("e.text_snippet")).alias("evidence_snippet"),
    )


def field_value(field: str) -> Column:
    """A row's field as text, or the condition that ``conditions.<name>`` names."""
    return F.try_element_at("conditions", F.lit(field.removeprefix("conditions."))) if field.startswith("conditions.") else F.col(field).cast("string")


def _number(field: str) -> Column:
    return field_value(field).try_cast("double")


def _axis_unit(field: str) -> Column:
    if field == "value":
        return F.when(F.col("value").isNotNull(), F.coalesce(F.nullif("normalized_unit", F.lit("")), F.nullif("unit", F.lit(""))))
    if field.startswith("conditions."):
        return F.nullif(F.try_element_at("conditions", F.lit(f"{field.removeprefix('conditions.')}_unit")), F.lit(""))
    return F.lit(None).cast("string")


def usable(chart: str, x: str, y: str, z: str | None = None) -> Column:
    """A row has what the chart draws: numbers on its axes; bars may stand on any x."""
    held = (field_value(x).isNotNull() if chart == "bar" else _number(x).isNotNull()) & _number(y).isNotNull()
    return held & _number(z).isNotNull() if chart in ("heatmap", "contour") and z else held


def chart_rows(rows: DataFrame, chart: str, x: str, y: str, z: str | None = None, series: str | None = None) -> DataFrame:
    """The rows that a chart draws, with ``series``: blank ones are Unspecified, without a series field it is null."""
    label = F.coalesce(F.nullif(field_value(series), F.lit("")), F.lit("Unspecified")) if series else F.lit(None).cast("string")
    return rows.filter(usable(chart, x, y, z)).withColumn("series", label)


def chart_specs(rows: DataFrame, by: list[str], chart: str, x: str, y: str, z: str | None = None, series: str | None = None) -> DataFrame:
    """One specification for each group of ``rows``: title, labels, units of axes that have one unit alone, counts, and whether it can be drawn.

    A property shows in the labels if all rows share it.
    """
    axes = {"x": x, "y": y} | ({"z": z} if z else {})
    units = [F.when(F.count_distinct(_axis_unit(f)) == 1, F.min(_axis_unit(f))).alias(f"{a}_unit") for a, f in axes.items()]
    drawn = F.count_if(usable(chart, x, y, z))
    shared = F.when(F.count_distinct(F.nullif("property_name", F.lit(""))) == 1, F.min(F.nullif("property_name", F.lit(""))))
    got = rows.groupBy(*by).agg(*units, shared.alias("_property"), F.count_distinct(F.nullif("source_id", F.lit(""))).alias("source_count"), F.count(F.lit(1)).alias("record_count"), drawn.alias("drawn_count"))
    labels = {a: field_name(F.lit(f), F.col("_property")) for a, f in axes.items()}
    z_label = labels.get("z", F.lit(""))
    got = got.withColumns({f"{a}_label": c for a, c in labels.items()} | {"title": chart_title(F.lit(chart), labels["x"], labels["y"], z_label)})
    name = stable_id("viz", F.lit(chart), *(F.lit(f) for f in (x, y, z or "", series or "")), *(F.col(c) for c in by))
    warning = F.when((F.lit(chart) == "contour") & (F.col("drawn_count") > 0), "interpolated_between_measurements")
    return got.withColumns({"visualization_id": name, "chart_type": F.lit(chart), "series_field": F.lit(series).cast("string"), "warning": warning}).drop("_property")


def caption_above(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``boxes`` (page_id, y0, ...) with caption and number of the nearest caption block of their page that ends above them.

    ``blocks``: page_id, y1, text. A window over places of the page, not a join of all pairs; of captions that end at the
    same height the least text counts.
    """
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    heads = blocks.filter(F.rlike(said, F.lit(CAPTION))).groupBy("page_id", F.col("y1").alias("_y")).agg(F.min(said).alias("_caption"))
    rows = boxes.withColumn("_y", F.col("y0")).withColumn("_box", F.lit(1))
    w = Window.partitionBy("page_id").orderBy("_y", F.coalesce("_box", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(heads, allowMissingColumns=True).withColumn("_seen", F.last("_caption", ignorenulls=True).over(w)).filter("_box = 1")
    part = lambda i: F.nullif(F.regexp_extract("_seen", CAPTION, i), F.lit(""))
    return both.select(*boxes.columns, part(1).alias("caption"), part(2).alias("table_number"))


def run_identity(archives: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, archives, source_ids, domains) of each extraction run: distinct and sorted, by what an archive's first row in the run says."""
    each = archives.select(run, "archive_id", "source_id", "domain").distinct()
    listed = lambda c: F.array_sort(F.collect_set(c))
    return each.groupBy(run).agg(F.count_distinct("archive_id").alias("archives"), listed("source_id").alias("source_ids"), listed("domain").alias("domains"))


def result_identity() -> Column:
    """The dimensions of a biomaterials result that make it another one; nulls are values of their own."""
    conditions = [F.try_element_at("conditions", F.lit(n)).alias(n) for n in RESULT_CONDITIONS]
    return F.struct("property", "unit", "method", *conditions)


def result_groups(results: DataFrame) -> DataFrame:
    """(identity, results, values): how many results and distinct values each identity has."""
    return results.groupBy(result_identity().alias("identity")).agg(F.count(F.lit(1)).alias("results"), F.count_distinct("value").alias("values"))
