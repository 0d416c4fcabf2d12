"""Sensor records: papers with samples and nested performance, flattened, normalised and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sensor_units
from . import frames as O

_QUANTITY = "struct<value double, unit string, normalized_value double, normalized_unit string>"
_TIMED = f"struct<value {_QUANTITY}, criterion string, concentration {_QUANTITY}, operating_temperature {_QUANTITY}>"
RECORD = f"""
paper struct<title string, doi string>,
samples array<struct<sample_id string, material string, material_category string, sensor_type string, source_paper_title string, source_doi string,
    deposition struct<method_family string, method string, method_variant string, substrate string>,
    testing struct<target_analyte string, concentration {_QUANTITY}, operating_temperature {_QUANTITY}>,
    performance struct<sensitivity struct<value {_QUANTITY}, formula string, has_evidence boolean>, limit_of_detection {_QUANTITY}, response_time {_TIMED}, recovery_time {_TIMED},
        selectivity struct<target_analyte string, entries array<struct<interferent string, selectivity_ratio double, target_response double, interferent_response double>>>>>>
"""


def merge_records(records: DataFrame) -> DataFrame:
    """Samples with their paper's title and DOI stamped on, unless they have their own."""
    return records.withColumn("samples", F.transform("samples", lambda s: s.withField("source_paper_title", F.coalesce(s["source_paper_title"], F.col("paper.title"))).withField("source_doi", F.coalesce(s["source_doi"], F.col("paper.doi")))))


def _normal(q: Column) -> Column:
    value, unit = sensor_units(q["value"], q["unit"])
    return F.when(q.isNotNull(), q.withField("normalized_value", F.coalesce(value, q["normalized_value"])).withField("normalized_unit", F.coalesce(unit, q["normalized_unit"])))


def normalize(records: DataFrame) -> DataFrame:
    """Times in seconds, concentrations in ppm; the reported values stay."""

    def both(x: Column) -> Column:
        return x.withField("concentration", _normal(x["concentration"])).withField("operating_temperature", _normal(x["operating_temperature"]))

    def one(s: Column) -> Column:
        # Each field is built from the sample as it came, so that expressions do not nest in one another.
        t, p = s["testing"], s["performance"]
        timed = lambda x: F.when(x.isNotNull(), both(x).withField("value", _normal(x["value"])))
        done = p.withField("limit_of_detection", _normal(p["limit_of_detection"])).withField("response_time", timed(p["response_time"])).withField("recovery_time", timed(p["recovery_time"]))
        return s.withField("testing", F.when(t.isNotNull(), both(t))).withField("performance", F.when(p.isNotNull(), done))

    return records.withColumn("samples", F.transform("samples", one))


def samples(records: DataFrame) -> DataFrame:
    rows = records.select("paper", F.posexplode("samples").alias("i", "s"))
    own = F.coalesce("s.sample_id", "s.material", F.concat(F.lit("Sample "), (F.col("i") + 1).cast("string")))
    title = F.col("s.source_paper_title")
    short = F.concat(F.substring(title, 1, 34), F.when(F.length(title) > 34, "…").otherwise(""))
    return rows.withColumn("label", F.when(F.length(title) > 0, F.concat_ws(" | ", short, own)).otherwise(own))


def flatten(records: DataFrame) -> DataFrame:
    """One row for each selectivity entry of a sample, or for the sample if it has none."""
    p = "s.performance"
    rows = samples(records).withColumn("e", F.explode_outer(f"{p}.selectivity.entries"))
    return rows.select(
        F.col("paper.title").alias("paper_title"), "paper.doi", F.coalesce("s.sample_id", F.concat(F.lit("sample_"), (F.col("i") + 1).cast("string"))).alias("sample_id"), "s.material", "s.material_category", "s.sensor_type", "s.testing.target_analyte",
        F.col("s.deposition.method_family").alias("deposition_family"), F.col("s.deposition.method").alias("deposition_method"), F.col("s.deposition.method_variant").alias("deposition_variant"), "s.deposition.substrate",
        F.col(f"{p}.sensitivity.value.value").alias("sensitivity_value"), F.col(f"{p}.limit_of_detection.value").alias("lod_value"), F.col(f"{p}.response_time.value.value").alias("response_time_value"), F.col(f"{p}.recovery_time.value.value").alias("recovery_time_value"),
        F.col("e.interferent").alias("selectivity_interferent"), F.col("e.selectivity_ratio").alias("selectivity_ratio"), F.col("e.target_response").alias("selectivity_target_response"), F.col("e.interferent_response").alias("selectivity_interferent_response"),
    )


def selectivity(records: DataFrame) -> DataFrame:
    """sample, pair, ratio: the mean reported ratio, computed only where both responses are given."""
    rows = samples(records).select("label", F.coalesce("s.performance.selectivity.target_analyte", "s.testing.target_analyte", F.lit("Target")).alias("target"), F.explode("s.performance.selectivity.entries").alias("e"))
    ratio = F.coalesce("e.selectivity_ratio", O.ratio(F.col("e.target_response"), F.col("e.interferent_response")))
    pair = F.concat_ws("/", "target", F.coalesce("e.interferent", F.lit("interferent")))
    return rows.select(F.col("label").alias("sample"), pair.alias("pair"), ratio.alias("ratio")).filter("ratio is not null").groupBy("sample", "pair").agg(F.avg("ratio").alias("ratio"))


def selectivity_matrix(records: DataFrame, pairs: list[str] | None = None) -> DataFrame:
    long = selectivity(records)
    return (long.groupBy("sample").pivot("pair", pairs) if pairs else long.groupBy("sample").pivot("pair")).agg(F.first("ratio"))


def response_points(records: DataFrame) -> DataFrame:
    """Samples with a response time, at its own or the test's temperature and concentration, normalised where possible."""
    r = "s.performance.response_time"
    best = lambda *q: F.coalesce(*(F.coalesce(F.col(f"{x}.normalized_value"), F.col(f"{x}.value")) for x in q))
    rows = samples(records).filter(F.col(f"{r}.value.value").isNotNull())
    return rows.select(
        F.col("label").alias("sample"), F.col("s.source_paper_title").alias("source_paper"), "s.material", "s.sensor_type", "s.testing.target_analyte", best(f"{r}.operating_temperature", "s.testing.operating_temperature").alias("temperature_C"),
        best(f"{r}.concentration", "s.testing.concentration").alias("concentration_ppm"), best(f"{r}.value").alias("response_time"), F.coalesce(f"{r}.value.normalized_unit", f"{r}.value.unit").alias("response_time_unit"), F.col(f"{r}.criterion").alias("criterion"),
    )


def response_groups(records: DataFrame) -> DataFrame:
    """Material, target and sensor type of the groups that a contour may show; a null type is a type."""
    rows = response_points(records).dropna(subset=["material", "target_analyte", "temperature_C", "concentration_ppm", "response_time"])
    got = rows.groupBy("material", "target_analyte", "sensor_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("temperature_C").alias("temperatures"), F.countDistinct("concentration_ppm").alias("concentrations"))
    return got.filter("n >= 4 and temperatures >= 2 and concentrations >= 2")


def radar_metrics(records: DataFrame) -> DataFrame:
    """Five metrics of each sample, larger being better; times and limits are inverted."""
    p = "s.performance"
    inverse = lambda c: 1.0 / F.nullif(c, F.lit(0.0))
    timed = lambda n: F.coalesce(F.col(f"{p}.{n}.value.normalized_value"), F.col(f"{p}.{n}.value.value"))
    return samples(records).select(
        F.col("label").alias("sample"), "s.testing.target_analyte", "s.sensor_type", F.array_max(F.col(f"{p}.selectivity.entries.selectivity_ratio")).alias("selectivity"), inverse(timed("response_time")).alias("response_speed"),
        inverse(timed("recovery_time")).alias("recovery_speed"), F.col(f"{p}.sensitivity.value.value").alias("sensitivity"), inverse(F.col(f"{p}.limit_of_detection.value")).alias("detection_capability"),
    )


def radar_groups(records: DataFrame) -> DataFrame:
    """Samples with at least three metrics, of targets and sensor types with at least two of them."""
    names = ("selectivity", "response_speed", "recovery_speed", "sensitivity", "detection_capability")
    rows = radar_metrics(records).dropna(subset=["target_analyte", "sensor_type"]).filter(sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) >= 3)
    many = rows.groupBy("target_analyte", "sensor_type").count().filter("count >= 2").drop("count")
    return rows.join(many, ["target_analyte", "sensor_type"], "left_semi")


def warnings(records: DataFrame) -> DataFrame:
    """sample, warning of every value that lacks what makes it comparable."""
    p = "s.performance"
    bad = lambda e: e["selectivity_ratio"].isNull() & e["target_response"].isNull() & e["interferent_response"].isNull()
    qualitative = F.transform(F.filter(F.coalesce(f"{p}.selectivity.entries", F.array().cast("array<struct<interferent:string,selectivity_ratio:double,target_response:double,interferent_response:double>>")), bad), lambda e: F.concat(F.lit("selectivity entry for "), F.coalesce(e["interferent"], F.lit("an interferent")), F.lit(" is qualitative only.")))
    lacks = lambda n: F.when(F.col(f"{p}.{n}.value").isNotNull() & (F.length(F.coalesce(f"{p}.{n}.criterion", F.lit(""))) == 0), F.lit(f"{n.replace('_', '-')} criterion (t90/t95/etc.) was not reported or extracted."))
    unproven = F.when(F.col(f"{p}.sensitivity.value").isNotNull() & ~F.coalesce(f"{p}.sensitivity.has_evidence", F.lit(False)), F.lit("sensitivity has a value but no evidence object."))
    texts = F.concat(F.array_compact(F.array(unproven, lacks("response_time"), lacks("recovery_time"))), qualitative)
    own = F.coalesce("s.sample_id", "s.material", F.concat(F.lit("sample "), (F.col("i") + 1).cast("string")))
    return samples(records).select(own.alias("sample"), F.explode(texts).alias("warning"))
