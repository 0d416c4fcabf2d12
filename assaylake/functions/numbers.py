"""Reading numbers, quantities and units out of text, as Column expressions. Nothing is derived or guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
RANGE = r"(?i)\d\s*(?:-|–|—|to)\s*\d"


def _extract(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def scalar_condition(c: Column) -> Column:
    """(value, raw, unit) of a single explicit scalar such as ``25 °C`` or ``C/10``; else all null.

    Ranges, prose and texts with a second number stay categorical: their value is null.
    """
    text = F.trim(c)
    per = _extract(text, r"^\s*[cC]\s*/\s*(\d+(?:\.\d+)?)\s*$", 1).try_cast("double")
    pattern = rf"^\s*({NUMBER})\s*([^\d].*?)?\s*$"
    value = _extract(text, pattern, 1).try_cast("double")
    unit = F.nullif(F.trim(F.regexp_extract(text, pattern, 2)), F.lit(""))
    plain = value.isNotNull() & ~F.coalesce(unit.rlike(r"\d"), F.lit(False))
    rate = per.isNotNull() & (per != 0)
    return F.struct(
        F.when(rate, 1.0 / F.when(rate, per)).when(plain, value).alias("value"),
        F.when(rate | plain, text).alias("raw"),
        F.when(rate, F.lit("C")).when(plain, unit).alias("unit"),
    )


def parse_quantity(c: Column) -> Column:
    """(raw, value, unit, qualifier) of a compact quantity: ``~1.5 A``, ``<0.1 Hz``, ``2-4 V``."""
    text = F.trim(c)
    approx, low, high = r"(?i)^(?:~|≈|about\s+|approximately\s+)", r"^(?:>=|≥|>)\s*", r"^(?:<=|≤|<)\s*"
    probe = F.when(text.rlike(approx), F.regexp_replace(text, approx, "")).when(text.rlike(low), F.regexp_replace(text, low, "")).when(text.rlike(high), F.regexp_replace(text, high, "")).otherwise(text)
    mark = F.when(text.rlike(approx), "approx").when(text.rlike(low), "lower_bound").when(text.rlike(high), "upper_bound").otherwise("exact")
    pattern = r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*([^\d\s].*)?$"
    spans, found = probe.rlike(RANGE), probe.rlike(pattern)
    one = ~spans & found
    return F.struct(
        text.alias("raw"),
        F.when(one, _extract(probe, pattern, 1).try_cast("double")).alias("value"),
        F.when(one, F.nullif(F.trim(F.regexp_extract(probe, pattern, 2)), F.lit(""))).alias("unit"),
        F.when(spans, "range").when(found, mark).otherwise("unknown").alias("qualifier"),
    )


def split_window(c: Column) -> Column:
    """The two ends of a window such as ``1.5–4.8 V``, each with the unit; null if it is none."""
    pattern = r"(?i)([-+]?\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*([-+]?\d+(?:\.\d+)?)\s*([^\d\s].*)?$"
    end = lambda i: F.when(c.rlike(pattern), F.trim(F.concat_ws(" ", F.regexp_extract(c, pattern, i), F.trim(F.regexp_extract(c, pattern, 3)))))
    return F.struct(end(1).alias("low"), end(2).alias("high"))


def integral(value: Column) -> Column:
    """The integer that a number is, null for others."""
    return F.when(value == F.floor(value), value.cast("long"))


def reported_numbers(c: Column) -> Column:
    """All numbers printed in a text; grouping commas dropped, products with powers of ten multiplied out."""
    text = F.regexp_replace(F.replace(c, F.lit("−"), F.lit("-")), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    product = rf"(?<![\w.])([-+]?(?:\d+(?:\.\d*)?|\.\d+))\s*[×x*]\s*10\s*\^?\s*\{{?\s*([-+]?\d+)\s*\}}?"

    def read(t: Column) -> Column:
        plain = F.transform(F.regexp_extract_all(t, F.lit(rf"(?<![\w.]){NUMBER}"), 0), lambda x: x.try_cast("double"))
        base, power = F.regexp_extract_all(t, F.lit(product), 1), F.regexp_extract_all(t, F.lit(product), 2)
        scaled = F.transform(F.arrays_zip(base.alias("b"), power.alias("p")), lambda z: F.concat(z["b"], F.lit("e"), z["p"]).try_cast("double"))
        return F.when(F.contains(t, F.lit("10")), F.concat(plain, scaled)).otherwise(plain)

    return once(text, read)


def supports_value(c: Column, value: Column, rel: float = 1e-8, abs_tol: float = 1e-20) -> Column:
    """A text prints the value: within a relative tolerance that only float parsing needs."""
    return F.exists(reported_numbers(c), lambda x: F.abs(x - value) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(value)), F.lit(abs_tol)))


def number_key(c: Column) -> Column:
    """A number's key: 12 significant digits in scientific notation, the same for equal numbers."""
    return F.format_string("%.11e", c)


def unit_key(c: Column, dialect: str = "mechanical") -> Column:
    """A unit's comparison key. Dialects differ in what they fold, as their domains do."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    if dialect == "mechanical":
        return F.lower(F.translate(text, "−·²", "-*2"))
    if dialect == "plain":
        return F.lower(text)
    return F.translate(F.lower(text), "²³μµ·−", "23uu*-")


#: Factors to base units of sensor quantities. Temperatures are taken as they are.
SENSOR_UNITS = {
    "ms": (0.001, "s"), "millisecond": (0.001, "s"), "milliseconds": (0.001, "s"), "s": (1.0, "s"), "sec": (1.0, "s"), "secs": (1.0, "s"), "second": (1.0, "s"), "seconds": (1.0, "s"), "min": (60.0, "s"), "minute": (60.0, "s"), "minutes": (60.0, "s"),
    "ppm": (1.0, "ppm"), "ppb": (0.001, "ppm"), "ppt": (0.000001, "ppm"), "°c": (1.0, "°C"), "c": (1.0, "°C"), "degc": (1.0, "°C"),
}


def _of(table: dict, i: int, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[i]))), key)


def sensor_units(value: Column, unit: Column) -> tuple[Column, Column]:
    """Value and unit of times in seconds, concentrations in ppm and temperatures in °C; others null."""
    key = F.lower(F.trim(unit))
    return value * _of(SENSOR_UNITS, 0, key), _of(SENSOR_UNITS, 1, key)


#: Factors of battery units, by lower-case name. Case is folded, so mHz and MHz are not told apart.
BATTERY_UNITS = {
    "mah/g": (1.0, "mAh/g"), "ah/kg": (1.0, "mAh/g"), "ma/g": (1.0, "mA/g"), "a/g": (1000.0, "mA/g"), "mv": (1e-3, "V"), "v": (1.0, "V"), "ma": (1e-3, "A"), "a": (1.0, "A"),
    "mohm": (1e-3, "ohm"), "mω": (1e-3, "ohm"), "ohm": (1.0, "ohm"), "ω": (1.0, "ohm"), "h": (3600.0, "s"), "min": (60.0, "s"), "s": (1.0, "s"), "nm": (1e-9, "m"), "um": (1e-6, "m"), "µm": (1e-6, "m"), "mm": (1e-3, "m"),
}


def battery_units(value: Column, unit: Column) -> tuple[Column, Column]:
    key = F.lower(F.regexp_replace(F.trim(unit), r"\s+", ""))
    kelvin = key == "k"
    return F.when(kelvin, value - 273.15).otherwise(value * _of(BATTERY_UNITS, 0, key)), F.when(kelvin, "°C").otherwise(_of(BATTERY_UNITS, 1, key))


#: Patterns of a corrosion unit without blanks, in order, and their categories. They are never converted.
CORROSION_CATEGORIES = (
    (r"%|percent", "percent"), (r"mg|g|kg|ug", "mass"), (r"cm2|m2|mm2", "area"), (r"h|day|s|min|year|y", "time"),
    (r"(?:g|mg|kg|ug)/(?:cm2|m2|mm2)|(?:g|mg|kg|ug)(?:cm|m|mm)-2", "mass_per_area"),
    (r"(?:g|mg|kg|ug)/(?:cm2|m2|mm2)/(?:h|day|s|min|year|y)|(?:g|mg|kg|ug)(?:cm|m|mm)-2(?:h|day|s|min|year|y)-1", "mass_loss_rate"),
    (r"mpy|(?:mm|um|cm|mil)/(?:year|y)", "penetration_rate"), (r"mm|um|cm|m|mil", "length"), (r"(?:g|mg|kg)/(?:cm3|m3|mm3)", "density"),
)
#: The categories that a property's unit may have; others are not checked.
CORROSION_ALLOWED = {
    "initial_mass": ("mass",), "final_mass": ("mass",), "mass_loss": ("mass", "mass_per_area"), "corrosion_rate": ("mass_loss_rate", "penetration_rate"), "penetration_rate": ("penetration_rate",),
    "penetration_depth": ("length",), "inhibition_efficiency": ("percent",), "protection_efficiency": ("percent",),
}


def corrosion_category(unit: Column) -> Column:
    """What a unit measures; texts that are no such unit are ``unknown``."""
    token = F.translate(F.lower(F.coalesce(unit, F.lit(""))), "µμ²³·−", "uu23 -")
    token = F.regexp_replace(F.regexp_replace(token, r"\bper\b", "/"), r"years|yrs\b|yr\b", "year")
    token = F.regexp_replace(F.regexp_replace(token, "days", "day"), "hours|hour", "h")
    token = F.translate(F.regexp_replace(token, r"(?U)\s+", ""), "^", "")
    out = F.when(token == "", "unknown")
    for pattern, category in CORROSION_CATEGORIES:
        out = out.when(token.rlike(f"^(?:{pattern})$"), category)
    return out.otherwise("unknown")


def corrosion_unit_fits(prop: Column, unit: Column) -> Column:
    """Whether a property may have the unit; what is not known to be wrong may."""
    category, out = corrosion_category(unit), F.lit(True)
    for name, allowed in CORROSION_ALLOWED.items():
        out = F.when(prop == name, category.isin(*allowed)).otherwise(out)
    return (category == "unknown") | out


def pixel_to_data(pixel: Column, p0: Column, p1: Column, v0: Column, v1: Column, log: bool = False) -> Column:
    """A pixel coordinate on a calibrated axis, linear or log10."""
    share = (pixel - p0) / (p1 - p0)
    return F.pow(F.lit(10.0), F.log10(v0) + share * (F.log10(v1) - F.log10(v0))) if log else v0 + share * (v1 - v0)


def pixel_uncertainty(pixels: Column, overlaps: Column) -> Column:
    """Pixel error: one pixel at least, doubled where curves overlap."""
    return F.greatest(pixels, F.lit(1.0)) * F.when(overlaps, 2.0).otherwise(1.0)


def digitization_confidence(pixels: Column) -> Column:
    return F.greatest(F.lit(0.2), F.least(F.lit(0.95), 1 - pixels / 12))


def round_to_uncertainty(value: Column, uncertainty: Column) -> Column:
    """The value to the decimal place of its uncertainty's first digit."""
    scale = F.pow(F.lit(10.0), -F.floor(F.log10(uncertainty)))
    return F.when(uncertainty > 0, F.rint(value * scale) / scale).otherwise(value)


def color_distance(r: Column, g: Column, b: Column, color: tuple[int, int, int]) -> Column:
    return F.sqrt(sum(((c - v) * (c - v) for c, v in zip((r, g, b), color, strict=True)), F.lit(0.0)))


def router_confidence(best: Column, margin: Column) -> Column:
    return F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.99), 0.55 * F.least(best / 8, F.lit(1.0)) + 0.45 * margin)), 3)
