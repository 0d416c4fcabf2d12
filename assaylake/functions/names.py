"""Names, units and labels brought under one spelling, as columns. Nothing here converts a scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import scientific_key

#: Names of battery properties as papers print them, and the property each means.
PROPERTY_NAMES = {
    "specific capacity": "specific_capacity",
    "discharge specific capacity": "specific_capacity",
    "discharge capacity": "specific_capacity",
    "reversible capacity": "specific_capacity",
    "capacity retention": "capacity_retention",
    "coulombic efficiency": "coulombic_efficiency",
    "charge transfer resistance rct": "charge_transfer_resistance",
    "charge transfer resistance": "charge_transfer_resistance",
    "rct": "charge_transfer_resistance",
    "lithium ion diffusion coefficient dli": "diffusion_coefficient",
    "lithium ion diffusion coefficient": "diffusion_coefficient",
    "diffusion coefficient": "diffusion_coefficient",
    "warburg coefficient w": "warburg_coefficient",
    "warburg coefficient": "warburg_coefficient",
    "specific surface area": "specific_surface_area",
    "internal resistance": "internal_resistance",
    "impedance": "impedance",
}
#: Phrases that tell the property of a longer name; the first one that is found decides.
PROPERTY_PHRASES = (
    ("charge transfer resistance", "charge_transfer_resistance"),
    ("diffusion coefficient", "diffusion_coefficient"),
    ("warburg coefficient", "warburg_coefficient"),
    ("capacity retention", "capacity_retention"),
    ("specific capacity", "specific_capacity"),
    ("discharge capacity", "specific_capacity"),
    ("reversible capacity", "specific_capacity"),
    ("specific surface area", "specific_surface_area"),
)
#: Names of test conditions as papers print them, and the condition each means.
CONDITION_NAMES = {
    "soc": "state_of_charge",
    "state of charge": "state_of_charge",
    "state of charge soc": "state_of_charge",
    "depth of discharge": "depth_of_discharge",
    "dod": "depth_of_discharge",
    "current density": "current_density",
    "areal current density": "current_density",
    "specific current": "specific_current",
    "c rate": "C_rate",
    "crate": "C_rate",
    "ambient temperature": "ambient_temperature",
    "internal temperature": "internal_temperature",
}
#: Potential scales in the order in which they are looked for, as letters and digits alone.
POTENTIAL_SCALES = (("rhe", "rhe"), ("she", "she"), ("nhe", "nhe"), ("agagcl", "ag/agcl"))


def _spaced(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def _listed(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def _first_found(text: Column, phrases) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(phrase)), meant) for phrase, meant in phrases))


def property_name(name: Column) -> Column:
    """A battery property's one name: a listed name, else by the phrase it holds, else in snake case."""
    key = _spaced(name)
    return F.coalesce(_listed(key, PROPERTY_NAMES), _first_found(key, PROPERTY_PHRASES), F.replace(key, F.lit(" "), F.lit("_")))


def condition_name(name: Column) -> Column:
    """A condition's one name: a listed name, else in snake case."""
    key = _spaced(name)
    return F.coalesce(_listed(key, CONDITION_NAMES), F.replace(key, F.lit(" "), F.lit("_")))


def generic_token(value: Column) -> Column:
    """Key for comparing printed labels: products as blanks, inverse areas without a caret."""
    text = F.translate(scientific_key(value), "·*", "  ")
    return F.regexp_replace(F.regexp_replace(text, "cm\\^[-−]2", "cm-2"), r"\s+", " ")


def unit_token(value: Column) -> Column:
    """Key for comparing printed units: micro and ohm signs spelled out, areas below a stroke as inverse areas."""
    text = F.replace(F.replace(F.translate(generic_token(value), "µμ²", "uu2"), F.lit("Ω"), F.lit("ohm")), F.lit("ω"), F.lit("ohm"))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "/cm-?2", " cm-2"), r"\s+", " "))


def material_token(value: Column) -> Column:
    """Key for comparing grades of materials: no blanks about the grade mark."""
    return F.regexp_replace(generic_token(value), r"\s*#\s*", "#")


def condition_token(value: Column) -> Column:
    """Key for comparing conditions: a coefficient of one before a power of ten goes."""
    text = F.replace(generic_token(value), F.lit("×"), F.lit("x"))
    return F.regexp_replace(text, r"(?<![\d.])1\s*x\s*(?=10\s*\^?\s*[+-]?\d)", "")


def same_electrode(actual: Column, expected: Column) -> Column:
    """The labels are equal, or one has the other in brackets; nothing expected meets anything."""
    a, e = generic_token(actual), generic_token(expected)
    bracketed = lambda x: F.concat(F.lit("("), x, F.lit(")"))
    met = (a != "") & ((a == e) | F.contains(a, bracketed(e)) | F.contains(e, bracketed(a)))
    return (F.coalesce(expected, F.lit("")) == "") | met


def same_name(actual: Column, expected: Column) -> Column:
    """The expected name is in the actual one, or its bracketed short form is the actual one."""
    a, e = generic_token(actual), generic_token(expected)
    short = F.transform(F.regexp_extract_all(F.coalesce(expected, F.lit("")), F.lit(r"\(([^()]+)\)")), lambda x: F.trim(F.lower(x)))
    return (F.coalesce(expected, F.lit("")) == "") | F.contains(a, e) | F.array_contains(short, a)


def canonical_unit(value: Column, product: Column | None = None) -> Column:
    """A unit in one notation: a numerator, then its denominators in order; a product's name in it goes."""
    text = F.replace(F.replace(scientific_key(value), F.lit("²"), F.lit("2")), F.lit("⁻"), F.lit("-"))
    if product is not None:
        text = F.when(F.coalesce(product, F.lit("")) == "", text).otherwise(F.replace(text, scientific_key(product), F.lit("")))
    text = F.regexp_replace(F.replace(text, F.lit("·"), F.lit("/")), r"\s*/\s*", "/")
    text = F.regexp_replace(text, r"\s+([a-z]+)\s*-\s*1\b", "/$1")
    text = F.replace(F.regexp_replace(text, r"\s+([a-z]+)\s*-\s*([2-9][0-9]*)\b", "/$1$2"), F.lit(" "), F.lit(""))
    parts = F.filter(F.split(text, "/"), lambda p: p != "")
    ordered = F.concat(F.slice(parts, 1, 1), F.array_sort(F.slice(parts, 2, 1 << 20)))
    return F.when(value.isNotNull(), F.when(F.size(parts) <= 1, text).otherwise(F.array_join(ordered, "/")))


def potential_parts(value: Column) -> Column:
    """(value, reference) of a printed potential: its first number and the scale it names, null if absent."""
    text = scientific_key(value)
    number = F.regexp_extract(text, r"(?<![a-z0-9])([+-]?\d+(?:\.\d+)?)", 1)
    scale = _first_found(F.regexp_replace(text, "[^a-z0-9]+", ""), POTENTIAL_SCALES)
    return F.struct(F.when(number != "", number).cast("double").alias("value"), scale.alias("reference"))
