"""What the columns and axes of reported tables mean, and values to be warned of, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import reported_numbers
from .text import once

#: Terms of impedance tables, with the property and the part of the circuit that each means.
CIRCUIT_TERMS = {
    "re": ("solution_resistance", "electrolyte"),
    "rs": ("solution_resistance", "electrolyte"),
    "rt": ("charge_transfer_resistance", "charge_transfer"),
    "rct": ("charge_transfer_resistance", "charge_transfer"),
    "rc": ("coating_resistance", "coating"),
    "rcoat": ("coating_resistance", "coating"),
    "rpore": ("pore_resistance", "pore"),
    "rcp": ("protective_layer_resistance", "protective_layer"),
    "rf": ("film_resistance", "film"),
    "rox": ("oxide_resistance", "oxide"),
    "cdl": ("cpe_parameter", "double_layer"),
    "ccp": ("cpe_parameter", "protective_layer"),
    "ccoat": ("cpe_parameter", "coating"),
    "q": ("cpe_parameter", "unknown"),
    "y0": ("cpe_parameter", "unknown"),
    "ndl": ("cpe_exponent", "double_layer"),
    "ncp": ("cpe_exponent", "protective_layer"),
    "n": ("cpe_exponent", "unknown"),
    "warburg": ("warburg_parameter", "diffusion"),
    "zw": ("warburg_parameter", "diffusion"),
    "w": ("warburg_parameter", "diffusion"),
}
#: Properties that need a potential scale.
SCALED = ("onset_potential", "half_wave_potential", "current_density", "partial_current_density", "faradaic_efficiency", "product_selectivity", "mass_activity", "specific_activity")


def circuit_term(term: Column) -> Column:
    """(property, role) of a column's term; no property and an unknown role for others."""
    known = F.create_map(*(x for k, (p, r) in CIRCUIT_TERMS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("property"), F.lit(r).alias("role")))))
    found = F.try_element_at(known, F.lower(F.regexp_replace(F.coalesce(term, F.lit("")), r"\s+", "")))
    return F.struct(found["property"].alias("property"), F.coalesce(found["role"], F.lit("unknown")).alias("role"))


def single_number(raw: Column) -> Column:
    """The one number that a text prints; null if it prints none or several."""
    return once(reported_numbers(raw), lambda numbers: F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0))))


def c_rate(raw: Column) -> Column:
    """A rate printed as C/n or nC; null for all else, and for C/0."""
    part = lambda pattern: F.nullif(F.regexp_extract(F.trim(raw), pattern, 1), F.lit("")).cast("double")
    return F.coalesce(F.try_divide(F.lit(1.0), part(r"(?i)^C\s*/\s*(\d+(?:\.\d+)?)$")), part(r"(?i)^([-+]?\d+(?:\.\d+)?)\s*C$"))


def axis_scalar(raw: Column, prop: Column) -> Column:
    """An axis value as a number, as its property is printed: charges with a per cent sign, temperatures in degrees Celsius."""
    one = single_number(raw)
    degrees = F.regexp_extract(F.trim(raw), r"(?i)^([−–—-]?\s*\d+(?:\.\d+)?)\s*[°◦]\s*C$", 1)
    degrees = F.nullif(F.replace(F.translate(degrees, "−–—", "---"), F.lit(" "), F.lit("")), F.lit("")).cast("double")
    charge = F.when(F.contains(raw, F.lit("%")), one)
    return F.when(prop.isin("state_of_charge", "depth_of_discharge"), charge).when(prop == "temperature", degrees).when(prop == "C_rate", F.coalesce(c_rate(raw), one)).otherwise(one)


def metric_warnings(prop: Column, value: Column, unit: Column, basis: Column, reference: Column) -> Column:
    """What a reported value is to be warned of, in a fixed order; nothing is corrected."""
    return F.array_compact(F.array(
        F.when((unit == "%") & (value > 100), "percentage_greater_than_100"),
        F.when(basis == "unknown", "normalization_basis_unknown"),
        F.when(prop.isin(*SCALED) & (reference == "unknown"), "potential_reference_unknown"),
    ))
