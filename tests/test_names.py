"""Names, units and labels against cases, and the status operators on nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from assaylake.functions import axes as G
from assaylake.functions import names as A
from assaylake.operators import matching as M
from assaylake.operators import status as S

PROPERTIES = [("Rct", "charge_transfer_resistance"), ("First discharge capacity", "specific_capacity"), ("Open-circuit voltage (V)", "open_circuit_voltage_v"), ("", ""), (None, None)]
CONDITIONS = [("DoD", "depth_of_discharge"), ("Areal current density", "current_density"), ("Rest time", "rest_time"), (None, None)]
UNITS = [("mmol g-1 h-1", None, "mmol/g/h"), ("mmol h-1 g-1", None, "mmol/g/h"), ("A·cm⁻²", None, "a/cm-2"), ("mmol H2 / g / h", "H2", "mmol/g/h"), ("%", "", "%"), (None, "H2", None)]
POTENTIALS = [("-0.35 V vs. RHE", -0.35, "rhe"), ("1.2 V (Ag/AgCl)", 1.2, "ag/agcl"), ("open circuit", None, None), (None, None, None)]
ELECTRODES = [("SCE", "saturated calomel electrode (SCE)", True), ("Ag/AgCl", "SCE", False), (None, "SCE", False), ("SCE", None, True), ("", "", True)]
NAMES = [("IB", "Indigo blue (IB)", True), ("indigo blue (ib) film", "Indigo blue (IB)", True), ("xy", "Indigo blue (IB)", False), (None, "", True)]


def run(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("fn,cases", [(A.property_name, PROPERTIES), (A.condition_name, CONDITIONS)])
def test_canonical(spark, fn, cases):
    assert run(spark, cases, "a string, b string", fn(F.col("a"))) == [(b,) for _, b in cases]


def test_units(spark):
    assert run(spark, UNITS, "a string, p string, b string", A.canonical_unit(F.col("a"), F.col("p"))) == [(b,) for *_, b in UNITS]


def test_potentials(spark):
    p = A.potential_parts(F.col("a"))
    assert run(spark, POTENTIALS, "a string, v double, r string", p["value"], p["reference"]) == [(v, r) for _, v, r in POTENTIALS]


@pytest.mark.parametrize("fn,cases", [(A.same_electrode, ELECTRODES), (A.same_name, NAMES)])
def test_labels(spark, fn, cases):
    assert run(spark, cases, "a string, e string, b boolean", fn(F.col("a"), F.col("e"))) == [(b,) for *_, b in cases]


def test_tokens(spark):
    rows = [("20 # steel", "20# steel", "1 x 10^-3 M", "µA/cm²")]
    got = run(spark, rows, "a string, b string, c string, u string", A.material_token(F.col("a")) == A.material_token(F.col("b")), A.condition_token(F.col("c")), A.unit_token(F.col("u")))
    assert got == [(True, "10^-3 m", "ua cm-2")]


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], "o int, a string, b string")
    assert [tuple(r) for r in M.dimension_counts(empty, empty, ["o"], {"a": ["a"]}).collect()] == [("a", 0, 0)]
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "o int, parser string")
    assert sorted(tuple(r) for r in S.primary_parser(pages, "o", ["b", "a"]).collect()) == [(1, "b"), (2, None)]
    records = spark.createDataFrame([(1, None), (1, [])], "o int, evidence array<struct<text_snippet string, verbatim_match boolean>>")
    assert [tuple(r) for r in S.evidence_coverage(records, ["o"]).collect()] == [(1, 2, 0, 0.0, 0, 0.0, 0, 0.0)]


def test_empty_state(spark):
    rows = [(["REVIEW"], 0, 5, 0), ([None], 0, 5, 0), (None, 2, 5, 0), (None, None, None, None), (["review"], 0, 0, 1)]
    got = run(spark, rows, "t array<string>, a int, q int, r int", S.empty_state(F.col("t"), F.col("a"), F.col("q"), F.col("r"))["kind"])
    assert [k for (k,) in got] == ["review_no_focal_data", "quarantined_only", "no_structured_results", "no_structured_results", None]


AXES = [("50 %", "state_of_charge", 50.0), ("50", "state_of_charge", None), ("–20 ◦C", "temperature", -20.0), ("25", "temperature", None), ("C/10", "C_rate", 0.1), ("0.5C", "C_rate", 0.5), ("3 or 4", "cycle", None), ("", "cycle", None), (None, "cycle", None)]


def test_axis_scalars(spark):
    assert run(spark, AXES, "a string, p string, v double", G.axis_scalar(F.col("a"), F.col("p"))) == [(v,) for *_, v in AXES]


def test_circuit_terms(spark):
    term = G.circuit_term(F.col("a"))
    assert run(spark, [("R ct",), ("x",), (None,)], "a string", term["property"], term["role"]) == [("charge_transfer_resistance", "charge_transfer"), (None, "unknown"), (None, "unknown")]
