"""Queries of the admission contracts: each line of an order is a measurement, a good one or one with a fault of its own.

Which fault a line has follows from its key; its number is its quantity. The SQL says which reason each
fault has to give, and that it comes before all others that the line also deserves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as D
from .registry import Tables, query

_FIELDS = "i int, property string, raw string, missing boolean, shift double, word string, unit string, nvalue double, nunit string, method string, role string, modality string, kind string, conditions map<string,string>, ev string"


def v(reason: str | None, prop: str, *, raw: str | None = "{q}", missing: bool = False, shift: float = 0.0, word: str | None = None, unit: str | None = None, nvalue: float | None = None, nunit: str | None = None,
      method: str | None = None, role: str = "result", modality: str = "experimental", kind: str | None = "reported_measurement", ev: str = "own", **conditions: str) -> tuple:
    return reason, (prop, raw, missing, shift, word, unit, nvalue, nunit, method, role, modality, kind, conditions, ev)


_K = {"temperature": "300", "temperature_unit": "K", "measurement_orientation": "in-plane"}
_SUN = {"illumination_spectrum": "AM1.5G", "irradiance": "100"}
_GAS = {"species": "CO2", "test_mode": "pure_gas", "temperature": "35", "temperature_unit": "C", "pressure_kind": "feed"}
_PAIR = {"species_pair": "CO2/N2", "temperature": "35", "temperature_unit": "C"}
_PROCESS = {"role": "process_parameter", "kind": "reported_process_parameter"}
_CELL = {"sample_label": "S1", "cell_line": "L929", "assay": "MTT", "exposure_time": "24 h"}
_LABEL = {"sample_label": "S1"}
_DERIVED = {"kind": "reported_derived_metric"}
_CURVE = {"curve_role": "curve_point", "data_kind": "series_point"}

CASES = {
    "mechanical": [
        v(None, "yield_strength", unit="MPa"), v("ambiguous_hardness_scale", "hardness"), v("unknown_mechanical_property", "colour"), v("non_numeric_value", "yield_strength", missing=True), v("missing_raw_value", "yield_strength", raw=""),
        v("explicit_missing_source_value", "yield_strength", raw="n/a"), v("raw_value_not_numeric", "yield_strength", raw="high"), v("parsed_value_mismatch", "yield_strength", shift=0.5), v("incompatible_unit", "yield_strength", unit="kg"),
        v("missing_or_invalid_scientific_type", "yield_strength", unit="MPa", kind=None), v("figure_digitization_not_canonical", "yield_strength", unit="MPa", kind="figure_digitized"), v("model_prediction_in_experiment", "yield_strength", unit="MPa", kind="simulation_result"),
        v("non_model_result_in_calculation", "bulk_modulus", unit="GPa", modality="computational"), v("inconsistent_curve_data_kind", "stress", unit="MPa", curve_role="curve_point"), v("curve_point_missing_source_series_provenance", "stress", unit="MPa", **_CURVE),
        v("figure_digitization_not_canonical", "stress", unit="MPa", series_origin="figure_digitized", series_id="a", **_CURVE), v("measurement_value_not_source_evidenced", "stress", unit="MPa", ev="unverified"), v(None, "rupture_time", raw="{q} h", unit="h"),
    ],
    "additive_manufacturing": [
        v(None, "laser_power", unit="W", **_PROCESS), v(None, "tensile_strength", unit="MPa"), v("incompatible_unit", "tensile_strength", unit="kg"), v("unknown_am_property", "glow"), v("property_role_mismatch_process_parameter", "laser_power", unit="W"), v("missing_raw_value", "porosity", raw=None),
        v("no_value_specific_verbatim_evidence", "porosity", unit="%", ev="nopage"), v("invalid_or_missing_scientific_type", "porosity", unit="%", kind="x"), v("categorical_value_required", "scan_strategy", raw="island", missing=True, **_PROCESS), v(None, "scan_strategy", raw="island", missing=True, word="island", **_PROCESS),
        v("numeric_value_required", "porosity", missing=True, unit="%"), v("parsed_value_mismatch", "porosity", shift=0.5, unit="%"), v("invalid_unit_for_percent", "porosity", unit="mm"), v("invalid_normalized_unit_for_percent", "porosity", unit="%", nunit="mm"),
    ],
    "photovoltaics": [
        v(None, "fill_factor", unit="%", **_SUN), v("unknown_photovoltaics_property", "zap"), v("property_role_mismatch_process_parameter", "active_area"), v("property_not_allowed_for_experimental", "calculated_bandgap"), v("missing_raw_value", "fill_factor", raw=""), v("no_value_specific_verbatim_evidence", "fill_factor", ev="none"),
        v("numeric_value_required", "fill_factor", missing=True), v("parsed_value_mismatch", "fill_factor", shift=0.5), v("invalid_unit_for_percent", "fill_factor", unit="V"), v("invalid_normalized_unit_for_percent", "fill_factor", unit="%", nunit="V"), v("invalid_or_missing_scientific_type", "fill_factor", unit="%", kind="calculated"),
        v("missing_required_condition_irradiance", "fill_factor", unit="%", illumination_spectrum="AM1.5G"), v(None, "fill_factor", unit="%", ev="book", **_SUN),
    ],
    "thermoelectrics": [
        v(None, "zt", unit="1", derivation_basis="measured", **_DERIVED, **_K), v("invalid_thermoelectrics_modality", "zt", modality="guess"), v("unknown_thermoelectrics_property", "zap"), v("property_role_mismatch_process_parameter", "sintering_time"), v("missing_raw_value", "zt", raw=""), v("no_value_specific_verbatim_evidence", "zt", ev="none"),
        v("invalid_unit_for_dimensionless", "zt", unit="K", **_DERIVED), v("computational_output_must_be_calculated", "zt", unit="1", modality="computational"), v("invalid_or_missing_scientific_type", "zt", unit="1"), v("missing_or_invalid_temperature", "electrical_conductivity", unit="S/cm"),
        v("temperature_must_be_kelvin", "electrical_conductivity", unit="S/cm", **{**_K, "temperature_unit": "C"}), v("missing_measurement_orientation", "electrical_conductivity", unit="S/cm", temperature="3", temperature_unit="K"), v("seebeck_sign_mismatch", "seebeck_coefficient", unit="µV/K", seebeck_sign="negative", **_K),
        v("missing_or_invalid_carrier_type", "seebeck_coefficient", unit="µV/K", seebeck_sign="positive", **_K), v("absolute_seebeck_not_canonical", "seebeck_coefficient", unit="µV/K", seebeck_sign="positive", carrier_type="p-type", absolute_value="true", **_K), v("missing_derivation_basis", "zt", unit="1", **_DERIVED, **_K),
    ],
    "membranes": [
        v(None, "gas_permeance", unit="GPU", modality="gas_separation", **_GAS), v("invalid_unit_for_gas_permeance", "gas_permeance", unit="barrer", modality="gas_separation", **_GAS), v("unknown_membrane_property", "zap"), v("property_not_allowed_for_filtration", "gas_permeance", modality="filtration"),
        v("non_numeric_missing_value_token", "gas_permeance", raw="not reported", modality="gas_separation"), v("no_value_specific_verbatim_table_evidence", "gas_permeance", modality="gas_separation", ev="caption"), v("missing_required_condition_test_mode", "gas_permeance", unit="GPU", modality="gas_separation", species="N2"),
        v("ideal_selectivity_requires_pure_gas_basis", "ideal_selectivity", unit="1", modality="gas_separation", test_mode="mixed_gas", **_DERIVED, **_PAIR), v("mixed_gas_selectivity_requires_mixture_basis", "mixed_gas_selectivity", unit="1", modality="gas_separation", test_mode="pure_gas", **_PAIR),
        v("parsed_value_mismatch", "gas_permeance", unit="GPU", modality="gas_separation", shift=0.5, **_GAS), v("invalid_or_missing_scientific_type", "gas_permeance", unit="GPU", modality="gas_separation", kind="calculated", **_GAS),
    ],
    "semiconductors": [
        v(None, "band_gap", unit="eV", **_LABEL), v("unknown_or_role_mismatched_semiconductor_property", "band_gap", **_PROCESS), v("missing_or_non_numeric_source_value", "band_gap", raw="--"), v("no_page_verbatim_value_evidence", "band_gap", ev="none"), v("finite_numeric_value_required", "band_gap", missing=True),
        v("raw_numeric_value_mismatch", "band_gap", raw="{q} eV"), v("invalid_energy_unit", "band_gap", unit="nm"), v("unverified_unit_conversion", "band_gap", unit="eV", nvalue=1.0), v("incorrect_scaled_unit_conversion", "carrier_concentration", unit="×10^20 cm^-3", nvalue=1.0, nunit="cm-3"),
        v("process_scientific_type_required", "film_thickness", unit="nm", role="process_parameter"), v("computational_result_must_be_calculated", "band_gap", unit="eV", modality="computational"), v("experimental_scientific_type_required", "band_gap", unit="eV", kind="calculated"),
        v("calculated_property_in_experiment", "calculated_band_gap", unit="eV"), v("invalid_semiconductor_modality", "band_gap", unit="eV", modality="x"), v("missing_specimen_identity", "band_gap", unit="eV"), v("missing_optical_gap_derivation", "optical_band_gap", unit="eV", **_LABEL),
        v("hall_mobility_method_required", "hall_mobility", unit="cm2/V/s", **_LABEL), v("dopant_carrier_conflation", "dopant_concentration", unit="cm-3", carrier_identity="e", **_LABEL),
    ],
    "biomaterials": [
        v(None, "cell_viability", unit="%", **_CELL), v("unknown_or_role_mismatched_property", "zap"), v("finite_numeric_value_required", "cell_viability", missing=True), v("raw_numeric_value_mismatch", "cell_viability", raw="{q} %"), v("no_page_verbatim_value_evidence", "cell_viability", ev="none"), v("invalid_property_unit", "cell_viability", unit="mm"),
        v("unverified_normalization", "cell_viability", unit="%", nvalue=1.0), v("process_scientific_type_required", "layer_height", unit="mm", role="process_parameter"), v(None, "layer_height", unit="mm", **_PROCESS), v("missing_specimen_identity", "cell_viability", unit="%"), v("scientific_type_modality_mismatch", "cell_viability", unit="%", kind="calculated", **_CELL),
        v("incomplete_computational_model_context", "interaction_energy", unit="kcal/mol", modality="computational", kind="calculated", **_LABEL), v("incomplete_cell_assay_context", "cell_viability", unit="%", **_LABEL), v("incomplete_microbial_assay_context", "inhibition_zone", unit="mm", **_LABEL),
        v("missing_exposure_time", "hemolysis", unit="%", **_LABEL), v("missing_exposure_medium", "mass_loss", unit="%", exposure_time="1 d", **_LABEL),
    ],
}


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg((F.round(F.min("l_quantity")) + 100).cast("long").alias("q"))


_L = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(round(min(l_quantity)) AS BIGINT) + 100 AS q FROM lineitem GROUP BY 1, 2)"


def _evidence(raw):
    """A quotation of the raw value, with or without what a contract may ask of it."""
    kind, said = F.col("ev"), F.concat(F.lit("it was "), F.coalesce(raw, F.lit("")), F.lit(" here"))
    one = F.struct(
        F.lit("s").alias("source_id"), F.when(kind.isin("nopage", "book"), None).otherwise(3).alias("page"), F.lit(None).cast("string").alias("section"), F.lit("table").alias("source_type"),
        F.when(kind == "caption", "caption").when(kind == "book", "official_source_data_workbook").alias("original_source_type"), F.when(kind == "unverified", None).otherwise(True).alias("verbatim_match"),
        said.alias("text_snippet"), F.lit("t1").alias("table_id"), F.lit(None).cast("string").alias("figure_id"), F.lit(None).cast("string").alias("locator"), F.lit(0.9).alias("confidence"), F.lit(False).alias("estimated"),
    )
    return F.filter(F.array(one), lambda _: kind != "none")


def _measurements(t: Tables, domain: str) -> DataFrame:
    cases = CASES[domain]
    faults = t.lineitem.sparkSession.createDataFrame([(i, *fields) for i, (_, fields) in enumerate(cases)], _FIELDS)
    rows = _lines(t).withColumn("i", F.pmod(F.col("o") * 7 + F.col("n"), F.lit(len(cases))).cast("int")).join(F.broadcast(faults), "i")
    raw = F.replace("raw", F.lit("{q}"), F.col("q").cast("string"))
    conditions = F.map_filter(F.map_concat("conditions", F.create_map(F.lit("scientific_type"), "kind")), lambda _, x: x.isNotNull())
    return rows.select(
        "o", "n", "property", raw.alias("raw_value"), F.when(~F.col("missing"), F.col("q") + F.col("shift")).alias("value"), F.col("word").alias("value_text"), "unit", F.col("nvalue").alias("normalized_value"), F.col("nunit").alias("normalized_unit"),
        "method", "role", "modality", conditions.alias("conditions"), _evidence(raw).alias("evidence"),
    )


def _reasons(cases: list[tuple]) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({i}, {text(reason)})" for i, (reason, *_) in enumerate(cases))


def _register(domain: str) -> None:
    def admission(t: Tables) -> DataFrame:
        return D.admit(_measurements(t, domain), domain).select("o", "n", "property", "reason", "admitted")

    admission.__name__ = f"admission_{domain}"
    admission.__doc__ = f"Measurements of {domain}: admitted, or the first reason against each."
    names = ", ".join(f"({i}, '{fields[0]}')" for i, (_, fields) in enumerate(CASES[domain]))
    query(f"""WITH {_L}, want(i, reason) AS (VALUES {_reasons(CASES[domain])}), named(i, property) AS (VALUES {names})
SELECT o, n, property, reason, reason IS NULL AS admitted FROM l JOIN want ON i = (o * 7 + n) % {len(CASES[domain])} JOIN named USING (i)""")(admission)


for _domain in CASES:
    _register(_domain)


def _case(t: Tables, cases: list[tuple], base: dict, kinds: str) -> DataFrame:
    """Lines with the fields of ``base``, changed by the line's case; fields are given as JSON and read with their types."""
    rows = [(i, json.dumps({**base, **changes})) for i, (_, changes) in enumerate(cases)]
    faults = t.lineitem.sparkSession.createDataFrame(rows, "i int, fields string").select("i", F.from_json("fields", kinds).alias("f"))
    return _lines(t).withColumn("i", F.pmod(F.col("o") * 5 + F.col("n"), F.lit(len(cases))).cast("int")).join(F.broadcast(faults), "i").select("o", "n", "q", "f.*")


def _case_sql(cases: list[tuple]) -> str:
    return f"WITH {_L}, want(i, reason) AS (VALUES {_reasons(cases)}) SELECT o, n, reason FROM l JOIN want ON i = (o * 5 + n) % {len(cases)}"


_CATALYSIS_BASE = {"property": "conversion", "unit": "%", "shift": -100, "scope_status": "supported", "ownership": "focal_work", "derived": False, "unresolved_conflict": False, "semantic_invalid": False, "reactant": "CO", "ev": "own"}
_CATALYSIS_KINDS = "property string, unit string, shift long, scope_status string, ownership string, derived boolean, unresolved_conflict boolean, semantic_invalid boolean, product string, reactant string, normalization_kind string, potential_reference string, ev string"
CATALYSIS = [
    (None, {}), ("unsupported_v1_subtype", {"scope_status": "review"}), ("ownership_prior_work", {"ownership": "prior_work"}), ("derived_value_not_reported", {"derived": True}), ("condition_conflict", {"unresolved_conflict": True}), ("schema_invalid", {"semantic_invalid": True}),
    ("schema_invalid", {"shift": 0}), ("missing_product", {"property": "selectivity"}), (None, {"property": "selectivity", "product": "CO2"}), ("schema_invalid", {"reactant": None}), ("normalization_basis_unknown", {"property": "reaction_rate", "unit": "mol"}),
    ("incompatible_unit_basis", {"property": "turnover_frequency", "unit": "1/s", "normalization_kind": "catalyst_mass"}), (None, {"property": "turnover_frequency", "unit": "1/s", "normalization_kind": "site_count"}), ("missing_potential_reference", {"property": "onset_potential", "unit": "V"}),
    ("missing_potential_reference", {"potential_reference": "unknown"}), (None, {"property": "onset_potential", "unit": "V", "potential_reference": "RHE"}), ("estimated_digitized", {"ev": "digitized"}), ("unsupported_visual_origin", {"ev": "caption"}), ("unsupported_visual_origin", {"ev": "plain"}), ("no_value_specific_evidence", {"ev": "other"}),
]


@query(_case_sql(CATALYSIS))
def admission_catalysis(t: Tables):
    """Measurements of catalysis, with every reason of their contract."""
    rows = _case(t, CATALYSIS, _CATALYSIS_BASE, _CATALYSIS_KINDS)
    value = F.col("q") + F.col("shift")
    said = F.concat(F.lit("it was "), F.when(F.col("ev") == "other", "nothing").otherwise(value.cast("string")), F.lit(" here"))
    origin = F.when(F.col("ev") == "digitized", "figure_digitized").when(F.col("ev") == "caption", "microscopy").when(F.col("ev") != "plain", "native_text")
    evidence = F.array(F.struct(F.lit("text").alias("source_type"), origin.alias("original_source_type"), F.lit(True).alias("verbatim_match"), said.alias("text_snippet"), F.lit(False).alias("estimated")))
    rows = rows.withColumns({"raw_value": value.cast("string"), "value": value.cast("double"), "evidence": evidence})
    return rows.withColumn("reason", D.catalysis()).select("o", "n", "reason")


_CORROSION_BASE = {"property": "corrosion_rate", "unit": "mm/year", "raw": True, "missing": False, "ownership": "focal_work", "data_kind": "derived_metric", "scope_status": "supported", "experiment_type": "weight_loss", "treatment_present": True, "unresolved_conflict": False, "condition_properties": ["exposure_time", "medium"], "ev": "own"}
_CORROSION_KINDS = "property string, unit string, raw boolean, missing boolean, ownership string, data_kind string, scope_status string, experiment_type string, reference_electrode string, equivalent_circuit string, treatment_present boolean, unresolved_conflict boolean, condition_properties array<string>, ev string"
CORROSION = [
    (None, {}), ("unsupported_scope", {"scope_status": "x"}), ("ownership_unknown", {"ownership": "unknown"}), ("non_numeric_or_unparsed_value", {"missing": True}), ("missing_raw_value", {"raw": False}), ("unresolved_condition_conflict", {"unresolved_conflict": True}), ("no_verified_value_specific_evidence", {"ev": "unverified"}),
    ("missing_reference_electrode", {"property": "pitting_potential", "unit": "V"}), ("eis_metric_outside_eis_experiment", {"property": "charge_transfer_resistance", "unit": "ohm cm2"}), ("polarization_resistance_misclassified_as_eis", {"property": "polarization_resistance", "unit": "ohm cm2", "experiment_type": "eis"}),
    ("missing_equivalent_circuit_context", {"property": "charge_transfer_resistance", "unit": "ohm cm2", "experiment_type": "eis", "data_kind": "fitted_parameter"}), ("missing_linked_treatment", {"property": "inhibition_efficiency", "unit": "%", "treatment_present": False}),
    ("invalid_gravimetric_data_kind", {"property": "mass_loss", "unit": "mg"}), ("invalid_gravimetric_data_kind", {"data_kind": "reported_measurement"}), ("missing_exposure_time", {"condition_properties": ["medium"]}), ("missing_environment_context", {"condition_properties": ["exposure_time"]}),
]


@query(_case_sql(CORROSION))
def admission_corrosion(t: Tables):
    """Measurements of corrosion, with every reason of their contract."""
    rows = _case(t, CORROSION, _CORROSION_BASE, _CORROSION_KINDS)
    evidence = F.array(F.struct((F.col("ev") == "own").alias("verbatim_match"), F.lit("text").alias("source_type"), F.lit("native_text").alias("original_source_type"), F.concat(F.lit("it was "), "q").alias("text_snippet")))
    rows = rows.withColumns({"raw_value": F.when(F.col("raw"), F.col("q").cast("string")), "value": F.when(~F.col("missing"), F.col("q").cast("double")), "evidence": evidence})
    return rows.withColumn("reason", D.corrosion()).select("o", "n", "reason")


def _stack(*roles: str, start: int = 0, **more) -> list[dict]:
    return [{"sequence_index": start + i, "role": r, "thickness_property": None, "verified": True, **more} for i, r in enumerate(roles)]


_DEVICE = "device_type string, configuration map<string,string>, layer_stack array<struct<sequence_index int, role string, thickness_property string, verified boolean>>"
_FILTER, _WAFER = {"device_type": "membrane_specimen", "configuration": {"membrane_modality": "filtration"}}, {"device_type": "semiconductor_wafer", "configuration": {"sample_label": "S"}, "layer_stack": []}
_GEL = {"device_type": "biomaterial_hydrogel", "configuration": {"sample_label": "S"}, "layer_stack": _stack("bulk_formulation")}
_CELLS = {"device_type": "solar_cell", "configuration": {}, "layer_stack": _stack("etl", "absorber")}
DEVICES = {
    "photovoltaic_device": (_CELLS, [
        (None, {}), ("invalid_photovoltaic_device_type", {"device_type": "led"}), ("missing_layer_stack", {"layer_stack": []}), ("noncontiguous_layer_sequence", {"layer_stack": _stack("etl", "absorber", start=1)}), ("unknown_layer_role", {"layer_stack": _stack("etl", "magic")}),
        ("missing_absorber_layer", {"layer_stack": _stack("etl", "htl")}), (None, {"layer_stack": _stack("ETL", "Absorber")}),
    ]),
    "membrane_device": ({**_FILTER, "layer_stack": _stack("support", "selective_layer")}, [
        (None, {}), ("invalid_membrane_device_type", {"device_type": "x"}), ("missing_or_invalid_membrane_modality", {"configuration": {}}), ("missing_membrane_architecture", {"layer_stack": []}), ("noncontiguous_or_duplicate_layer_sequence", {"layer_stack": _stack("support") + _stack("selective_layer")}),
        ("unknown_membrane_layer_role", {"layer_stack": _stack("glue")}), ("missing_separating_layer", {"layer_stack": _stack("support")}),
        ("multilayer_composite_missing_support_or_selective_layer", {"configuration": {"membrane_modality": "filtration", "architecture_type": "multilayer_composite"}, "layer_stack": _stack("membrane_body")}),
        ("thickness_scope_role_mismatch", {"layer_stack": _stack("selective_layer", thickness_property="support_thickness")}),
    ]),
    "semiconductor_device": (_WAFER, [
        (None, {}), ("unrecognized_semiconductor_specimen_type", {"device_type": "x"}), ("film_and_substrate_layers_required", {"device_type": "semiconductor_thin_film", "layer_stack": _stack("semiconductor_film")}), ("sample_label_required", {"configuration": {}}),
        ("layer_source_evidence_required", {"layer_stack": _stack("substrate", verified=False)}), (None, {"device_type": "semiconductor_thin_film", "layer_stack": _stack("substrate", "semiconductor_film")}),
    ]),
    "biomaterial_device": (_GEL, [
        (None, {}), ("unrecognized_biomaterial_specimen_type", {"device_type": "x"}), ("missing_specimen_label", {"configuration": {}}), ("exactly_one_bulk_formulation_required", {"layer_stack": _stack("bulk_formulation", "bulk_formulation")}),
        ("exactly_one_bulk_formulation_required", {"layer_stack": _stack("coating")}), ("formulation_evidence_required", {"layer_stack": _stack("bulk_formulation", verified=False)}),
    ]),
}


def _register_device(name: str) -> None:
    base, cases = DEVICES[name]

    def admission(t: Tables) -> DataFrame:
        return _case(t, cases, base, _DEVICE).withColumn("reason", getattr(D, name)()).select("o", "n", "reason")

    admission.__name__ = f"admission_{name}"
    admission.__doc__ = "Specimens with every reason of their contract."
    query(_case_sql(cases))(admission)


for _name in DEVICES:
    _register_device(_name)

_GATE_KINDS = "ownership string, derived boolean, verified boolean, items int"
GATES = [(None, {}), ("ownership_prior_work", {"ownership": "prior_work"}), ("no_source_evidence", {"items": 0}), ("derived_value_not_reported", {"derived": True}), ("no_verbatim_evidence", {"verified": False})]


@query(f"""WITH {_L}, want(i, record, battery) AS (VALUES (0, NULL, NULL), (1, 'ownership_prior_work', 'ownership_prior_work'), (2, 'no_source_evidence', 'no_verbatim_evidence'), (3, NULL, 'derived_value_not_reported'), (4, NULL, 'no_verbatim_evidence'))
SELECT o, n, record, battery FROM l JOIN want ON i = (o * 5 + n) % 5""")
def admission_gates(t: Tables):
    """The gates of records and of batteries, over the same rows."""
    rows = _case(t, GATES, {"ownership": "focal_work", "derived": False, "verified": True, "items": 1}, _GATE_KINDS)
    rows = rows.withColumn("evidence", F.filter(F.array(F.struct(F.col("verified").alias("verbatim_match"))), lambda _: F.col("items") > 0))
    return rows.select("o", "n", D.record_gate().alias("record"), D.battery_gate().alias("battery"))


_PLOT = {"geometry": "line", "width": 400, "height": 300, "calibration_states": ["verified", "user_confirmed"], "diagnostic": False, "series_colors": [[200, 10, 10]], "grayscale_selected": False, "pixel_x": 1.0, "pixel_y": 1.0}
_PLOT_KINDS = "geometry string, width int, height int, calibration_states array<string>, diagnostic boolean, series_colors array<array<int>>, grayscale_selected boolean, pixel_x double, pixel_y double"
PLOTS = [
    ("", {}), ("unsupported_geometry:polar", {"geometry": "polar"}), ("plot_resolution_too_low", {"width": 79}), ("calibration_ambiguous_or_failed,calibration_not_user_confirmed", {"calibration_states": ["failed"]}), ("calibration_not_user_confirmed", {"calibration_states": ["detected"]}), ("", {"calibration_states": ["detected"], "diagnostic": True}),
    ("no_explicit_color_series_selected", {"series_colors": []}), ("series_color_selection_required", {"series_colors": [None]}), ("series_colors_not_separable", {"series_colors": [[200, 10, 10], [200, 10, 10]]}), ("ambiguous_grayscale_multi_series", {"series_colors": [[10, 10, 10], [200, 10, 10]]}),
    ("grayscale_series_requires_user_selected_target", {"series_colors": [[10, 12, 20]]}), ("", {"series_colors": [[10, 12, 20]], "grayscale_selected": True}), ("plot_resolution_too_low,line_or_calibration_uncertainty_too_high", {"height": 10, "pixel_y": 9.0}),
]


@query(_case_sql(PLOTS))
def digitization_refusals(t: Tables):
    """Every reason to refuse a plot; they add up."""
    return _case(t, PLOTS, _PLOT, _PLOT_KINDS).select("o", "n", F.array_join(D.digitization_reasons(), ",").alias("reason"))


FAILURES = [
    ("timeout", {"error_name": "ReadTimeout", "message": "429"}), ("provider_rate_limited", {"message": "HTTP 429"}), ("provider_rate_limited", {"error_name": "RateLimitError"}), ("provider_authentication", {"error_name": "AuthError"}), ("provider_authentication", {"message": "got 403"}),
    ("provider_invalid_request", {"error_name": "InvalidRequest"}), ("provider_transient_unavailable", {"message": "503"}), ("schema_invalid", {"error_name": "ValidationError"}), ("scientific_admission_failure", {"error_name": "AdmissionError"}), ("archive_failure", {"error_name": "ArchiveError"}),
    ("storage_failure", {"error_name": "FileNotFoundError"}), ("unknown_internal_failure", {}),
]


@query(_case_sql(FAILURES))
def failures_by_class(t: Tables):
    """Failures by the first class that their name or message fits."""
    return _case(t, FAILURES, {"error_name": "Boom", "message": "none"}, "error_name string, message string").withColumn("reason", D.failure_class()).select("o", "n", "reason")
