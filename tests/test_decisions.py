"""Each admission reason is reached by one row; the first of several wins."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import decisions
from assaylake.schema import EVIDENCE

ROW = f"""property string, raw_value string, value double, value_text string, unit string, normalized_value double, normalized_unit string,
method string, role string, modality string, conditions map<string,string>, evidence array<{EVIDENCE}>"""


def evidence(raw, **more):
    e = {"source_id": "s", "page": 3, "section": None, "source_type": "table", "original_source_type": None, "verbatim_match": True, "text_snippet": f"it was {raw} here", "table_id": "t1", "figure_id": None, "locator": None, "confidence": 0.9}
    return {**e, **more}


def row(prop, raw="350", value=350.0, unit=None, role="result", modality="experimental", kind="reported_measurement", ev=None, **more):
    known = {"value_text": None, "normalized_value": None, "normalized_unit": None, "method": None}
    conditions = {k: v for k, v in {"scientific_type": kind, **more.pop("conditions", {})}.items() if v is not None}
    known.update(more)
    ev = [evidence(raw)] if ev is None else ev
    return (prop, raw, value, known["value_text"], unit, known["normalized_value"], known["normalized_unit"], known["method"], role, modality, conditions, ev)


K = {"temperature": "300", "temperature_unit": "K", "measurement_orientation": "in-plane"}
SUN = {"illumination_spectrum": "AM1.5G", "irradiance": "100"}
GAS = {"species": "CO2", "test_mode": "pure_gas", "temperature": "35", "temperature_unit": "C", "pressure_kind": "feed"}
PROC = {"role": "process_parameter", "kind": "reported_process_parameter"}
CELL = {"sample_label": "S1", "cell_line": "L929", "assay": "MTT", "exposure_time": "24 h"}

CASES = {
    "mechanical": [
        (row("yield_strength", unit="MPa"), None), (row("hardness"), "ambiguous_hardness_scale"), (row("colour"), "unknown_mechanical_property"), (row("yield_strength", value=None), "non_numeric_value"), (row("yield_strength", raw=""), "missing_raw_value"),
        (row("yield_strength", raw="n/a"), "explicit_missing_source_value"), (row("yield_strength", raw="high"), "raw_value_not_numeric"), (row("yield_strength", raw="351"), "parsed_value_mismatch"), (row("yield_strength", unit="kg"), "incompatible_unit"),
        (row("yield_strength", unit="MPa", kind=None), "missing_or_invalid_scientific_type"), (row("yield_strength", unit="MPa", kind="figure_digitized"), "figure_digitization_not_canonical"), (row("yield_strength", unit="MPa", kind="simulation_result"), "model_prediction_in_experiment"),
        (row("bulk_modulus", unit="GPa", modality="computational"), "non_model_result_in_calculation"), (row("stress", unit="MPa", conditions={"curve_role": "curve_point"}), "inconsistent_curve_data_kind"),
        (row("stress", unit="MPa", conditions={"curve_role": "curve_point", "data_kind": "series_point"}), "curve_point_missing_source_series_provenance"),
        (row("stress", unit="MPa", conditions={"curve_role": "curve_point", "data_kind": "series_point", "series_origin": "figure_digitized", "series_id": "a"}), "figure_digitization_not_canonical"),
        (row("stress", unit="MPa", ev=[evidence("350", verbatim_match=None)]), "measurement_value_not_source_evidenced"), (row("rupture_time", raw="1,250 h", value=1250.0, unit="h"), None), (row("creep_rate", raw="3.2 × 10^-9", value=3.2e-9, unit="1/s"), None),
    ],
    "additive_manufacturing": [
        (row("laser_power", unit="W", **PROC), None), (row("tensile_strength", unit="MPa"), None), (row("tensile_strength", unit="kg"), "incompatible_unit"), (row("glow"), "unknown_am_property"), (row("laser_power", unit="W"), "property_role_mismatch_process_parameter"),
        (row("porosity", raw=None), "missing_raw_value"), (row("porosity", unit="%", ev=[evidence("350", page=None)]), "no_value_specific_verbatim_evidence"), (row("porosity", unit="%", kind="x"), "invalid_or_missing_scientific_type"),
        (row("scan_strategy", raw="island", value=None, **PROC), "categorical_value_required"), (row("scan_strategy", raw="island", value=None, value_text="island", **PROC), None), (row("porosity", value=None, unit="%"), "numeric_value_required"),
        (row("porosity", value=3.0, unit="%"), "parsed_value_mismatch"), (row("porosity", unit="mm"), "invalid_unit_for_percent"), (row("porosity", unit="%", normalized_unit="mm"), "invalid_normalized_unit_for_percent"),
        (row("post_process_time", raw="one hour", value=1.0, unit="h", **PROC), None),
    ],
    "photovoltaics": [
        (row("fill_factor", unit="%", conditions=SUN), None), (row("zap"), "unknown_photovoltaics_property"), (row("active_area"), "property_role_mismatch_process_parameter"), (row("calculated_bandgap"), "property_not_allowed_for_experimental"),
        (row("fill_factor", raw=""), "missing_raw_value"), (row("fill_factor", ev=[]), "no_value_specific_verbatim_evidence"), (row("fill_factor", value=None), "numeric_value_required"), (row("fill_factor", value=1.0), "parsed_value_mismatch"),
        (row("fill_factor", unit="V"), "invalid_unit_for_percent"), (row("fill_factor", unit="%", normalized_unit="V"), "invalid_normalized_unit_for_percent"), (row("fill_factor", unit="%", kind="calculated"), "invalid_or_missing_scientific_type"),
        (row("fill_factor", unit="%", conditions={"illumination_spectrum": "AM1.5G"}), "missing_required_condition_irradiance"), (row("fill_factor", unit="%", conditions=SUN, ev=[evidence("350", page=None, original_source_type="official_source_data_workbook")]), None),
    ],
    "thermoelectrics": [
        (row("zt", unit="1", kind="reported_derived_metric", conditions={**K, "derivation_basis": "measured"}), None), (row("zt", modality="guess"), "invalid_thermoelectrics_modality"), (row("zap"), "unknown_thermoelectrics_property"),
        (row("sintering_time"), "property_role_mismatch_process_parameter"), (row("zt", raw=""), "missing_raw_value"), (row("zt", ev=[]), "no_value_specific_verbatim_evidence"), (row("zt", unit="K", kind="reported_derived_metric"), "invalid_unit_for_dimensionless"),
        (row("zt", unit="1", modality="computational"), "computational_output_must_be_calculated"), (row("zt", unit="1"), "invalid_or_missing_scientific_type"), (row("electrical_conductivity", unit="S/cm"), "missing_or_invalid_temperature"),
        (row("electrical_conductivity", unit="S/cm", conditions={**K, "temperature_unit": "C"}), "temperature_must_be_kelvin"), (row("electrical_conductivity", unit="S/cm", conditions={"temperature": "3", "temperature_unit": "K"}), "missing_measurement_orientation"),
        (row("seebeck_coefficient", unit="µV/K", conditions={**K, "seebeck_sign": "negative"}), "seebeck_sign_mismatch"), (row("seebeck_coefficient", unit="µV/K", conditions={**K, "seebeck_sign": "positive"}), "missing_or_invalid_carrier_type"),
        (row("seebeck_coefficient", unit="µV/K", conditions={**K, "seebeck_sign": "positive", "carrier_type": "p-type", "absolute_value": "true"}), "absolute_seebeck_not_canonical"), (row("zt", unit="1", kind="reported_derived_metric", conditions=K), "missing_derivation_basis"),
    ],
    "membranes": [
        (row("gas_permeance", unit="GPU", modality="gas_separation", conditions=GAS), None), (row("gas_permeance", unit="barrer", modality="gas_separation", conditions=GAS), "invalid_unit_for_gas_permeance"), (row("zap"), "unknown_membrane_property"),
        (row("gas_permeance", modality="filtration"), "property_not_allowed_for_filtration"), (row("gas_permeance", raw="not reported", modality="gas_separation"), "non_numeric_missing_value_token"), (row("gas_permeance", modality="gas_separation", ev=[evidence("350", original_source_type="caption")]), "no_value_specific_verbatim_table_evidence"),
        (row("gas_permeance", unit="GPU", modality="gas_separation", conditions={"species": "N2"}), "missing_required_condition_test_mode"),
        (row("ideal_selectivity", unit="1", modality="gas_separation", kind="reported_derived_metric", conditions={"species_pair": "a/b", "test_mode": "mixed_gas", "temperature": "3", "temperature_unit": "C"}), "ideal_selectivity_requires_pure_gas_basis"),
        (row("mixed_gas_selectivity", unit="1", modality="gas_separation", conditions={"species_pair": "a/b", "test_mode": "pure_gas", "temperature": "3", "temperature_unit": "C"}), "mixed_gas_selectivity_requires_mixture_basis"),
    ],
    "semiconductors": [
        (row("band_gap", raw="3.4", value=3.4, unit="eV", conditions={"sample_label": "S"}), None), (row("band_gap", **{**PROC}), "unknown_or_role_mismatched_semiconductor_property"), (row("band_gap", raw="--"), "missing_or_non_numeric_source_value"),
        (row("band_gap", ev=[]), "no_page_verbatim_value_evidence"), (row("band_gap", value=None), "finite_numeric_value_required"), (row("band_gap", raw="3.4 eV", value=3.4), "raw_numeric_value_mismatch"), (row("band_gap", unit="nm"), "invalid_energy_unit"),
        (row("band_gap", unit="eV", normalized_value=1.0), "unverified_unit_conversion"), (row("carrier_concentration", unit="×10^20 cm^-3", normalized_value=1.0, normalized_unit="cm-3"), "incorrect_scaled_unit_conversion"),
        (row("carrier_concentration", raw="2", value=2.0, unit="x10^20 cm-3", normalized_value=2e20, normalized_unit="cm-3", conditions={"sample_label": "S"}), None), (row("film_thickness", unit="nm", role="process_parameter"), "process_scientific_type_required"),
        (row("band_gap", unit="eV", modality="computational"), "computational_result_must_be_calculated"), (row("band_gap", unit="eV", kind="calculated"), "experimental_scientific_type_required"), (row("calculated_band_gap", unit="eV"), "calculated_property_in_experiment"),
        (row("band_gap", unit="eV", modality="x"), "invalid_semiconductor_modality"), (row("band_gap", unit="eV"), "missing_specimen_identity"), (row("optical_band_gap", unit="eV", conditions={"sample_label": "S"}), "missing_optical_gap_derivation"),
        (row("hall_mobility", unit="cm2/V/s", conditions={"sample_label": "S"}), "hall_mobility_method_required"), (row("dopant_concentration", unit="cm-3", conditions={"sample_label": "S", "carrier_identity": "e"}), "dopant_carrier_conflation"),
    ],
    "biomaterials": [
        (row("cell_viability", unit="%", conditions=CELL), None), (row("zap"), "unknown_or_role_mismatched_property"), (row("cell_viability", value=None), "finite_numeric_value_required"), (row("cell_viability", raw="350 %"), "raw_numeric_value_mismatch"),
        (row("cell_viability", ev=[]), "no_page_verbatim_value_evidence"), (row("cell_viability", unit="mm"), "invalid_property_unit"), (row("cell_viability", unit="%", normalized_value=1.0), "unverified_normalization"),
        (row("layer_height", unit="mm", role="process_parameter"), "process_scientific_type_required"), (row("layer_height", unit="mm", **PROC), None), (row("cell_viability", unit="%"), "missing_specimen_identity"),
        (row("cell_viability", unit="%", kind="calculated", conditions=CELL), "scientific_type_modality_mismatch"), (row("interaction_energy", unit="kcal/mol", modality="computational", kind="calculated", conditions={"sample_label": "S"}), "incomplete_computational_model_context"),
        (row("cell_viability", unit="%", conditions={"sample_label": "S"}), "incomplete_cell_assay_context"), (row("inhibition_zone", unit="mm", conditions={"sample_label": "S"}), "incomplete_microbial_assay_context"),
        (row("hemolysis", unit="%", conditions={"sample_label": "S"}), "missing_exposure_time"), (row("mass_loss", unit="%", conditions={"sample_label": "S", "exposure_time": "1 d"}), "missing_exposure_medium"),
    ],
}


@pytest.mark.parametrize("domain", sorted(CASES))
def test_reasons(spark, domain):
    rows = [r for r, _ in CASES[domain]]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ROW}")
    got = decisions.admit(table, domain).orderBy("i").select("property", "reason", "admitted").collect()
    assert [(r.property, r.reason) for r in got] == [(r[0], why) for r, why in CASES[domain]]
    good, held = decisions.split_admitted(decisions.admit(table, domain))
    assert good.count() + held.count() == len(rows) and held.filter("reason is null").isEmpty()


LAYER = "array<struct<sequence_index int, role string, thickness_property string, verified boolean>>"


def test_devices(spark):
    def reasons(decision, *rows):
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, device_type string, configuration map<string,string>, layer_stack {LAYER}")
        return [r.reason for r in table.withColumn("reason", decision).orderBy("i").collect()]

    stack = lambda *roles, start=0: [(start + i, r, None, True) for i, r in enumerate(roles)]
    got = reasons(decisions.photovoltaic_device(), ("led", {}, []), ("solar_cell", {}, []), ("solar_cell", {}, stack("etl", "absorber", start=1)), ("solar_cell", {}, stack("etl", "magic")), ("solar_cell", {}, stack("etl", "htl")), ("solar_cell", {}, stack("ETL", "Absorber")))
    assert got == ["invalid_photovoltaic_device_type", "missing_layer_stack", "noncontiguous_layer_sequence", "unknown_layer_role", "missing_absorber_layer", None]
    gas = {"membrane_modality": "gas_separation"}
    got = reasons(
        decisions.membrane_device(), ("x", gas, []), ("membrane_specimen", {}, []), ("membrane_specimen", gas, []), ("membrane_specimen", gas, stack("support", start=2)), ("membrane_specimen", gas, stack("magic")), ("membrane_specimen", gas, stack("support")),
        ("membrane_specimen", {**gas, "architecture_type": "multilayer_composite"}, stack("selective_layer")), ("membrane_specimen", gas, [(0, "membrane_body", "support_thickness", True)]), ("membrane_specimen", gas, stack("membrane_body")),
    )
    assert got == ["invalid_membrane_device_type", "missing_or_invalid_membrane_modality", "missing_membrane_architecture", "noncontiguous_or_duplicate_layer_sequence", "unknown_membrane_layer_role", "missing_separating_layer", "multilayer_composite_missing_support_or_selective_layer", "thickness_scope_role_mismatch", None]
    label = {"sample_label": "S"}
    got = reasons(decisions.semiconductor_device(), ("x", label, []), ("semiconductor_thin_film", label, stack("substrate")), ("semiconductor_wafer", {}, stack("bulk")), ("semiconductor_wafer", label, [(0, "bulk", None, False)]), ("semiconductor_thin_film", label, stack("substrate", "semiconductor_film")))
    assert got == ["unrecognized_semiconductor_specimen_type", "film_and_substrate_layers_required", "sample_label_required", "layer_source_evidence_required", None]
    got = reasons(decisions.biomaterial_device(), ("x", label, []), ("biomaterial_scaffold", {}, []), ("biomaterial_scaffold", label, stack("a", "b")), ("biomaterial_scaffold", label, [(0, "bulk_formulation", None, False)]), ("biomaterial_scaffold", label, stack("bulk_formulation")))
    assert got == ["unrecognized_biomaterial_specimen_type", "missing_specimen_label", "exactly_one_bulk_formulation_required", "formulation_evidence_required", None]


def test_conservative_scope(spark):
    t = spark.createDataFrame([("in_scope", "partial"), ("unsupported", "partial"), ("in_scope", "in_scope")], "a string, b string")
    assert [r[0] for r in t.select(decisions.most_conservative(F.col("a"), F.col("b"))).collect()] == ["partial", "unsupported", "in_scope"]


CATALYSIS = f"""property string, raw_value string, value double, unit string, evidence array<{EVIDENCE}>, ownership string, scope_status string, product string, reactant string,
normalization_kind string, potential_reference string, derived boolean, unresolved_conflict boolean, semantic_invalid boolean"""
CORROSION = f"""property string, raw_value string, value double, unit string, evidence array<{EVIDENCE}>, ownership string, data_kind string, scope_status string, experiment_type string,
reference_electrode string, equivalent_circuit string, treatment_present boolean, unresolved_conflict boolean, condition_properties array<string>"""


def test_catalysis(spark):
    base = {"property": "conversion", "raw_value": "50", "value": 50.0, "unit": "%", "evidence": [evidence("50", original_source_type="native_text")], "ownership": "focal_work", "scope_status": "supported", "product": "CO", "reactant": "CO2", "normalization_kind": "site_count", "potential_reference": "RHE", "derived": False, "unresolved_conflict": False, "semantic_invalid": False}
    cases = [
        ({}, None), ({"scope_status": "deferred_subtype", "derived": True}, "unsupported_v1_subtype"), ({"ownership": "cited_prior_work"}, "ownership_cited_prior_work"), ({"derived": True}, "derived_value_not_reported"), ({"unresolved_conflict": True}, "condition_conflict"),
        ({"semantic_invalid": True}, "schema_invalid"), ({"value": 101.0}, "schema_invalid"), ({"property": "yield", "product": None}, "missing_product"), ({"reactant": ""}, "schema_invalid"), ({"property": "activity", "normalization_kind": None}, "normalization_basis_unknown"),
        ({"property": "turnover_frequency", "normalization_kind": "mass"}, "incompatible_unit_basis"), ({"property": "onset_potential", "potential_reference": None}, "missing_potential_reference"), ({"evidence": [evidence("50", original_source_type="figure_digitized")]}, "estimated_digitized"),
        ({"evidence": [evidence("50", original_source_type="figure_reported")]}, "unsupported_visual_origin"), ({"evidence": [evidence("50")]}, "unsupported_visual_origin"), ({"evidence": [evidence("7", original_source_type="native_text")]}, "no_value_specific_evidence"),
    ]
    table = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], f"i int, {CATALYSIS}")
    assert [r.reason for r in table.withColumn("reason", decisions.catalysis()).orderBy("i").collect()] == [w for _, w in cases]


def test_corrosion(spark):
    base = {"property": "corrosion_rate", "raw_value": "0.1", "value": 0.1, "unit": "mm/y", "evidence": [evidence("0.1")], "ownership": "focal_work", "data_kind": "derived_metric", "scope_status": "supported", "experiment_type": "weight_loss", "reference_electrode": "SCE", "equivalent_circuit": None, "treatment_present": True, "unresolved_conflict": False, "condition_properties": ["exposure_time", "medium"]}
    cases = [
        ({}, None), ({"scope_status": "x"}, "unsupported_scope"), ({"ownership": "unknown"}, "ownership_unknown"), ({"value": None}, "non_numeric_or_unparsed_value"), ({"raw_value": " "}, "missing_raw_value"), ({"unresolved_conflict": True}, "unresolved_condition_conflict"),
        ({"evidence": [evidence("0.1", original_source_type="figure_reported")]}, "no_verified_value_specific_evidence"), ({"property": "pitting_potential", "reference_electrode": None}, "missing_reference_electrode"), ({"property": "cpe_exponent"}, "eis_metric_outside_eis_experiment"),
        ({"property": "polarization_resistance", "experiment_type": "eis"}, "polarization_resistance_misclassified_as_eis"), ({"data_kind": "fitted_parameter"}, "missing_equivalent_circuit_context"), ({"unit": "%"}, "incompatible_gravimetric_unit_category"),
        ({"property": "inhibition_efficiency", "unit": "%", "treatment_present": False}, "missing_linked_treatment"), ({"property": "mass_loss", "unit": "mg"}, "invalid_gravimetric_data_kind"), ({"data_kind": "reported_measurement"}, "invalid_gravimetric_data_kind"),
        ({"condition_properties": ["medium"]}, "missing_exposure_time"), ({"condition_properties": ["exposure_time"]}, "missing_environment_context"),
    ]
    table = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], f"i int, {CORROSION}")
    assert [r.reason for r in table.withColumn("reason", decisions.corrosion()).orderBy("i").collect()] == [w for _, w in cases]


def test_accumulated_and_ordered_classes(spark):
    t = spark.createDataFrame(
        [("xy", 100, 100, ["verified"], False, [[255, 0, 0]], False, 1.0, 1.0), ("polar", 10, 100, ["failed"], False, [], False, 9.0, 1.0), ("xy", 90, 90, ["verified"], False, [[9, 9, 9], [9, 9, 9]], False, 1.0, 1.0)],
        "geometry string, width int, height int, calibration_states array<string>, diagnostic boolean, series_colors array<array<int>>, grayscale_selected boolean, pixel_x double, pixel_y double",
    )
    assert [r[0] for r in t.select(decisions.digitization_reasons()).collect()] == [
        [], ["unsupported_geometry:polar", "plot_resolution_too_low", "calibration_ambiguous_or_failed", "calibration_not_user_confirmed", "no_explicit_color_series_selected", "line_or_calibration_uncertainty_too_high"],
        ["series_colors_not_separable", "ambiguous_grayscale_multi_series"],
    ]
    t = spark.createDataFrame([("ReadTimeout", "429"), ("X", "HTTP 429"), ("AuthError", ""), ("X", "400"), ("ServiceUnavailable", ""), ("ValidationError", ""), ("ArchiveError", ""), ("OSError", ""), ("X", "y")], "error_name string, message string")
    assert [r[0] for r in t.select(decisions.failure_class()).collect()] == ["timeout", "provider_rate_limited", "provider_authentication", "provider_invalid_request", "provider_transient_unavailable", "schema_invalid", "archive_failure", "storage_failure", "unknown_internal_failure"]
