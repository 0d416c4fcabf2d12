"""Admission decisions: for each measurement the first reason that speaks against it, null if none.

A decision is one Column over a table of measurements with the columns property, raw_value,
value (double), value_text, unit, normalized_value (double), normalized_unit, method, role, modality,
conditions (map of texts) and evidence (array). Order is part of the contract: rules are lists, and
the ladder takes the first that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import is_missing
from . import frames as O
from . import specs as S
from .evidence import value_supported

_PRINTED = ("text", "table", "supplementary")
c = F.col


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _units(table: dict[str, list[str]], family: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), family)


def _given(name: str) -> Column:
    return F.length(F.coalesce(F.try_element_at("conditions", F.lit(name)), F.lit(""))) > 0


def _condition(name: str) -> Column:
    return F.try_element_at("conditions", F.lit(name))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _bad_unit(unit: Column, allowed: Column, dialect: str) -> Column:
    return ~F.coalesce(F.array_contains(allowed, N.unit_key(unit, dialect)), F.lit(False))


def _first_missing(required: dict[str, tuple[str, ...]]) -> Column:
    """The property's first required condition that is not given, null if all are."""
    out = F.lit(None).cast("string")
    for prop, names in required.items():
        if names:
            out = F.when(c("property") == prop, F.coalesce(*(F.when(~_given(n), F.lit(n)) for n in names), F.lit(None).cast("string"))).otherwise(out)
    return out


def record_gate() -> Column:
    """Records of others, or without evidence, are not admitted."""
    return O.ladder([(c("ownership") != "focal_work", F.concat(F.lit("ownership_"), c("ownership"))), (F.size("evidence") == 0, "no_source_evidence")])


def mechanical() -> Column:
    family, kind, role, modality = _lookup(S.MECHANICAL, c("property")), _condition("scientific_type"), _condition("curve_role"), c("modality")
    value = F.when(_finite(c("normalized_value")), c("normalized_value")).otherwise(c("value"))
    allowed = _units(S.MECHANICAL_UNITS, family)
    known = kind.isin("reported_measurement", "reported_derived_metric", "model_prediction", "simulation_result", "figure_digitized")
    model = kind.isin("model_prediction", "simulation_result")
    curve, series = F.coalesce(role, F.lit("scalar")) == "curve_point", F.coalesce(_condition("data_kind"), F.lit("scalar")) == "series_point"
    return O.ladder([
        (c("property") == "hardness", "ambiguous_hardness_scale"), (family.isNull(), "unknown_mechanical_property"), (~_finite(value), "non_numeric_value"),
        (F.length(F.coalesce(c("raw_value"), F.lit(""))) == 0, "missing_raw_value"), (is_missing(c("raw_value")) | (c("value").isNull() & c("value_text").isNotNull() & is_missing(c("value_text"))), "explicit_missing_source_value"),
        (F.size(N.reported_numbers(c("raw_value"))) == 0, "raw_value_not_numeric"), (_finite(c("value")) & ~N.supports_value(c("raw_value"), c("value")), "parsed_value_mismatch"),
        ((c("unit").isNotNull() | c("normalized_unit").isNull()) & _bad_unit(c("unit"), allowed, "mechanical") | c("normalized_unit").isNotNull() & _bad_unit(c("normalized_unit"), allowed, "mechanical"), "incompatible_unit"),
        (~F.coalesce(known, F.lit(False)), "missing_or_invalid_scientific_type"), (kind == "figure_digitized", "figure_digitization_not_canonical"), ((modality == "experimental") & model, "model_prediction_in_experiment"),
        ((modality == "computational") & ~model, "non_model_result_in_calculation"), (curve != series, "inconsistent_curve_data_kind"), (curve & ~(_given("series_origin") & _given("series_id")), "curve_point_missing_source_series_provenance"),
        (curve & (_condition("series_origin") == "figure_digitized"), "figure_digitization_not_canonical"), (~value_supported(c("evidence"), c("raw_value")), "measurement_value_not_source_evidenced"),
    ])


def _type_allowed(process: tuple[str, ...], computational: tuple[str, ...], experimental: tuple[str, ...]) -> Column:
    kind = F.coalesce(_condition("scientific_type"), F.lit(""))
    return F.when(c("role") == "process_parameter", kind.isin(*process)).when(c("modality") == "computational", kind.isin(*computational)).otherwise(kind.isin(*experimental))


def additive_manufacturing() -> Column:
    own_role, family = _lookup({k: v[0] for k, v in S.ADDITIVE.items()}, c("property")), _lookup({k: v[1] for k, v in S.ADDITIVE.items()}, c("property"))
    allowed, word = _units(S.ADDITIVE_UNITS, family), family == "categorical"
    types = _type_allowed(("reported_process_parameter", "reported_derived_metric"), ("model_prediction", "simulation_result"), ("reported_measurement", "reported_derived_metric"))
    spelled = (c("value") == 1.0) & F.lower(F.trim(c("raw_value"))).isin("one", "one hour", "an hour")
    own = O.ladder([
        (own_role.isNull(), "unknown_am_property"), (own_role != c("role"), F.concat(F.lit("property_role_mismatch_"), own_role)), (F.length(F.coalesce(c("raw_value"), F.lit(""))) == 0, "missing_raw_value"),
        (~value_supported(c("evidence"), c("raw_value"), page=True, locator=True, kinds=_PRINTED), "no_value_specific_verbatim_evidence"), (~types, "invalid_or_missing_scientific_type"),
        (word & (F.length(F.trim(F.coalesce(c("value_text"), F.lit("")))) == 0), "categorical_value_required"), (~word & ~_finite(c("value")), "numeric_value_required"),
        (~word & ~(N.supports_value(c("raw_value"), c("value"), abs_tol=1e-12) | spelled), "parsed_value_mismatch"), (_bad_unit(c("unit"), allowed, "plain"), F.concat(F.lit("invalid_unit_for_"), family)),
        (c("normalized_unit").isNotNull() & _bad_unit(c("normalized_unit"), allowed, "plain"), F.concat(F.lit("invalid_normalized_unit_for_"), family)),
    ])
    return F.when((c("role") == "result") & c("property").isin(*S.MECHANICAL), mechanical()).otherwise(own)


def _common(prefix: str, table: dict, units: dict[str, list[str]], dialect: str, evidence: Column, no_evidence: str) -> tuple[Column, Column, list]:
    """Role, family and the rules that several contracts share."""
    own_role, family = _lookup({k: v[0] for k, v in table.items()}, c("property")), _lookup({k: v[1] for k, v in table.items()}, c("property"))
    allowed = _units(units, family)
    rules = [
        (F.length(F.coalesce(c("raw_value"), F.lit(""))) == 0, "missing_raw_value"), (~evidence, no_evidence), (~_finite(c("value")), "numeric_value_required"),
        (~N.supports_value(c("raw_value"), c("value"), abs_tol=1e-12), "parsed_value_mismatch"), (_bad_unit(c("unit"), allowed, dialect), F.concat(F.lit("invalid_unit_for_"), family)),
        ((F.length(F.coalesce(c("normalized_unit"), F.lit(""))) > 0) & _bad_unit(c("normalized_unit"), allowed, dialect), F.concat(F.lit("invalid_normalized_unit_for_"), family)),
    ]
    head = [(own_role.isNull(), f"unknown_{prefix}_property"), (own_role != c("role"), F.concat(F.lit("property_role_mismatch_"), own_role))]
    return own_role, family, [head, rules]


def _sourced(kinds: tuple[str, ...]) -> Column:
    """Evidence with a page, or from an official workbook, and a place."""
    paged = value_supported(c("evidence"), c("raw_value"), page=True, locator=True, kinds=kinds)
    books = F.filter("evidence", lambda e: e["original_source_type"] == "official_source_data_workbook")
    return paged | value_supported(books, c("raw_value"), locator=True, kinds=kinds)


def photovoltaics() -> Column:
    _, _, (head, rules) = _common("photovoltaics", S.PHOTOVOLTAICS, S.PHOTOVOLTAICS_UNITS, "folded", _sourced(_PRINTED), "no_value_specific_verbatim_evidence")
    modality = _lookup({k: v[3] if len(v) > 3 else "experimental" for k, v in S.PHOTOVOLTAICS.items()}, c("property"))
    types = _type_allowed(("reported_process_parameter",), ("model_prediction", "simulation_result"), ("reported_measurement", "reported_derived_metric"))
    missing = _first_missing({k: v[2] for k, v in S.PHOTOVOLTAICS.items()})
    return O.ladder([*head, (modality != c("modality"), F.concat(F.lit("property_not_allowed_for_"), c("modality"))), *rules, (~types, "invalid_or_missing_scientific_type"), (missing.isNotNull(), F.concat(F.lit("missing_required_condition_"), missing))])


def thermoelectrics() -> Column:
    _, _, (head, rules) = _common("thermoelectrics", S.THERMOELECTRICS, S.THERMOELECTRICS_UNITS, "folded", _sourced((*_PRINTED, "computation")), "no_value_specific_verbatim_evidence")
    types = F.create_map(*(x for k, v in S.THERMOELECTRICS.items() for x in (F.lit(k), F.array(*map(F.lit, v[2])))))
    kind, computed = F.coalesce(_condition("scientific_type"), F.lit("")), c("modality") == "computational"
    warm, oriented = (c("property").isin(*(k for k, v in S.THERMOELECTRICS.items() if v[i])) for i in (3, 4))
    seebeck, sign = c("property") == "seebeck_coefficient", F.when(c("value") > 0, "positive").when(c("value") < 0, "negative").otherwise("zero")
    derived = c("property").isin("total_thermal_conductivity", "lattice_thermal_conductivity", "electronic_thermal_conductivity", "power_factor", "zt")
    return O.ladder([
        ((c("role") == "result") & ~c("modality").isin("experimental", "computational"), "invalid_thermoelectrics_modality"), *head, *rules, (computed & (kind != "calculated"), "computational_output_must_be_calculated"),
        (~computed & ~F.array_contains(F.try_element_at(types, c("property")), kind), "invalid_or_missing_scientific_type"), (warm & _condition("temperature").try_cast("double").isNull(), "missing_or_invalid_temperature"),
        (warm & (N.unit_key(_condition("temperature_unit"), "folded") != "k"), "temperature_must_be_kelvin"), (oriented & ~_given("measurement_orientation"), "missing_measurement_orientation"),
        (seebeck & ~F.coalesce(_condition("seebeck_sign") == sign, F.lit(False)), "seebeck_sign_mismatch"), (seebeck & ~F.coalesce(_condition("carrier_type").isin("p-type", "n-type", "mixed", "not_reported"), F.lit(False)), "missing_or_invalid_carrier_type"),
        (seebeck & (_condition("absolute_value") == "true"), "absolute_seebeck_not_canonical"), (derived & ~_given("derivation_basis"), "missing_derivation_basis"),
    ])


def membranes() -> Column:
    support = value_supported(c("evidence"), c("raw_value"), page=True, locator=True, kinds=_PRINTED)
    _, _, (head, rules) = _common("membrane", S.MEMBRANES, S.MEMBRANES_UNITS, "folded", support, "no_value_specific_verbatim_table_evidence")
    table = lambda i: F.create_map(*(x for k, v in S.MEMBRANES.items() for x in (F.lit(k), F.array(*map(F.lit, v[i])))))
    has = lambda i, x: F.coalesce(F.array_contains(F.try_element_at(table(i), c("property")), x), F.lit(False))
    missing, mode = _first_missing({k: v[3] for k, v in S.MEMBRANES.items()}), _condition("test_mode")
    token = F.trim(c("raw_value")).rlike(r"(?i)^(?:n/?a|not available|not reported|[-–—])$")
    return O.ladder([
        *head, (~has(2, c("modality")), F.concat(F.lit("property_not_allowed_for_"), c("modality"))), rules[0], (token, "non_numeric_missing_value_token"), *rules[1:],
        (~has(4, F.coalesce(_condition("scientific_type"), F.lit(""))), "invalid_or_missing_scientific_type"), (missing.isNotNull(), F.concat(F.lit("missing_required_condition_"), missing)),
        ((c("property") == "ideal_selectivity") & ~F.coalesce(mode == "pure_gas", F.lit(False)), "ideal_selectivity_requires_pure_gas_basis"),
        ((c("property") == "mixed_gas_selectivity") & ~F.coalesce(mode == "mixed_gas", F.lit(False)), "mixed_gas_selectivity_requires_mixture_basis"),
    ])


def _semiconductor_unit(unit: Column) -> Column:
    """Lower-cased, except that mega- and milli- stay apart; signs, powers and products are dropped."""
    text = F.lower(F.replace(F.coalesce(unit, F.lit("")), F.lit("MV/cm"), F.lit("megaV/cm")))
    text = F.regexp_replace(F.translate(text, "×−²³µμ", "x-23uu"), "[ωΩ]", "ohm")
    return F.translate(text, "·*^ ()", "")


def semiconductors() -> Column:
    family = F.when(c("role") == "process_parameter", _lookup(S.SEMICONDUCTOR_PROCESS, c("property"))).when(c("role") == "result", _lookup(S.SEMICONDUCTOR_RESULTS, c("property")))
    unit, kind = _semiconductor_unit(c("unit")), F.coalesce(_condition("scientific_type"), F.lit(""))
    number = r"^\s*([+\-]?\s*(?:\d+(?:\.\d*)?|\.\d+))(?:\s*[×x*]\s*10\s*\^?\s*([+\-]?\s*\d+))?\s*$"
    raw = F.replace(c("raw_value"), F.lit("−"), F.lit("-"))
    part = lambda i: F.replace(F.regexp_extract(raw, number, i), F.lit(" "), F.lit("")).try_cast("double")
    parsed = part(1) * F.pow(F.lit(10.0), F.coalesce(part(2), F.lit(0.0)))
    scaled = F.create_map(*(x for (f, u), (to, k) in S.SEMICONDUCTOR_SCALED.items() for x in (F.lit(f"{f}|{u}"), F.struct(F.lit(to).alias("to"), F.lit(k).alias("k")))))
    conversion, changed = F.try_element_at(scaled, F.concat_ws("|", family, unit)), c("normalized_value").isNotNull() | c("normalized_unit").isNotNull()
    converted = (_semiconductor_unit(c("normalized_unit")) == conversion["to"]) & O.close(c("normalized_value"), c("value") * conversion["k"], 1e-9, 1e-15)
    process, computed, lab = c("role") == "process_parameter", c("modality") == "computational", c("modality") == "experimental"
    support = value_supported(c("evidence"), c("raw_value"), page=True, locator=True, kinds=(*_PRINTED, "computation"))
    return O.ladder([
        (family.isNull(), "unknown_or_role_mismatched_semiconductor_property"),
        ((F.length(F.coalesce(c("raw_value"), F.lit(""))) == 0) | F.lower(F.trim(c("raw_value"))).isin("n/a", "na", "-", "--", "not reported", "not measured"), "missing_or_non_numeric_source_value"),
        (~support, "no_page_verbatim_value_evidence"), (~_finite(c("value")), "finite_numeric_value_required"), (parsed.isNull() | ~O.close(parsed, c("value"), 1e-9, 1e-12), "raw_numeric_value_mismatch"),
        (~F.coalesce(F.array_contains(_units(S.SEMICONDUCTOR_UNITS, family), unit), F.lit(False)), F.concat(F.lit("invalid_"), family, F.lit("_unit"))),
        (changed & conversion.isNull(), "unverified_unit_conversion"), (changed & ~F.coalesce(converted, F.lit(False)), "incorrect_scaled_unit_conversion"),
        (process & (kind != "reported_process_parameter"), "process_scientific_type_required"), (~process & computed & (kind != "calculated"), "computational_result_must_be_calculated"),
        (~process & lab & ~kind.isin("reported_measurement", "reported_derived_metric"), "experimental_scientific_type_required"),
        (~process & lab & c("property").isin("calculated_band_gap", "calculated_effective_mass", "defect_formation_energy"), "calculated_property_in_experiment"), (~process & ~computed & ~lab, "invalid_semiconductor_modality"),
        ((c("role") == "result") & ~_given("sample_label"), "missing_specimen_identity"), ((c("property") == "optical_band_gap") & ~_given("derivation_basis"), "missing_optical_gap_derivation"),
        ((c("property") == "hall_mobility") & ~F.coalesce(c("method") == "Hall_effect", F.lit(False)), "hall_mobility_method_required"), ((c("property") == "dopant_concentration") & _given("carrier_identity"), "dopant_carrier_conflation"),
    ])


def biomaterials() -> Column:
    process, computed, lab = c("role") == "process_parameter", c("modality") == "computational", c("modality") == "experimental"
    allowed = F.when(process, _units(S.BIOMATERIALS_PROCESS, c("property"))).when((c("role") == "result") & computed, _units(S.BIOMATERIALS_CALCULATED, c("property"))).when((c("role") == "result") & lab, _units(S.BIOMATERIALS_RESULTS, c("property")))
    raw, kind = F.replace(F.trim(F.coalesce(c("raw_value"), F.lit(""))), F.lit("−"), F.lit("-")), F.coalesce(_condition("scientific_type"), F.lit(""))
    printed = F.when(raw.rlike(r"^[+\-]?(?:\d+(?:\.\d*)?|\.\d+)$"), raw.try_cast("double"))
    unit = F.translate(F.lower(F.trim(F.coalesce(c("unit"), F.lit("")))), "µμ", "uu")
    cell, microbe, timed = c("property").isin(*S.CELL_RESULTS), c("property").isin(*S.MICROBIAL_RESULTS), c("property").isin(*S.TIME_RESULTS)
    support = value_supported(c("evidence"), c("raw_value"), page=True, locator=True, kinds=(*_PRINTED, "computation"))
    expected = F.when(computed, "calculated").when(lab, "reported_measurement")
    return O.ladder([
        (allowed.isNull(), "unknown_or_role_mismatched_property"), (~_finite(c("value")), "finite_numeric_value_required"), (printed.isNull() | ~O.close(printed, c("value"), 1e-9, 1e-12), "raw_numeric_value_mismatch"),
        (~support, "no_page_verbatim_value_evidence"), (~F.array_contains(allowed, unit), "invalid_property_unit"), (c("normalized_value").isNotNull() | c("normalized_unit").isNotNull(), "unverified_normalization"),
        (process & (kind != "reported_process_parameter"), "process_scientific_type_required"), (process, F.lit(None).cast("string")), (~_given("sample_label"), "missing_specimen_identity"),
        (~F.coalesce(kind == expected, F.lit(False)), "scientific_type_modality_mismatch"), (computed & ~(_given("surface_model") & _given("biomolecule")), "incomplete_computational_model_context"),
        (computed & (cell | microbe | (c("property") == "hemolysis")), "biological_assay_cannot_be_calculation"), (cell & ~(_given("cell_line") & _given("assay") & _given("exposure_time")), "incomplete_cell_assay_context"),
        (microbe & ~(_given("organism") & _given("strain") & _given("assay")), "incomplete_microbial_assay_context"), (timed & ~_given("exposure_time"), "missing_exposure_time"),
        (c("property").isin("mass_loss", "degradation_rate", "swelling_ratio", "water_uptake") & ~_given("medium"), "missing_exposure_medium"),
    ])


CONTRACTS = {
    "mechanical": mechanical, "additive_manufacturing": additive_manufacturing, "photovoltaics": photovoltaics, "thermoelectrics": thermoelectrics,
    "membranes": membranes, "semiconductors": semiconductors, "biomaterials": biomaterials,
}


def admit(measurements: DataFrame, domain: str) -> DataFrame:
    """``measurements`` with ``reason`` and ``admitted`` by a domain's contract."""
    return measurements.withColumn("reason", CONTRACTS[domain]()).withColumn("admitted", F.col("reason").isNull())


def split_admitted(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, quarantined): what is refused is kept as data, with its reason."""
    return decided.filter("admitted").drop("reason", "admitted"), decided.filter("not admitted").drop("admitted")


def _layers(allowed: list[str]) -> tuple[Column, Column, Column]:
    at = F.sort_array(F.transform("layer_stack", lambda x: x["sequence_index"]))
    contiguous = at == F.transform(F.sequence(F.lit(1), F.size("layer_stack")), lambda i: (i - 1).cast("int"))
    roles = F.transform("layer_stack", lambda x: F.lower(x["role"]))
    return contiguous, roles, F.exists(roles, lambda r: ~r.isin(*allowed))


def photovoltaic_device() -> Column:
    contiguous, roles, unknown = _layers(S.PHOTOVOLTAIC_LAYERS)
    return O.ladder([
        (~c("device_type").isin("solar_cell", "photovoltaic_module"), "invalid_photovoltaic_device_type"), (F.size("layer_stack") <= 0, "missing_layer_stack"), (~contiguous, "noncontiguous_layer_sequence"),
        (unknown, "unknown_layer_role"), (~F.array_contains(roles, "absorber"), "missing_absorber_layer"),
    ])


def membrane_device() -> Column:
    contiguous, roles, unknown = _layers(S.MEMBRANE_LAYERS)
    some = lambda *names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
    modality, architecture = (F.try_element_at("configuration", F.lit(k)) for k in ("membrane_modality", "architecture_type"))
    wanted = F.create_map(*map(F.lit, ("membrane_body", "membrane_thickness", "selective_layer", "selective_layer_thickness", "support", "support_thickness", "porous_support", "support_thickness", "substrate", "support_thickness")))
    wrong = F.exists("layer_stack", lambda x: x["thickness_property"].isNotNull() & (x["thickness_property"] != F.try_element_at(wanted, F.lower(x["role"]))))
    return O.ladder([
        (c("device_type") != "membrane_specimen", "invalid_membrane_device_type"), (~F.coalesce(modality.isin(*S.MEMBRANE_MODALITIES), F.lit(False)), "missing_or_invalid_membrane_modality"),
        (F.size("layer_stack") <= 0, "missing_membrane_architecture"), (~contiguous, "noncontiguous_or_duplicate_layer_sequence"), (unknown, "unknown_membrane_layer_role"),
        (~some("membrane_body", "selective_layer"), "missing_separating_layer"),
        ((architecture == "multilayer_composite") & ~(some("selective_layer") & some("support", "porous_support", "substrate")), "multilayer_composite_missing_support_or_selective_layer"), (wrong, "thickness_scope_role_mismatch"),
    ])


def semiconductor_device() -> Column:
    count = lambda role: F.size(F.filter("layer_stack", lambda x: x["role"] == role))
    return O.ladder([
        (~c("device_type").isin("semiconductor_thin_film", "semiconductor_wafer", "semiconductor_heterostructure", "semiconductor_device"), "unrecognized_semiconductor_specimen_type"),
        ((c("device_type") == "semiconductor_thin_film") & ((count("semiconductor_film") != 1) | (count("substrate") != 1)), "film_and_substrate_layers_required"),
        (F.length(F.coalesce(F.try_element_at("configuration", F.lit("sample_label")), F.lit(""))) == 0, "sample_label_required"), (F.exists("layer_stack", lambda x: ~F.coalesce(x["verified"], F.lit(False))), "layer_source_evidence_required"),
    ])


def biomaterial_device() -> Column:
    one = F.try_element_at("layer_stack", F.lit(1))
    return O.ladder([
        (~c("device_type").isin("biomaterial_scaffold", "biomaterial_hydrogel", "biomaterial_implant", "biomaterial_membrane", "biomaterial_filament"), "unrecognized_biomaterial_specimen_type"),
        (F.length(F.coalesce(F.try_element_at("configuration", F.lit("sample_label")), F.lit(""))) == 0, "missing_specimen_label"),
        ((F.size("layer_stack") != 1) | (one["role"] != "bulk_formulation"), "exactly_one_bulk_formulation_required"), (~F.coalesce(one["verified"], F.lit(False)), "formulation_evidence_required"),
    ])


#: Properties with rules of their own in the catalysis and corrosion contracts.
PRODUCT_SPECIFIC = ("faradaic_efficiency", "product_selectivity", "partial_current_density", "product_formation_rate", "selectivity", "yield")
PERCENT_PROPERTIES = (
    "faradaic_efficiency", "product_selectivity", "selectivity", "yield", "conversion", "carbon_balance", "retention", "degradation_efficiency", "removal_efficiency", "cod_removal", "color_removal", "turbidity_removal",
)
NORMALIZATION_REQUIRED = ("current_density", "partial_current_density", "mass_activity", "specific_activity", "turnover_frequency", "reaction_rate", "activity", "productivity", "product_formation_rate")
REFERENCE_REQUIRED = ("onset_potential", "half_wave_potential")
CORROSION_POTENTIALS = ("corrosion_potential", "pitting_potential", "repassivation_potential", "breakdown_potential")
CORROSION_EIS = (
    "charge_transfer_resistance", "solution_resistance", "coating_resistance", "pore_resistance", "protective_layer_resistance", "film_resistance", "oxide_resistance", "cpe_parameter", "cpe_exponent",
    "double_layer_capacitance", "coating_capacitance", "warburg_parameter",
)


#: Where evidence of catalysis may come from.
CATALYSIS_ORIGINS = ("native_text", "table_reported", "figure_caption", "figure_annotation", "ocr_extracted", "figure_digitized")


def catalysis(origins: tuple[str, ...] = CATALYSIS_ORIGINS) -> Column:
    """Over property, raw_value, value, unit, evidence, ownership, scope_status, product, reactant,
    normalization_kind, potential_reference, derived, unresolved_conflict and semantic_invalid."""
    empty = lambda x: F.length(F.coalesce(c(x), F.lit(""))) == 0
    basis = F.coalesce(c("normalization_kind"), F.lit("unknown"))
    origin = lambda e: e["original_source_type"]
    estimated = lambda e: F.coalesce(origin(e) == "figure_digitized", F.lit(False)) | F.coalesce(e["estimated"], F.lit(False))
    number = F.exists("evidence", lambda e: F.coalesce(e["verbatim_match"], F.lit(False)) & N.supports_value(e["text_snippet"], c("value"), 1e-9))
    return O.ladder([
        (c("scope_status") != "supported", "unsupported_v1_subtype"), (c("ownership") != "focal_work", F.concat(F.lit("ownership_"), c("ownership"))), (c("derived"), "derived_value_not_reported"), (c("unresolved_conflict"), "condition_conflict"),
        (c("semantic_invalid"), "schema_invalid"), (c("property").isin(*PERCENT_PROPERTIES) & (c("unit") == "%") & (c("value") > 100 + 1e-6), "schema_invalid"), (c("property").isin(*PRODUCT_SPECIFIC) & empty("product"), "missing_product"),
        ((c("property") == "conversion") & empty("reactant"), "schema_invalid"), (c("property").isin(*NORMALIZATION_REQUIRED) & (basis == "unknown"), "normalization_basis_unknown"),
        ((c("property") == "turnover_frequency") & (basis != "site_count"), "incompatible_unit_basis"), ((c("potential_reference") == "unknown") | (c("property").isin(*REFERENCE_REQUIRED) & c("potential_reference").isNull()), "missing_potential_reference"),
        (F.exists("evidence", estimated), "estimated_digitized"), (F.exists("evidence", lambda e: ~F.coalesce(origin(e).isin(*origins), F.lit(False))), "unsupported_visual_origin"),
        (~(value_supported(c("evidence"), c("raw_value")) | F.coalesce(number, F.lit(False))), "no_value_specific_evidence"),
    ])


def corrosion() -> Column:
    """Over property, raw_value, value, unit, evidence, ownership, data_kind, scope_status, experiment_type,
    reference_electrode, equivalent_circuit, treatment_present, unresolved_conflict and condition_properties."""
    empty = lambda x: F.length(F.trim(F.coalesce(c(x), F.lit("")))) == 0
    eis, weighed = c("experiment_type") == "eis", c("experiment_type") == "weight_loss"
    verified = F.exists("evidence", lambda e: F.coalesce(e["verbatim_match"], F.lit(False)) & (F.length(F.coalesce(e["text_snippet"], F.lit(""))) > 0) & ~F.coalesce(e["original_source_type"].isin("figure_reported", "unknown"), F.lit(False)))
    efficiency = c("property").isin("inhibition_efficiency", "protection_efficiency")
    mass, rate = c("property").isin("initial_mass", "final_mass", "mass_loss"), c("property").isin("corrosion_rate", "penetration_rate", "inhibition_efficiency", "protection_efficiency")
    has = lambda *names: F.arrays_overlap(F.coalesce("condition_properties", F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    kind = F.coalesce(c("data_kind"), F.lit(""))
    return O.ladder([
        (c("scope_status") != "supported", "unsupported_scope"), (c("ownership") != "focal_work", F.concat(F.lit("ownership_"), c("ownership"))), (c("value").isNull(), "non_numeric_or_unparsed_value"), (empty("raw_value"), "missing_raw_value"),
        (c("unresolved_conflict"), "unresolved_condition_conflict"), (~verified, "no_verified_value_specific_evidence"), (c("property").isin(*CORROSION_POTENTIALS) & empty("reference_electrode"), "missing_reference_electrode"),
        (c("property").isin(*CORROSION_EIS) & ~eis, "eis_metric_outside_eis_experiment"), ((c("property") == "polarization_resistance") & eis, "polarization_resistance_misclassified_as_eis"),
        ((kind == "fitted_parameter") & empty("equivalent_circuit"), "missing_equivalent_circuit_context"), (~N.corrosion_unit_fits(c("property"), c("unit")), "incompatible_gravimetric_unit_category"),
        (efficiency & ~c("treatment_present"), "missing_linked_treatment"), (weighed & mass & (kind != "reported_measurement"), "invalid_gravimetric_data_kind"), (weighed & rate & (kind != "derived_metric"), "invalid_gravimetric_data_kind"),
        (weighed & rate & ~has("exposure_time"), "missing_exposure_time"), (weighed & rate & ~has("medium", "electrolyte"), "missing_environment_context"),
    ])


def digitization_reasons() -> Column:
    """Every reason to refuse a plot; unlike admission reasons they accumulate."""
    colours = F.col("series_colors")
    known = F.filter(colours, lambda x: x.isNotNull())
    grey = F.exists(known, lambda x: F.array_max(x) - F.array_min(x) < 25)
    ready = F.forall("calibration_states", lambda s: s.isin("verified", "user_confirmed"))
    tests = [
        (c("geometry").isin("polar", "ternary", "3d", "bar", "contour", "microscopy", "diffraction_pattern"), F.concat(F.lit("unsupported_geometry:"), c("geometry"))), ((c("width") < 80) | (c("height") < 80), F.lit("plot_resolution_too_low")),
        (F.exists("calibration_states", lambda s: s.isin("ambiguous", "failed")), F.lit("calibration_ambiguous_or_failed")), (~ready & ~c("diagnostic"), F.lit("calibration_not_user_confirmed")), (F.size(colours) == 0, F.lit("no_explicit_color_series_selected")),
        (F.exists(colours, lambda x: x.isNull()), F.lit("series_color_selection_required")), (F.size(F.array_distinct(known)) != F.size(known), F.lit("series_colors_not_separable")), ((F.size(colours) > 1) & grey, F.lit("ambiguous_grayscale_multi_series")),
        ((F.size(colours) == 1) & grey & ~c("grayscale_selected"), F.lit("grayscale_series_requires_user_selected_target")), (F.greatest("pixel_x", "pixel_y") > 8, F.lit("line_or_calibration_uncertainty_too_high")),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), r) for t, r in tests)))


def failure_class() -> Column:
    """The class of a failure by its error's name and message, in order."""
    name, text = F.lower("error_name"), F.lower("message")
    has = lambda x, *words: O.any_of(*(F.contains(x, F.lit(w)) for w in words))
    return O.ladder([
        (has(name, "timeout"), "timeout"), (has(text, "429") | (has(name, "rate") & has(name, "limit")), "provider_rate_limited"), (has(name, "auth") | has(text, "401", "403"), "provider_authentication"),
        (has(name, "invalidrequest") | has(text, "400"), "provider_invalid_request"), (has(name, "unavailable") | has(text, "503"), "provider_transient_unavailable"), (has(name, "schema", "validation"), "schema_invalid"),
        (has(name, "admission", "scientific"), "scientific_admission_failure"), (has(name, "archive"), "archive_failure"), (has(name, "oserror", "ioerror", "filenotfound", "permission"), "storage_failure"),
    ], "unknown_internal_failure")


def battery_gate() -> Column:
    return O.ladder([(c("derived"), "derived_value_not_reported"), (c("ownership") != "focal_work", F.concat(F.lit("ownership_"), c("ownership"))), (~F.exists("evidence", lambda e: F.coalesce(e["verbatim_match"], F.lit(False))), "no_verbatim_evidence")])


def most_conservative(a: Column, b: Column) -> Column:
    """The more cautious of two scope labels."""
    order = ("in_scope", "partial", "unsupported")
    rank = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0))
    return F.when(rank(a) >= rank(b), a).otherwise(b)
