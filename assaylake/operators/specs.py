"""The properties of each domain's admission contract, and the units of their families."""

from __future__ import annotations

#: Property and unit family.
MECHANICAL = {
    "yield_strength": "stress", "proof_stress": "stress", "ultimate_tensile_strength": "stress", "fracture_strength": "stress", "tensile_strength": "stress",
    "elongation": "strain", "reduction_of_area": "strain", "youngs_modulus": "modulus", "poisson_ratio": "dimensionless", "applied_load": "force", "stress": "stress", "strain": "strain",
    "vickers_hardness": "vickers", "rockwell_hardness": "rockwell", "brinell_hardness": "brinell", "indentation_hardness": "stress",
    "creep_strain": "strain", "creep_rate": "rate", "minimum_creep_rate": "rate", "rupture_time": "time", "rupture_strain": "strain", "applied_stress": "stress", "time_to_specific_strain": "time",
    "cycles_to_failure": "cycles", "fatigue_strength": "stress", "fatigue_limit": "stress", "stress_amplitude": "stress", "mean_stress": "stress", "frequency": "frequency", "strain_amplitude": "strain",
    "stress_ratio": "dimensionless", "crack_growth_rate": "length_per_cycle",
    "fracture_toughness": "fracture_toughness", "stress_intensity": "fracture_toughness", "stress_intensity_range": "fracture_toughness", "j_integral": "energy_per_area", "ctod": "length", "impact_energy": "energy",
    "elastic_constant_c11": "modulus", "elastic_constant_c12": "modulus", "elastic_constant_c13": "modulus", "elastic_constant_c33": "modulus", "elastic_constant_c44": "modulus", "elastic_constant_c66": "modulus",
    "bulk_modulus": "modulus", "shear_modulus": "modulus",
}
MECHANICAL_UNITS = {
    "stress": ["pa", "kpa", "mpa", "gpa"], "modulus": ["pa", "kpa", "mpa", "gpa"], "strain": ["1", "%", "percent", "dimensionless", "microstrain", "ue", "µe"], "dimensionless": ["", "1", "dimensionless"],
    "force": ["n", "kn", "mn"], "time": ["s", "sec", "min", "h", "hr", "day", "days"], "rate": ["s^-1", "1/s", "s-1", "h^-1", "1/h", "h-1"], "frequency": ["hz", "1/s", "s^-1", "rpm"],
    "cycles": ["", "cycle", "cycles", "count", "dimensionless"], "length_per_cycle": ["m/cycle", "mm/cycle", "um/cycle", "µm/cycle"],
    "fracture_toughness": ["pa*sqrt(m)", "kpa*sqrt(m)", "mpa*sqrt(m)", "gpa*sqrt(m)", "pa√m", "kpa√m", "mpa√m", "gpa√m"], "energy_per_area": ["j/m2", "j/m^2", "kj/m2", "kj/m^2"],
    "length": ["m", "mm", "um", "µm"], "energy": ["j", "mj", "kj"], "vickers": ["hv"], "rockwell": ["hra", "hrb", "hrc"], "brinell": ["hb", "hbw"],
}

#: Additive manufacturing: role and unit family of each property.
ADDITIVE = {
    "laser_power": ("process_parameter", "power"), "electron_beam_power": ("process_parameter", "power"), "scan_speed": ("process_parameter", "speed"), "hatch_spacing": ("process_parameter", "length"),
    "layer_thickness": ("process_parameter", "length"), "spot_size": ("process_parameter", "length"), "beam_diameter": ("process_parameter", "length"), "powder_feed_rate": ("process_parameter", "mass_flow"),
    "wire_feed_rate": ("process_parameter", "speed"), "preheat_temperature": ("process_parameter", "temperature"), "post_process_temperature": ("process_parameter", "temperature"), "post_process_time": ("process_parameter", "time"),
    "chamber_oxygen": ("process_parameter", "concentration"), "rotation_angle": ("process_parameter", "angle"), "linear_energy_density": ("process_parameter", "energy_per_length"),
    "surface_energy_density": ("process_parameter", "energy_per_area"), "volumetric_energy_density": ("process_parameter", "energy_per_volume"), "scan_strategy": ("process_parameter", "categorical"),
    "build_orientation": ("process_parameter", "categorical"), "shielding_gas": ("process_parameter", "categorical"), "machine_model": ("process_parameter", "categorical"),
    "relative_density": ("result", "percent"), "absolute_density": ("result", "density"), "porosity": ("result", "percent"), "void_fraction": ("result", "percent"), "defect_fraction": ("result", "percent"),
    "lack_of_fusion_fraction": ("result", "percent"), "keyhole_porosity": ("result", "percent"), "surface_roughness_ra": ("result", "length"), "surface_roughness_rz": ("result", "length"), "melt_pool_width": ("result", "length"),
    "melt_pool_depth": ("result", "length"), "grain_size": ("result", "length"), "cell_spacing": ("result", "length"), "phase_fraction": ("result", "percent"), "texture_coefficient": ("result", "dimensionless"),
    "dimensional_error": ("result", "length"), "build_rate": ("result", "volume_rate"),
}
ADDITIVE_UNITS = {
    "power": ["w", "kw"], "speed": ["mm/s", "m/s", "mm/min", "m/min"], "length": ["m", "mm", "um", "µm", "μm"], "mass_flow": ["g/s", "g/min", "kg/h"], "temperature": ["k", "°c", "c"], "time": ["s", "min", "h", "hr"],
    "concentration": ["ppm", "%", "vol%"], "angle": ["°", "deg", "degree", "degrees"], "energy_per_length": ["j/mm", "j/m"], "energy_per_area": ["j/mm2", "j/mm^2", "j/m2", "j/m^2"],
    "energy_per_volume": ["j/mm3", "j/mm^3", "j/cm3", "j/cm^3"], "percent": ["%", "vol%"], "density": ["kg/m3", "kg/m^3", "g/cm3", "g/cm^3"], "dimensionless": ["", "1", "dimensionless"],
    "volume_rate": ["mm3/s", "mm^3/s", "cm3/h", "cm^3/h"], "categorical": [""],
}

#: Photovoltaics: role, unit family, conditions that have to be given; a fourth entry is the modality if computational.
_SUN = ("illumination_spectrum", "irradiance")
PHOTOVOLTAICS = {
    "power_conversion_efficiency": ("result", "percent", _SUN), "open_circuit_voltage": ("result", "voltage", _SUN), "short_circuit_current_density": ("result", "current_density", _SUN),
    "short_circuit_current": ("result", "current", _SUN), "fill_factor": ("result", "percent", _SUN), "maximum_power": ("result", "power", _SUN), "voltage_at_maximum_power": ("result", "voltage", _SUN),
    "stabilized_power_conversion_efficiency": ("result", "percent", _SUN), "swept_power_conversion_efficiency": ("result", "percent", _SUN), "initial_power_conversion_efficiency": ("result", "percent", _SUN),
    "aged_power_conversion_efficiency": ("result", "percent", (*_SUN, "aging_time")), "current_density": ("result", "current_density", ()), "voltage": ("result", "voltage", ()),
    "external_quantum_efficiency": ("result", "percent", ("wavelength",)), "incident_photon_to_current_efficiency": ("result", "percent", ("wavelength",)), "retained_efficiency": ("result", "percent", ("aging_time",)),
    "degradation_rate": ("result", "rate", ()), "t80": ("result", "time", ("aging_protocol", "temperature", "atmosphere")), "t90": ("result", "time", ("aging_protocol", "temperature", "atmosphere")),
    "calculated_bandgap": ("result", "energy", (), "computational"), "calculated_absorption_coefficient": ("result", "inverse_length", (), "computational"), "carrier_effective_mass": ("result", "mass_ratio", (), "computational"),
    "defect_formation_energy": ("result", "energy", (), "computational"), "simulated_power_conversion_efficiency": ("result", "percent", (), "computational"), "simulated_open_circuit_voltage": ("result", "voltage", (), "computational"),
    "predicted_short_circuit_current_density": ("result", "current_density", (), "computational"), "simulated_fill_factor": ("result", "percent", (), "computational"),
    "eqe_integrated_current_density": ("result", "current_density", ("spectral_range",)), "active_area": ("process_parameter", "area", ()), "aperture_area": ("process_parameter", "area", ()),
    "irradiance": ("process_parameter", "irradiance", ()), "measurement_temperature": ("process_parameter", "temperature", ()), "scan_rate": ("process_parameter", "scan_rate", ()), "aging_time": ("process_parameter", "time", ()),
    "processing_temperature": ("process_parameter", "temperature", ()), "processing_time": ("process_parameter", "time", ()), "film_thickness": ("process_parameter", "length", ()),
    "solution_concentration": ("process_parameter", "concentration", ()), "spin_speed": ("process_parameter", "rotation_rate", ()),
}
PHOTOVOLTAICS_UNITS = {
    "percent": ["%"], "voltage": ["v", "mv"], "current_density": ["ma/cm2", "ma/cm^2", "a/m2", "a/m^2"], "current": ["a", "ma", "ua", "µa", "μa"], "power": ["w", "mw", "uw", "µw", "μw"],
    "rate": ["%/h", "%/day", "1/h", "h^-1", "1/day", "day^-1"], "time": ["s", "min", "h", "hr", "day", "days"], "area": ["cm2", "cm^2", "mm2", "mm^2", "m2", "m^2"], "irradiance": ["mw/cm2", "mw/cm^2", "w/m2", "w/m^2"],
    "temperature": ["k", "°c", "c"], "scan_rate": ["v/s", "mv/s"], "length": ["m", "mm", "um", "µm", "μm", "nm"], "concentration": ["m", "mol/l", "mm", "mg/ml", "wt%", "%"], "rotation_rate": ["rpm"],
    "energy": ["ev", "mev"], "inverse_length": ["cm^-1", "1/cm", "m^-1", "1/m"], "mass_ratio": ["m0", "m_e", "me", "dimensionless"],
}
PHOTOVOLTAIC_LAYERS = ["substrate", "transparent_electrode", "etl", "absorber", "htl", "electrode", "buffer", "interconnect", "encapsulation", "other"]

#: Thermoelectrics: role, unit family, scientific types, whether temperature and orientation have to be given.
_MEASURED, _DERIVED, _PROCESS = ("reported_measurement",), ("reported_derived_metric",), ("reported_process_parameter",)
THERMOELECTRICS = {
    "seebeck_coefficient": ("result", "seebeck", _MEASURED, True, True), "electrical_conductivity": ("result", "electrical_conductivity", _MEASURED, True, True),
    "electrical_resistivity": ("result", "electrical_resistivity", _MEASURED, True, True), "total_thermal_conductivity": ("result", "thermal_conductivity", _MEASURED + _DERIVED, True, True),
    "lattice_thermal_conductivity": ("result", "thermal_conductivity", _DERIVED, True, True), "electronic_thermal_conductivity": ("result", "thermal_conductivity", _DERIVED, True, True),
    "power_factor": ("result", "power_factor", _DERIVED, True, True), "zt": ("result", "dimensionless", _DERIVED, True, True), "carrier_concentration": ("result", "carrier_concentration", _MEASURED + _DERIVED, True, True),
    "carrier_mobility": ("result", "carrier_mobility", _MEASURED + _DERIVED, True, True), "carrier_effective_mass": ("result", "effective_mass", _MEASURED, False, True),
    "reaction_temperature": ("process_parameter", "temperature", _PROCESS, False, False), "reaction_time": ("process_parameter", "time", _PROCESS, False, False),
    "annealing_temperature": ("process_parameter", "temperature", _PROCESS, False, False), "annealing_time": ("process_parameter", "time", _PROCESS, False, False),
    "purification_temperature": ("process_parameter", "temperature", _PROCESS, False, False), "purification_time": ("process_parameter", "time", _PROCESS, False, False),
    "sintering_temperature": ("process_parameter", "temperature", _PROCESS, False, False), "sintering_time": ("process_parameter", "time", _PROCESS, False, False),
    "sintering_pressure": ("process_parameter", "pressure", _PROCESS, False, False), "relative_density": ("process_parameter", "percent", _PROCESS, False, False),
}
THERMOELECTRICS_UNITS = {
    "seebeck": ["v/k", "mv/k", "uv/k"], "electrical_conductivity": ["s/m", "s/cm", "ks/m"], "electrical_resistivity": ["ohm*m", "ohm*cm", "ohmcm", "ω*m", "ω*cm"],
    "thermal_conductivity": ["w/m/k", "w/(m*k)", "w*m^-1*k^-1"], "power_factor": ["w/m/k2", "w/m/k^2", "uw/cm/k2", "uw/cm/k^2"], "dimensionless": ["dimensionless", "1"],
    "carrier_concentration": ["1/cm3", "cm^-3", "1/m3", "m^-3"], "carrier_mobility": ["cm2/v/s", "cm^2/v/s", "m2/v/s", "m^2/v/s"], "effective_mass": ["m_e", "me", "m0"], "temperature": ["k", "c", "°c"],
    "time": ["s", "min", "h", "hr"], "pressure": ["pa", "kpa", "mpa", "gpa", "torr"], "percent": ["%"],
}

#: Membranes: role, unit family, modalities, conditions that have to be given, scientific types.
_GAS = ("species", "test_mode", "temperature", "temperature_unit", "pressure_kind")
_PAIR = ("species_pair", "test_mode", "temperature", "temperature_unit")
_MODEL = ("species", "temperature", "temperature_unit", "simulation_method", "lipid_composition")
_LIQUID = ("liquid_separation", "filtration")
_SOLUTE = ("solute", "feed_concentration", "test_mode", "pressure_kind")
MEMBRANES = {
    "gas_permeability": ("result", "gas_permeability", ("gas_separation",), _GAS, _MEASURED), "gas_permeance": ("result", "gas_permeance", ("gas_separation",), _GAS, _MEASURED),
    "ideal_selectivity": ("result", "dimensionless", ("gas_separation",), _PAIR, _DERIVED), "mixed_gas_selectivity": ("result", "dimensionless", ("gas_separation",), _PAIR, _MEASURED + _DERIVED),
    "separation_factor": ("result", "dimensionless", ("pervaporation",), _PAIR, _MEASURED + _DERIVED), "activation_energy_of_permeance": ("result", "energy_per_mole", ("gas_separation",), ("species", "temperature_range"), _DERIVED),
    "estimated_selective_layer_thickness": ("result", "length", ("gas_separation",), ("species", "estimation_basis"), _DERIVED),
    "calculated_membrane_permeability_coefficient": ("result", "velocity", ("computational_transport",), _MODEL, ("simulation_result",)),
    "calculated_apparent_diffusion_coefficient": ("result", "diffusivity", ("computational_transport",), _MODEL, ("simulation_result",)),
    "liquid_flux": ("result", "liquid_flux", (*_LIQUID, "pervaporation"), ("feed", "test_mode", "pressure_kind"), _MEASURED), "liquid_permeance": ("result", "liquid_permeance", _LIQUID, ("feed", "test_mode", "pressure_kind"), _MEASURED),
    "solute_rejection": ("result", "percent_or_fraction", _LIQUID, _SOLUTE, _MEASURED), "retention": ("result", "percent_or_fraction", _LIQUID, _SOLUTE, _MEASURED),
    "initial_flux": ("result", "mass_flux", ("filtration",), ("feed", "test_mode", "transmembrane_pressure"), _MEASURED), "fouled_flux": ("result", "mass_flux", ("filtration",), ("feed", "foulant", "test_mode", "transmembrane_pressure"), _MEASURED),
    "recovered_flux": ("result", "mass_flux", ("filtration",), ("feed", "foulant", "cleaning_method", "test_mode", "transmembrane_pressure"), _MEASURED),
    "flux_recovery_ratio": ("result", "percent", ("filtration",), ("foulant", "cleaning_method"), _DERIVED), "relative_flux_reduction": ("result", "percent", ("filtration",), ("foulant",), _DERIVED),
    "filler_loading": ("process_parameter", "percent", ("fabrication",), (), _PROCESS), "polymer_concentration": ("process_parameter", "percent", ("fabrication",), (), _PROCESS),
    "casting_gap": ("process_parameter", "length", ("fabrication",), (), _PROCESS), "drying_temperature": ("process_parameter", "temperature", ("fabrication",), (), _PROCESS), "drying_time": ("process_parameter", "time", ("fabrication",), (), _PROCESS),
}
MEMBRANES_UNITS = {
    "gas_permeability": ["barrer", "mol*m/(m2*s*pa)", "mol*m/(m^2*s*pa)"],
    "gas_permeance": ["gpu", "mol/(m2*s*pa)", "mol/(m^2*s*pa)", "10^2m_stp3*m^-2*h^-1*bar^-1", "10^2m_stp^3*m^-2*h^-1*bar^-1", "10^2m_stp3m^-2h^-1bar^-1", "10^2m_stp^3m^-2h^-1bar^-1"],
    "dimensionless": ["dimensionless", "1"], "energy_per_mole": ["kj/mol", "kjmol^-1"], "velocity": ["cm/s"], "diffusivity": ["10^-6cm2/s", "10^-6cm^2/s"], "length": ["m", "mm", "um", "µm", "μm", "nm"],
    "liquid_flux": ["lmh", "l/m2/h", "l/m^2/h", "kg/m2/h", "kg/m^2/h", "mol/m2/s", "mol/m^2/s"], "liquid_permeance": ["l/m2/h/bar", "l/m^2/h/bar", "kg/m2/h/bar", "kg/m^2/h/bar"],
    "mass_flux": ["g/m2/s", "g/m^2/s", "kg/m2/h", "kg/m^2/h"], "percent_or_fraction": ["%", "fraction", "dimensionless", "1"], "percent": ["%"], "temperature": ["k", "c", "°c"], "time": ["s", "min", "h", "hr", "day", "days"],
}
MEMBRANE_LAYERS = ["substrate", "support", "porous_support", "interlayer", "membrane_body", "selective_layer", "protective_layer", "filler_additive"]
MEMBRANE_MODALITIES = ["gas_separation", "liquid_separation", "filtration", "pervaporation"]

#: Semiconductors: unit family of results and of process parameters.
SEMICONDUCTOR_RESULTS = {
    "band_gap": "energy", "electronic_band_gap": "energy", "optical_band_gap": "energy", "work_function": "energy", "electron_affinity": "energy", "ionization_energy": "energy", "fermi_level": "energy", "effective_mass": "mass",
    "calculated_band_gap": "energy", "calculated_effective_mass": "mass", "carrier_concentration": "density", "activated_carrier_concentration": "density", "electron_concentration": "density", "hole_concentration": "density",
    "dopant_concentration": "density", "carrier_mobility": "mobility", "electron_mobility": "mobility", "hole_mobility": "mobility", "hall_mobility": "mobility", "conductivity": "conductivity", "resistivity": "resistivity",
    "sheet_resistance": "sheet_resistance", "hall_coefficient": "hall_coefficient", "threshold_voltage": "voltage", "on_off_ratio": "dimensionless", "subthreshold_swing": "subthreshold", "contact_resistance": "contact_resistance",
    "breakdown_voltage": "voltage", "breakdown_field": "field", "current_density": "current_density", "absorption_coefficient": "absorption", "absorption_edge": "wavelength", "photoluminescence_peak": "peak",
    "emission_wavelength": "wavelength", "refractive_index": "dimensionless", "dielectric_constant": "dimensionless", "crystallite_size": "length", "defect_formation_energy": "energy", "activation_energy": "energy",
}
SEMICONDUCTOR_PROCESS = {
    "film_thickness": "length", "dopant_atomic_fraction": "percent", "dopant_concentration": "density", "growth_temperature": "temperature", "substrate_temperature": "temperature", "annealing_temperature": "temperature",
    "annealing_time": "time", "tempering_temperature": "temperature", "tempering_time": "time",
}
SEMICONDUCTOR_UNITS = {
    "energy": ["ev"], "mass": ["me", "m0"], "density": ["cm-3", "m-3", "1/cm3", "1/m3", "x1020cm-3"], "mobility": ["cm2/v/s", "m2/v/s", "cm2/vs", "m2/vs", "x10-2cm2/v/s", "x10-3cm2/v/s"], "conductivity": ["s/cm", "s/m"],
    "resistivity": ["ohmcm", "ohmm", "x10-3ohmcm"], "sheet_resistance": ["ohm/sq", "ohm/square"], "hall_coefficient": ["cm3/c", "m3/c", "x10-2cm3/c"], "voltage": ["v", "mv"], "dimensionless": ["1", "dimensionless"],
    "subthreshold": ["mv/dec", "v/dec"], "contact_resistance": ["ohm", "ohmcm", "ohmmm"], "field": ["v/cm", "kv/cm", "megav/cm"], "current_density": ["a/cm2", "ma/cm2", "a/m2"], "absorption": ["cm-1", "m-1"],
    "wavelength": ["nm", "um"], "peak": ["ev", "nm", "um"], "length": ["nm", "um", "mm"], "percent": ["%", "at.%"], "temperature": ["c", "k"], "time": ["s", "min", "h"],
}
#: Family and scaled unit: the plain unit and the factor.
SEMICONDUCTOR_SCALED = {
    ("density", "x1020cm-3"): ("cm-3", 1e20), ("resistivity", "x10-3ohmcm"): ("ohmcm", 1e-3), ("hall_coefficient", "x10-2cm3/c"): ("cm3/c", 1e-2), ("mobility", "x10-2cm2/v/s"): ("cm2/v/s", 1e-2), ("mobility", "x10-3cm2/v/s"): ("cm2/v/s", 1e-3),
}

#: Biomaterials: units of each result, calculated result and process parameter.
BIOMATERIALS_RESULTS = {
    "cell_viability": ["%"], "cell_proliferation_ratio": ["1", "fold"], "cell_adhesion": ["%", "cells/cm2"], "live_dead_fraction": ["%"], "cytotoxicity": ["%"], "metabolic_activity": ["%", "1", "fold"], "hemolysis": ["%"],
    "platelet_adhesion": ["cells/cm2", "%"], "alp_activity": ["u/l", "u/mg", "nmol/min/mg"], "mineralization": ["%", "mg/cm2"], "apatite_formation": ["%"], "inhibition_zone": ["mm"], "bacterial_viability": ["%"],
    "cfu_reduction": ["%"], "log_reduction": ["log10"], "mass_loss": ["%"], "degradation_rate": ["%/day", "%/week", "mg/day"], "swelling_ratio": ["%"], "water_uptake": ["%"], "volume_porosity": ["%"], "porosity": ["%"],
    "pore_size": ["um", "mm"], "pore_diameter": ["um", "mm"], "strut_diameter": ["um", "mm"], "fiber_diameter": ["um", "nm"], "deposited_layer_width": ["um", "mm"], "contact_angle": ["degree"], "surface_roughness": ["nm", "um"],
    "compressive_yield_strength": ["mpa", "kpa"], "ultimate_compressive_strength": ["mpa", "kpa"], "compressive_modulus": ["mpa", "kpa"], "elastic_modulus": ["mpa", "kpa"], "tensile_strength": ["mpa", "kpa"],
    "cold_crystallization_temperature": ["c", "k"], "melting_enthalpy": ["j/g"], "crystallinity": ["%"], "viscosity": ["pa.s"],
}
BIOMATERIALS_CALCULATED = {"interaction_energy": ["kcal/mol"], "electrostatic_interaction_energy": ["kcal/mol"]}
BIOMATERIALS_PROCESS = {
    "printing_speed": ["mm/s"], "nozzle_temperature": ["c", "k"], "bed_temperature": ["c", "k"], "nozzle_diameter": ["mm", "um"], "layer_height": ["mm", "um"], "infill_density": ["%"], "polymer_concentration": ["%", "%w/v"],
    "crosslinker_concentration": ["%", "mg/ml"], "extrusion_pressure": ["kpa"],
}
CELL_RESULTS = ["cell_viability", "cell_proliferation_ratio", "cell_adhesion", "live_dead_fraction", "cytotoxicity", "metabolic_activity", "alp_activity", "mineralization"]
MICROBIAL_RESULTS = ["inhibition_zone", "bacterial_viability", "cfu_reduction", "log_reduction"]
TIME_RESULTS = [*CELL_RESULTS, "mass_loss", "degradation_rate", "swelling_ratio", "water_uptake", "hemolysis", "platelet_adhesion", "apatite_formation"]
