"""Explicit types of archives, the nested records that the engine stores and queries.

Free-form leaves are VARIANT; absent and null fields are the same. An archive row is one paper in
one domain; ``operators.silver`` turns a table of them into flat tables.
"""

from __future__ import annotations

EVIDENCE = """struct<source_id string, page int, section string, source_type string, original_source_type string,
    verbatim_match boolean, text_snippet string, table_id string, figure_id string, locator string, confidence double, estimated boolean>"""

MEASUREMENT = f"""struct<property string, raw_value string, value variant, unit string, normalized_value variant,
    normalized_unit string, uncertainty double, uncertainty_unit string, qualifier string, method string,
    conditions variant, evidence array<{EVIDENCE}>>"""

ARCHIVE = f"""
metadata struct<archive_id string, schema_name string, schema_version string, software_version string,
    created_at string, generator string, extractor_model string, domain string>,
sources array<struct<source_id string, source_type string, title string, doi string, url string, year int,
    authors array<string>, license string, checksum string>>,
materials array<struct<material_id string, name string, formula string, composition map<string, double>,
    elements array<string>, phase string, structure variant, morphology variant, defects variant, dopants variant,
    tags array<string>, evidence array<{EVIDENCE}>>>,
devices array<struct<device_id string, name string, device_type string, material_ids array<string>,
    configuration variant, tags array<string>, evidence array<{EVIDENCE}>>>,
processes array<struct<process_id string, name string, family string, sequence_index int, inputs array<string>,
    outputs array<string>, parameters array<{MEASUREMENT}>, atmosphere string, equipment string,
    evidence array<{EVIDENCE}>>>,
experiments array<struct<experiment_id string, experiment_type string, material_ids array<string>, device_id string,
    device_ids array<string>, target string, conditions array<{MEASUREMENT}>, outputs array<{MEASUREMENT}>,
    protocol string, evidence array<{EVIDENCE}>>>,
calculations array<struct<calculation_id string, calculation_type string, material_ids array<string>, code string,
    method string, functional string, model variant, parameters array<{MEASUREMENT}>, outputs array<{MEASUREMENT}>,
    evidence array<{EVIDENCE}>>>,
relationships array<struct<relation_id string, subject_id string, predicate string, object_id string,
    attributes variant, evidence array<{EVIDENCE}>>>,
domain_payloads array<struct<domain string, schema_version string, tags array<string>, values variant>>,
quality struct<completeness double, provenance_coverage double, unit_normalization_coverage double,
    extraction_confidence double, semantic_warnings array<string>, validation_status string>
"""

#: Fixed values of the enumerated fields.
ENUMS = {
    "evidence_source": ("text", "table", "figure", "supplementary", "computation", "user", "unknown"),
    "qualifier": ("exact", "approx", "lower_bound", "upper_bound", "range", "mean", "unknown"),
}
