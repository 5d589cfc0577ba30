"""Shapes (JSON Schema) of the documents that this package reads and writes."""

from __future__ import annotations

from typing import Any

Shape = dict[str, Any]
TEXT, BOOL, NULL = {"type": "string"}, {"type": "boolean"}, {"type": "null"}
COUNT: Shape = {"type": "integer", "minimum": 0}
_DRAFT = "https://json-schema.org/draft/2020-12/schema"


def obj(properties: Shape, required: tuple[str, ...] | None = None, closed: bool = True) -> Shape:
    return {"type": "object", "properties": properties, "required": list(properties if required is None else required), **({"additionalProperties": False} if closed else {})}


def opt(properties: Shape) -> Shape:
    return obj(properties, ())


def many(items: Shape, least: int = 0, most: int | None = None) -> Shape:
    return {"type": "array", "items": items, **({"minItems": least} if least else {}), **({"maxItems": most} if most else {})}


def one(*values: Any) -> Shape:
    return {"enum": list(values)}


def whole(low: int, high: int | None = None) -> Shape:
    return {"type": "integer", "minimum": low, **({"maximum": high} if high is not None else {})}


def real(**bounds: Any) -> Shape:
    return {"type": "number", **bounds}


def text(low: int = 0, high: int | None = None, pattern: str | None = None) -> Shape:
    return {"type": "string", **({"minLength": low} if low else {}), **({"maxLength": high} if high else {}), **({"pattern": pattern} if pattern else {})}


def maybe(shape: Shape) -> Shape:
    return {"anyOf": [shape, NULL]}


def ref(name: str) -> Shape:
    return {"$ref": f"#/$defs/{name}"}


def document(title: str, shape: Shape, defs: Shape | None = None) -> Shape:
    return {"$schema": _DRAFT, "title": title, **shape, **({"$defs": defs} if defs else {})}


_SHARE = real(exclusiveMinimum=0, maximum=1)
_ID = text(pattern="^[A-Za-z0-9_.-]{1,100}$")
_COLUMN: Shape = {"oneOf": [text(1, 255), many(text(1, 255), 1, 10)]}
_QUALIFIED = obj({"table": text(1), "column": text(1)})
_END = obj({"table": text(1), "columns": many(_COLUMN, 1, 32)})
CARDINALITIES = ("zero_or_one", "exactly_one", "zero_or_more", "one_or_more")
_RELATIONSHIP = obj({"id": _ID, "from": _END, "to": _END, "cardinality": obj({"from": one(*CARDINALITIES), "to": one(*CARDINALITIES)}), "description": text(0, 2000)}, ("id", "from", "to"))
OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "not_in", "between", "is_null", "is_not_null", "like")
VALUE_TYPES = ("string", "integer", "double", "decimal", "boolean", "date", "timestamp")
CHECKS = ("min_row_count", "max_row_count", "max_null_ratio", "max_null_count", "max_empty_string_ratio", "value_range")
_FILTER = obj({"column": _COLUMN, "operator": one(*OPERATORS), "value": {"type": ["string", "number", "boolean", "array"]}, "value_type": one(*VALUE_TYPES)}, ("column", "operator"))
_CHECK = obj({"id": _ID, "type": one(*CHECKS), "column": _COLUMN, "min": real(), "max": real(), "description": text(0, 1000)}, ("id", "type"))
_OPTIONS = opt({"columns": maybe(many(text(1, 255), 0, 5000)), "filters": many(_FILTER, 0, 50), "purpose": maybe(text(0, 2000)), "checks": many(_CHECK, 0, 500)})

CONFIG_SHAPE = document(
    "Configuration of a profiling run. It must hold no secrets.",
    obj(
        {
            "kind": {"const": "profilekit.config"},
            "config_version": {"const": "1.0"},
            "tables": many(text(1, 800), 0, 100),
            "analysis_level": one("metadata", "standard", "deep"),
            "output_dir": text(0, 1024),
            "purpose": maybe(text(0, 2000)),
            "limits": opt({"max_tables": whole(1, 100), "max_fields": whole(1, 5000), "max_depth": whole(1, 10), "max_expressions_per_pass": whole(10, 5000), "max_aggregate_passes": whole(1, 20)}),
            "sampling": opt({"method": one("prefix", "random", "none"), "max_rows": whole(1, 1000000), "max_bytes": whole(1024, 1073741824), "max_value_chars": whole(16, 1048576), "max_columns": whole(1, 1000), "random_fraction": maybe(_SHARE), "seed": {"type": "integer"}}),
            "consistency": opt({"pin_delta_version": BOOL}),
            "metrics": opt({"quantiles": many(real(exclusiveMinimum=0, exclusiveMaximum=1), 0, 20) | {"uniqueItems": True}, "quantile_accuracy": whole(100, 1000000), "approx_distinct_rsd": real(minimum=0.01, maximum=0.3), "json_full_scope_validation": BOOL}),
            "semantic": opt({"min_observations": whole(1, 1000000), "detect_threshold": real(exclusiveMinimum=0.5, maximum=1), "mixed_threshold": _SHARE, "confidence_level": real(minimum=0.5, maximum=0.999)}),
            "thresholds": opt(
                {
                    "high_null_ratio": _SHARE, "categorical_max_distinct": whole(2), "categorical_min_rows": whole(1), "identifier_min_distinct_ratio": _SHARE, "identifier_min_rows": whole(1),
                    "identifier_max_null_ratio": real(minimum=0, maximum=1), "json_min_ratio": _SHARE, "constant_min_rows": whole(2), "tail_iqr_multiplier": real(exclusiveMinimum=0), "large_array_size": whole(1),
                }
            ),
            "value_policy": opt({"persist_examples": BOOL, "example_columns": many(_QUALIFIED, 0, 200), "max_examples_per_column": whole(1, 50), "max_example_chars": whole(1, 1000), "aggregate_extremes": one("include", "redact"), "json_key_names": one("include", "redact"), "redact_columns": many(_QUALIFIED, 0, 1000)}),
            "deep": opt(
                {
                    "targets": {"oneOf": [{"const": "all_within_budget"}, many(_QUALIFIED, 0, 1000)]},
                    "collections": BOOL, "json_paths": BOOL, "element_distinct": one("sample", "full_scope", "off"), "json_full_scope_validation": BOOL,
                    "max_extra_passes": whole(0, 10), "max_explode_rows": whole(1, 1000000), "max_elements": whole(1, 100000000), "max_json_paths": whole(1, 1000), "max_json_depth": whole(1, 10), "max_json_object_keys": whole(1, 1000),
                    "uniqueness": opt({"keys": many(obj({"id": _ID, "table": text(1), "columns": many(_COLUMN, 1, 32)}, ("table", "columns")), 0, 1000), "declared_keys": BOOL, "identifier_candidates": BOOL, "max_keys": whole(1, 100), "max_passes": whole(1, 10)}),
                    "referential": opt({"configured": BOOL, "declared": BOOL, "mode": one("full_scope", "sample"), "max_relationships": whole(0, 100), "max_sample_rows": whole(1, 100000000)}),
                    "relationship_hypotheses": opt({"enabled": BOOL, "max_pairs": whole(0, 100), "max_sample_rows": whole(1, 100000000), "inclusion_scope": one("sample", "full_scope"), "min_inclusion_ratio": real(minimum=0, maximum=1)}),
                }
            ),
            "jobs": opt({"exit_summary": BOOL}),
            "table_options": {"type": "object", "additionalProperties": _OPTIONS},
            "relationships": many(_RELATIONSHIP, 0, 500),
        },
        ("kind", "config_version"),
    ),
)

ANNOTATIONS_SHAPE = document(
    "What people say of tables and columns; used when documents are rendered.",
    obj(
        {
            "kind": {"const": "profilekit.annotations"},
            "annotations_version": {"const": "1.0"},
            "tables": {"type": "object", "additionalProperties": opt({"description": TEXT, "purpose": TEXT, "owner": TEXT, "tags": many(TEXT), "columns": {"type": "object", "additionalProperties": opt({"description": TEXT, "purpose": TEXT, "owner": TEXT, "tags": many(TEXT)})}})},
            "relationships": many(_RELATIONSHIP),
        },
        ("kind", "annotations_version"),
    ),
)

STATUSES = ("measured", "not_computed", "unsupported", "insufficient_data", "redacted", "error", "unavailable")
SCOPES = ("table_metadata", "full_table", "filtered_table", "full_snapshot", "filtered_snapshot", "sample")
ACCURACIES = ("exact", "approximate", "as_recorded", "unknown")
SOURCES = ("catalog_metadata", "table_statistics", "table_history", "aggregate", "sample", "derived")
_ANY: Shape = {}
_NAMES = many(TEXT)
_SEGMENT = obj({"kind": one("field", "array_element", "map_key", "map_value"), "name": TEXT}, ("kind",))
_DEFS: Shape = {
    "metric": obj(
        {"name": text(1), "status": one(*STATUSES), "value": _ANY, "value_type": TEXT, "unit": maybe(TEXT), "scope": one(*SCOPES), "accuracy": one(*ACCURACIES), "source": one(*SOURCES), "method": TEXT, "reason": TEXT, "denominator": COUNT, "denominator_unit": TEXT, "details": {"type": "object"}},
        ("name", "status", "value", "scope", "accuracy", "source"),
    ),
    "node": obj(
        {"field_id": TEXT, "name": maybe(TEXT), "segment_kind": TEXT, "path": many(_SEGMENT, 1), "display_path": text(1), "parent_field_id": maybe(TEXT), "depth": whole(1), "type": obj({"kind": TEXT, "physical_type": TEXT, "precision": COUNT, "scale": {"type": "integer"}}, ("kind", "physical_type")), "nullable": {"type": ["boolean", "null"]}, "comment": maybe(TEXT), "children": many(ref("node")), "children_omitted": COUNT, "children_omitted_reason": maybe(TEXT)},
    ),
    "field": obj(
        {"field_id": TEXT, "display_path": text(1), "path": many(_SEGMENT, 1), "type_kind": TEXT, "physical_type": TEXT, "nullable": {"type": ["boolean", "null"]}, "comment": maybe(TEXT), "profiled": BOOL, "omission_reason": maybe(TEXT), "metrics": many(ref("metric")), "semantics": maybe({"type": "object"}), "json_profile": maybe({"type": "object"}), "concentration": maybe({"type": "object"}), "examples": maybe({"type": "object"}), "element_context": maybe({"type": "object"}), "json_paths": maybe({"type": "object"})},
    ),
    "omission": obj({"field_id": maybe(TEXT), "display_path": maybe(TEXT), "reason": TEXT, "detail": TEXT, "metrics": _NAMES}),
    "finding": obj({"finding_id": TEXT, "code": TEXT, "severity": one("info", "warning"), "field_id": TEXT, "display_path": TEXT, "title": TEXT, "message": TEXT, "evidence": many({"type": "object"}), "threshold": maybe({"type": "object"}), "severity_reason": TEXT, "limitations": TEXT}),
    "check": obj({"check_id": TEXT, "type": one(*CHECKS), "origin": TEXT, "target": {"type": "object"}, "parameters": {"type": "object"}, "status": one("pass", "fail", "not_evaluated", "error"), "observed": maybe({"type": "object"}), "message": TEXT, "description": maybe(TEXT)}),
    "rule": obj({"rule_id": TEXT, "table": TEXT, "column": maybe(TEXT), "rule_type": one("not_null", "unique", "accepted_values", "valid_json", "matches_format"), "parameters": {"type": "object"}, "status": {"const": "proposed"}, "requires_review": {"const": True}, "rationale": TEXT, "evidence": many({"type": "object"})}),
    "key": obj({"key_id": TEXT, "origins": _NAMES, "names": _NAMES, "columns": _NAMES, "field_ids": _NAMES, "status": one("measured", "not_computed", "not_eligible", "error"), "reason": maybe(TEXT), "outcome": {"enum": ["unique", "unique_non_null", "duplicates", "empty", None]}, "scope": TEXT, "operation_id": maybe(TEXT), "metrics": many(ref("metric")), "limitations": _NAMES}),
    "table": obj(
        {
            "table_id": TEXT, "table_key": TEXT, "identifier": obj({"input": TEXT, "parts": _NAMES, "quoted": TEXT}), "status": one("succeeded", "partial", "failed"),
            "errors": many(obj({"stage": TEXT, "type": TEXT, "condition": maybe(TEXT), "message": TEXT})), "purpose": maybe(TEXT), "source": maybe({"type": "object"}), "consistency": maybe({"type": "object"}), "scope": {"type": "object"},
            "sample": maybe({"type": "object"}), "summary": {"type": "object"}, "table_metrics": many(ref("metric")), "schema": maybe(obj({"fields": many(ref("node")), "nodes_total": COUNT, "nodes_omitted": COUNT, "top_level_omitted": COUNT, "limits": {"type": "object"}})),
            "field_profiles": many(ref("field")), "constraints": many({"type": "object"}), "findings": many(ref("finding")), "quality_checks": many(ref("check")), "suggested_rules": many(ref("rule")), "omissions": many(ref("omission")),
            "unsupported": many({"type": "object"}), "operations": {"type": "object"}, "timings_ms": {"type": "object"}, "notes": _NAMES, "deep": maybe({"type": "object"}), "uniqueness": maybe(obj({"keys": many(ref("key"))}, closed=False)),
        }
    ),
    "ends": obj({"table": TEXT, "columns": _NAMES}),
    "relationship": obj(
        {"relationship_id": TEXT, "origin": TEXT, "name": maybe(TEXT), "from": ref("ends"), "to": ref("ends"), "cardinality": maybe({"type": "object"}), "cardinality_source": maybe(TEXT), "enforcement": TEXT, "validation": one("validated", "violated", "not_validated"), "scope": TEXT, "description": maybe(TEXT), "notes": _NAMES, "validation_detail": maybe({"type": "object"})},
    ),
}
PROFILE_SHAPE = document(
    "Result of a profiling run.",
    obj(
        {
            "kind": {"const": "profilekit.profile"}, "schema_version": {"const": "1.2"}, "tool": {"type": "object"},
            "run": obj({"run_id": TEXT, "status": one("succeeded", "partial", "failed"), "analysis_level": TEXT, "started_at": TEXT, "finished_at": TEXT, "duration_ms": COUNT, "reference_time": TEXT, "environment": {"type": "object"}, "effective_config": {"type": "object"}, "config_fingerprint": TEXT, "parameter_sources": {"type": "object"}, "generation": {"type": "object"}, "purpose": maybe(TEXT), "capabilities": {"type": "object"}}),
            "value_exposure": {"type": "object"}, "tables": many(ref("table")), "relationships": many(ref("relationship")), "summary": {"type": "object"}, "referential_validation": maybe({"type": "object"}), "relationship_hypotheses": maybe({"type": "object"}),
        }
    ),
    _DEFS,
)
MANIFEST_SHAPE = document(
    "What a run wrote.",
    obj({"kind": {"const": "profilekit.run_manifest"}, "manifest_version": {"const": "1.0"}, "run_id": TEXT, "status": one("running", "succeeded", "partial", "failed"), "tool_version": TEXT, "profile_schema_version": TEXT, "started_at": TEXT, "finished_at": maybe(TEXT), "generation_id": maybe(TEXT), "files": many(obj({"path": TEXT, "sha256": TEXT, "bytes": COUNT})), "profile_validation": obj({"checked": BOOL, "valid": {"type": ["boolean", "null"]}, "errors": _NAMES}), "notes": _NAMES}),
)
JOB_SUMMARY_SHAPE = document(
    "Counts of a run, for whoever started it.",
    obj({"kind": {"const": "profilekit.job_summary"}, "summary_version": {"const": "1.0"}, "tool_version": TEXT, "run_id": TEXT, "status": TEXT, "analysis_level": TEXT, "run_dir": TEXT, "profile_valid": BOOL, "tables": {"type": "object"}, "checks": {"type": "object"}, "relationships": {"type": "object"}, "relationship_hypotheses": COUNT}),
)
RULES_SHAPE = document("Proposed rules, none of them applied.", obj({"kind": {"const": "profilekit.suggested_rules"}, "schema_version": {"const": "1.0"}, "run_id": TEXT, "profiled_at": TEXT, "notice": TEXT, "rules": many(ref("rule"))}), {"rule": _DEFS["rule"]})
SHAPES = {"config": CONFIG_SHAPE, "profile": PROFILE_SHAPE, "annotations": ANNOTATIONS_SHAPE, "manifest": MANIFEST_SHAPE, "job_summary": JOB_SUMMARY_SHAPE, "suggested_rules": RULES_SHAPE}
