"""Records of the profile document, from rows of the result frames."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING, Any

from profilekit import __version__, encoding
from profilekit import identifiers as ids
from profilekit.operators import judge, json_docs, keys, referential
from profilekit.plans import registry
from profilekit.plans.measure import MeasurePlan
from profilekit.plans.targets import DeepTargets
from profilekit.plans.tree import Node, Tree
from profilekit.sources.tables import Source

if TYPE_CHECKING:
    from profilekit.runner import Profiled, Run

KIND, SCHEMA_VERSION = "profilekit.profile", "1.2"
TARGET_NOTE = "The target is read in full at its recorded version, without its filters: a reference holds if its key is anywhere in the target table."
NULL_KEYS = "A row with NULL in any key column is counted apart and is neither distinct nor a duplicate, as in a SQL UNIQUE constraint; a PRIMARY KEY also forbids NULLs, so it holds only for the outcome 'unique'."
SAMPLE_NOTES = {"prefix": "The first rows that the engine produces; possibly biased.", "random": "Bernoulli sampling may read every row in scope; the fraction does not reduce I/O in proportion."}


# metrics


def metric(name: str, value: Any, unit: str | None, scope: str, *, value_type: str = "integer", accuracy: str = "exact", source: str = "aggregate", method: str = "", denominator: int | None = None, denominator_unit: str | None = None, details: Mapping[str, Any] | None = None) -> dict[str, Any]:
    out = {"name": name, "status": "measured", "value": value, "value_type": value_type, "unit": unit, "scope": scope, "accuracy": accuracy, "source": source, "method": method}
    if denominator is not None:
        out |= {"denominator": denominator, "denominator_unit": denominator_unit or ""}
    return out | ({"details": dict(details)} if details else {})


def absent(name: str, status: str, reason: str, scope: str, source: str = "aggregate", unit: str | None = None) -> dict[str, Any]:
    return {"name": name, "status": status, "value": None, "unit": unit, "scope": scope, "accuracy": "unknown", "source": source, "reason": reason}


def ratio(name: str, part: int, whole: int, unit: str, scope: str, method: str) -> dict[str, Any]:
    if not whole:
        return absent(name, "insufficient_data", f"undefined: no {unit} in scope (denominator is 0)", scope, "derived", "ratio")
    return metric(name, part / whole, "ratio", scope, value_type="ratio", source="derived", method=method, denominator=whole, denominator_unit=unit)


def from_row(r: Mapping[str, Any]) -> dict[str, Any]:
    """A metric record from a row of the long frame."""
    if r["status"] != "measured":
        return absent(r["metric"], r["status"], r["reason"] or "", r["scope"], r["source"], r["unit"])
    return metric(r["metric"], encoding.decode(r["value"], r["value_type"]), r["unit"], r["scope"], value_type=r["value_type"], accuracy=r["accuracy"], source=r["source"], method=r["method"] or "", denominator=r["denominator"], denominator_unit=r["denominator_unit"], details=json.loads(r["details"]) if r["details"] else None)


def value_of(metrics: Sequence[Mapping[str, Any]], name: str) -> Any:
    return next((m["value"] for m in metrics if m["name"] == name and m["status"] == "measured"), None)


# tables


def new_table(name: str) -> dict[str, Any]:
    try:
        parts = ids.parse_table(name)
    except ids.IdentifierError:
        parts = [name]
    return {
        "table_id": ids.table_id(parts), "table_key": ids.table_key(parts), "identifier": {"input": name, "parts": parts, "quoted": ids.quote_table(parts)}, "status": "failed", "errors": [], "purpose": None, "source": None, "consistency": None,
        "scope": {"population": "full", "scope_label": "table_metadata", "filters": [], "selected_columns": None, "row_semantics": "Rows in scope after filters. Nothing is deduplicated: row counts are not counts of business entities."},
        "sample": None, "summary": {}, "table_metrics": [], "schema": None, "field_profiles": [], "constraints": [], "findings": [], "quality_checks": [], "suggested_rules": [], "omissions": [], "unsupported": [],
        "operations": {"planned": [], "observed": [], "physical_scans": "unknown", "bytes_read": "unknown", "monetary_cost": "unknown"}, "timings_ms": {}, "notes": [], "deep": None, "uniqueness": None,
    }


def source_record(source: Source) -> dict[str, Any]:
    m, d = source.metadata, source.detail
    kind = m.get("Type")

    def recorded(name: str, key: str, unit: str) -> dict[str, Any]:
        if d.get(key) is None:
            return absent(name, "unavailable", "not provided by catalog metadata for this source", "table_metadata", "catalog_metadata")
        return metric(name, int(d[key]), unit, "table_metadata", accuracy="as_recorded", source="catalog_metadata", method=f"DESCRIBE DETAIL {key} (latest state)")

    return {
        "source_type": "path" if source.is_path else "unknown" if not kind else "view" if "VIEW" in kind.upper() else "table", "table_type": kind, "provider": m.get("Provider"), "comment": m.get("Comment"),
        "created_at": d.get("createdAt") or m.get("Created Time"), "last_modified": d.get("lastModified"), "partition_columns": list(d.get("partitionColumns") or []), "clustering_columns": list(d.get("clusteringColumns") or []),
        "size_in_bytes": recorded("size_in_bytes", "sizeInBytes", "bytes"), "file_count": recorded("file_count", "numFiles", "files"), "metadata_state": "current_at_capture", "captured_at": encoding.utc(encoding.now()),
        "notes": ["Catalog metadata describe the table when they were captured, not necessarily the pinned snapshot."],
    }


def consistency(source: Source, level: str) -> dict[str, Any]:
    if level == "metadata":
        mode, text = "metadata_only", "Metadata only: no rows were read."
    elif source.pinned:
        mode, text = "pinned_delta_version", f"All reads used Delta version {source.version}, resolved at the start."
    else:
        mode, text = "unpinned", "No snapshot was pinned: the sample and each pass read the source on their own and may see different data if it changes."
    return {"mode": mode, "delta_version": source.version, "version_timestamp": source.version_time, "guarantee": text, "notes": []}


def recorded_row_count(rows: int | None) -> dict[str, Any]:
    if rows is None:
        return absent("row_count", "unavailable", "no row count is recorded in catalog statistics; the metadata level scans no rows", "table_metadata", "table_statistics")
    return metric("row_count", rows, "rows", "table_metadata", accuracy="as_recorded", source="table_statistics", method="row count recorded in catalog statistics", details={"freshness": "unknown"})


def sample_record(sampling: Mapping[str, Any], chosen: Sequence[Node], omitted: int) -> dict[str, Any]:
    method, on = sampling["method"], bool(chosen)
    note = "Values are inspected for formats and JSON and are not kept." if on else "sampling is disabled (sampling.method = none)" if method == "none" else "no string fields to inspect"
    return {
        "enabled": on, "method": method, "biased": {"prefix": True, "random": False}.get(method), "reads_full_source": True if method == "random" else None, **{k: sampling[k] for k in ("max_rows", "max_bytes", "max_value_chars", "random_fraction", "seed")},
        "rows_collected": None, "bytes_retained": None, "values_truncated": None, "stopped_reason": "error" if on else "disabled" if method == "none" else "not_applicable", "fields_sampled": len(chosen), "fields_omitted": omitted, "notes": [note, *([SAMPLE_NOTES[method]] if on else [])],
    }


def _limits(method: str, n: int) -> list[str]:
    out = [f"Inferred from {n} sampled value(s); not guaranteed for the population.", "Intervals assume independent sampling; they remove no bias and establish no meaning."]
    return out + ([SAMPLE_NOTES["prefix"]] if method == "prefix" else [])


def observed_format(f: Mapping[str, Any], config: Mapping[str, Any]) -> dict[str, Any]:
    s = config["semantic"]
    candidates = [{"format": c["format"], "matches": c["matches"], "match_ratio": c["match_ratio"], "interval": {"method": "wilson_score", "level": s["confidence_level"], "low": c["low"], "high": c["high"]}, **({"with_offset": c["with_offset"]} if c["with_offset"] is not None else {})} for c in f["candidates"]]
    out = {
        "status": f["status"], "format": f["format"], "scope": "sample", "eligible_observations": f["eligible"], "excluded": {k: f[k] for k in ("sql_null", "truncated", "blank")}, "min_observations": s["min_observations"],
        "thresholds": {"detect": s["detect_threshold"], "mixed": s["mixed_threshold"]}, "candidates": candidates, "method": "rule-based detectors with strict parsing", "limitations": _limits(config["sampling"]["method"], f["eligible"]),
    }
    return out | ({"reason": f["reason"]} if f["reason"] else {})


def json_shape(s: Mapping[str, Any], types: Sequence[Mapping[str, Any]], named: bool, method: str, counted: Mapping[str, Any]) -> dict[str, Any]:
    why = None
    if not s["n_keys"]:
        why = "no JSON objects observed"
    elif not named:
        why = "value policy (json_key_names = redact)"
    elif s["n_keys"] > json_docs.MAX_LISTED_KEYS:
        why = f"{s['n_keys']} distinct keys (more than {json_docs.MAX_LISTED_KEYS}): objects look like maps"
    elif s["odd_keys"]:
        why = "some keys do not look like names of fields"
    listed = None if why else [{"key": t["key"], "present_in": t["present_in"], "presence_ratio": t["presence_ratio"], "types": {x["type"]: x["n"] for x in t["types"]}} for t in types]
    return {
        "scope": "sample", "eligible_observations": s["eligible"], "excluded": {k: counted[k] for k in ("sql_null", "truncated")}, "counts": {k: s[k] for k in ("object", "array", "scalar", "json_null_literal", "invalid")}, "valid_ratio": s["valid_ratio"],
        "heterogeneity": {k: s[k] for k in ("top_level_kinds_present", "distinct_object_key_sets", "keys_with_conflicting_types")}, "keys": listed, "keys_omitted_reason": why, "limitations": [*_limits(method, s["eligible"]), "The sample's shape is no complete or guaranteed schema."],
    }


def json_catalogue(paths: Sequence[Mapping[str, Any]], shape: Mapping[str, Any] | None, config: Mapping[str, Any]) -> dict[str, Any]:
    deep, records = config["deep"], []
    for p in paths:
        checks = p.get("full_scope") or []
        unit = p.get("documents_in_scope")
        measured = [metric(c["metric"], c["value"], "documents", "full_table", method=c["method"], denominator=unit, denominator_unit="documents", details={k: v for k, v in c["detail"].items() if v is not None and k != "json_path"}) for c in checks]
        reason = None if measured else "wildcard path, or beyond the budget of the deep level" if deep["json_full_scope_validation"] else "disabled (deep.json_full_scope_validation = false)"
        records.append({
            "path": p["json_path"], "depth": p["depth"], "present_in": p["present_in"], "presence_ratio": p["presence_ratio"], "occurrences": p["occurrences"], "types": {t: p[f"n_{t}"] for t in sorted(json_docs.TYPES) if p[f"n_{t}"]}, "heterogeneous": p["heterogeneous"],
            "dominant_type": p["dominant_type"], "map_like": p["map_like"], "full_scope": {"status": "measured" if measured else "not_computed", "reason": reason, "metrics": measured},
        })
    documents = paths[0]["documents"] if paths else (shape["counts"]["object"] + shape["counts"]["array"] if shape else 0)
    hidden = config["value_policy"]["json_key_names"] == "redact"
    return {
        "scope": "sample", "documents": documents, "max_depth": deep["max_json_depth"], "depth_truncated": any(p["deeper"] for p in paths), "paths_listed": 0 if hidden else len(records), "paths": None if hidden else records,
        "paths_omitted_reason": "value policy (json_key_names = redact)" if hidden else None if records else "no JSON objects or arrays in the sample", "heterogeneous_paths": sum(r["heterogeneous"] for r in records), "map_like_paths": sum(r["map_like"] for r in records),
        "method": "strict JSON parsing of sampled values, breadth first to deep.max_json_depth; keys that look like data become '*'", "limitations": ["Paths of a sample are no complete schema: others may exist."],
    }


def _distinct_metric(x: Mapping[str, Any], unit: str, scope: str) -> dict[str, Any]:
    if x["status"] != "measured":
        return absent("distinct_count", x["status"], x["reason"], scope)
    return metric("distinct_count", x["value"], unit, x["scope"], method=registry.DERIVED["distinct_count"], denominator=x["denominator"] or None, denominator_unit=unit)


def add_fields(record: dict[str, Any], tree: Tree, nodes: Sequence[Node], members: Sequence[Node], reason: str | None, rows: Sequence[Mapping[str, Any]] = (), distinct: Mapping[str, Mapping[str, Any]] | None = None, contexts: Mapping[str, dict[str, Any]] | None = None, semantic: Mapping[str, Mapping[str, Any]] | None = None, paths: Mapping[str, Sequence[Mapping[str, Any]]] | None = None, level: str = "") -> None:
    """A record for every documented field, with what was measured of it, or why nothing was."""
    by_path: dict[str | None, list[dict[str, Any]]] = {}
    for r in sorted(rows, key=lambda r: (registry.ORDER.get(r["metric"], 99), r["position"])):
        by_path.setdefault(r["path"], []).append(from_row(r))
    record["table_metrics"] += by_path.get(None, [])
    known, why = {n.path for n in [*nodes, *members]}, {o["field_id"]: o["reason"] for o in record["omissions"]}
    distinct, contexts, semantic, paths = distinct or {}, contexts or {}, semantic or {}, paths or {}
    scope = record["scope"]["scope_label"]
    for node in tree:
        profiled = node.path in known
        metrics = by_path.get(node.display, [])
        unit = contexts.get(node.field_id, {}).get("unit", "values")
        if node.display in distinct:
            metrics = [*metrics, _distinct_metric(distinct[node.display], unit, scope)]
        s = semantic.get(node.display)
        lost = None if profiled else reason or why.get(node.field_id) or _inherited(node, why)
        c = s["concentration"] if s else None
        record["field_profiles"].append({
            "field_id": node.field_id, "display_path": node.display, "path": [x.record() for x in node.path], "type_kind": node.kind, "physical_type": node.physical, "nullable": node.nullable, "comment": node.comment, "profiled": profiled, "omission_reason": lost,
            "metrics": metrics, "semantics": {"observed_format": s["format"], "candidate_roles": []} if s else {"observed_format": None, "candidate_roles": []} if profiled and not node.in_collection else None,
            "json_profile": s["json"] if s else None,
            "concentration": {"scope": "sample", "accuracy": "exact_for_sample", "observations": c["observations"], "sample_distinct_count": c["distinct_count"], "top_1_share": c["top_1_share"], "top_5_share": c["top_5_share"]} if c else None,
            "examples": {"scope": "sample", "policy": "allow-listed by value_policy.example_columns", "values": s["examples"]} if s and s["examples"] else None,
            "element_context": contexts.get(node.field_id), "json_paths": list(paths[node.display]) if node.display in paths else None,
        })


def _inherited(node: Node, why: Mapping[str | None, str]) -> str:
    parent = node.parent
    while parent is not None:
        if parent.field_id in why:
            return why[parent.field_id]
        parent = parent.parent
    return "inside_collection" if node.in_collection else "not_selected"


def deep_record(config: Mapping[str, Any], deep: DeepTargets, plan: MeasurePlan, paths: Mapping[str, Any]) -> dict[str, Any]:
    d = config["deep"]
    limited = [{"item": o["display_path"], "reason": "deep_budget", "detail": o["detail"]} for o in plan.omissions if o["reason"] == "deep_budget"]
    return {
        "targets": "explicit" if deep.explicit else d["targets"], "requested_targets": deep.requested, "not_eligible": deep.not_eligible, "collections": [n.display for n in deep.collections], "json_fields": sorted(paths),
        "budget": {k: d[k] for k in ("max_extra_passes", "max_explode_rows", "max_elements", "max_json_paths", "max_json_depth", "max_json_object_keys")}, "extra_passes": len(plan.passes) - plan.standard_passes,
        "expressions": sum(s.metric.cost for s in plan.specs if s.group != "standard"), "element_distinct": d["element_distinct"], "limited": limited, "notes": [],
    }


# keys and relationships

_KEY_UNITS = {"distinct_keys": "keys", "duplicate_key_groups": "keys"}
_KEY_BASIS = {"rows_with_null_key": "rows_in_scope", "rows_with_complete_key": "rows_in_scope", "duplicate_key_groups": "distinct_keys", "rows_in_duplicate_groups": "rows_with_complete_key", "surplus_duplicate_rows": "rows_with_complete_key"}
_KEY_DERIVED = ("rows_with_complete_key", "surplus_duplicate_rows")


def key_metrics(r: Mapping[str, Any], scope: str) -> list[dict[str, Any]]:
    out = []
    for name in keys.METRICS:
        if r[name] is None:
            out.append(absent(name, "insufficient_data", "no rows with a complete key in scope", scope))
            continue
        basis = _KEY_BASIS.get(name)
        out.append(metric(name, r[name], _KEY_UNITS.get(name, "rows"), scope, source="derived" if name in _KEY_DERIVED else "aggregate", method="grouped aggregation over the key", denominator=(r[basis] or None) if basis else None, denominator_unit="keys" if basis == "distinct_keys" else "rows"))
    return out


def uniqueness(plan: Mapping[str, Any], got: Mapping[str, Mapping[str, Any]], config: Mapping[str, Any], scope: str, asked: bool) -> dict[str, Any]:
    u, records = config["deep"]["uniqueness"], []
    for k in plan["keys"]:
        r = got.get(k["key_id"])
        status = k["status"] if k["status"] != "planned" else "measured" if r else "error"
        records.append({
            **{n: k[n] for n in ("key_id", "origins", "names", "columns", "field_ids")}, "status": status, "reason": k["reason"] or (None if r else "the uniqueness pass failed"), "outcome": r["outcome"] if r else None, "scope": scope, "operation_id": k["operation_id"],
            "metrics": key_metrics(r, scope) if r else [], "limitations": ["Floating-point keys are compared as Spark groups them: NaN equals NaN, -0.0 equals 0.0."] if k["floats"] and r else [],
        })
    return {
        "keys": records, "sources": {"configured": any("configured" in k["origins"] for k in plan["keys"]), "declared_keys": u["declared_keys"], "identifier_candidates": u["identifier_candidates"]},
        "budget": {"max_keys": u["max_keys"], "max_passes": u["max_passes"]}, "passes": {"budget": u["max_passes"], "planned": len(plan["passes"])}, "limited": plan["limited"], "null_semantics": NULL_KEYS,
        "notes": [] if asked else ["No key was requested for this table (deep.uniqueness)."],
    }


def _side(record: Mapping[str, Any], columns: Sequence[str], scope: str) -> dict[str, Any]:
    c = record["consistency"] or {}
    return {"table": record["table_key"], "columns": list(columns), "scope": scope, "consistency_mode": c.get("mode"), "delta_version": c.get("delta_version")}


def _pair_metrics(r: Mapping[str, Any], scope: str, target_scope: str, hypothesis: bool) -> list[dict[str, Any]]:
    rows, whole, distinct, t = r["source_rows"], r["source_rows_with_complete_key"], r["target_distinct_keys"], r["target_rows"]

    def count(name: str, value: int, unit: str, where: str, of: int | None = None, of_unit: str = "rows", source: str = "aggregate") -> dict[str, Any]:
        return metric(name, value, unit, where, source=source, method=referential_method(name), denominator=of or None, denominator_unit=of_unit)

    out = [count("source_rows", rows, "rows", scope), count("source_rows_with_null_key", r["source_rows_with_null_key"], "rows", scope, rows), count("source_rows_with_complete_key", whole, "rows", scope, rows, source="derived")]
    if hypothesis:
        out += [count("included_rows", r["included_rows"], "rows", scope, whole), ratio("inclusion_ratio", r["included_rows"], whole, "rows", scope, "included_rows / source_rows_with_complete_key")]
    else:
        out += [count("orphan_rows", r["orphan_rows"], "rows", scope, whole), ratio("orphan_ratio", r["orphan_rows"], whole, "rows", scope, "orphan_rows / source_rows_with_complete_key")]
    return out + [count("target_rows", t, "rows", target_scope), count("target_rows_with_null_key", r["target_rows_with_null_key"], "rows", target_scope, t), count("target_distinct_keys", distinct, "keys", target_scope), count("target_duplicate_key_groups", r["target_duplicate_key_groups"], "keys", target_scope, distinct, "keys")]


def referential_method(name: str) -> str:
    return {"orphan_rows": "source rows with a complete key that no target row has", "included_rows": "source rows with a complete key found among the target keys", "source_rows_with_complete_key": "source_rows less source_rows_with_null_key"}.get(name, "both sides grouped by key")


def validation_detail(r: Mapping[str, Any] | None, reason: str, settings: Mapping[str, Any] | None = None, a: Mapping[str, Any] | None = None, b: Mapping[str, Any] | None = None, pairs: Sequence[tuple[Node, Node]] = (), op: str | None = None) -> dict[str, Any]:
    types = [{"from_column": x.display, "from_type": x.physical, "to_column": y.display, "to_type": y.physical, "compatible": True, "rule": referential.compatible(x.data_type, y.data_type)[1]} for x, y in pairs]
    base = {"status": "not_validated", "reason": reason, "mode": None, "from": None, "to": None, "operation_id": op, "type_compatibility": types, "target_key_unique": None, "metrics": [], "limitations": []}
    if r is None or settings is None or a is None or b is None:
        return base
    mode = settings["mode"]
    scope, target = "sample" if mode == "sample" else a["scope"]["scope_label"], "full_snapshot" if (b["consistency"] or {}).get("delta_version") is not None else "full_table"
    why = None
    if not r["source_rows_with_complete_key"]:
        why = "no source row with a complete key was examined"
    elif r["status"] == "not_validated":
        why = f"no orphan among at most {settings['max_sample_rows']} sampled source rows; a sample cannot validate the whole scope"
    notes = [TARGET_NOTE, *(["Source rows come from a bounded sample; the counts describe it alone."] if mode == "sample" else [])]
    notes += [f"{x['table_key']} is not pinned to a version; it was read in its current state." for x in (a, b) if (x["consistency"] or {}).get("mode") != "pinned_delta_version"]
    return base | {"status": r["status"], "reason": why, "mode": mode, "from": _side(a, [x.display for x, _ in pairs], scope), "to": _side(b, [y.display for _, y in pairs], target), "target_key_unique": r["target_key_unique"], "metrics": _pair_metrics(r, scope, target, False), "limitations": notes}


def referential_summary(rels: Sequence[Mapping[str, Any]], config: Mapping[str, Any], planned: int, limited: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    s = config["deep"]["referential"]
    n = [r["validation"] for r in rels]
    return {"requested": {k: s[k] for k in ("configured", "declared")}, "mode": s["mode"], "budget": {k: s[k] for k in ("max_relationships", "max_sample_rows")}, "planned": planned, **{k: n.count(k) for k in ("validated", "violated", "not_validated")}, "limited": list(limited), "notes": [TARGET_NOTE, "Orphan values are never collected."]}


def hypothesis(number: int, p: Mapping[str, Any], r: Mapping[str, Any], settings: Mapping[str, Any], a: Mapping[str, Any], b: Mapping[str, Any], left: Node, right: Node, op: str) -> dict[str, Any]:
    sample = settings["inclusion_scope"] == "sample"
    scope, target = "sample" if sample else a["scope"]["scope_label"], "full_table"
    notes = ["Inclusion does not prove that the columns mean the same.", "No cardinality is asserted and no edge is drawn; a person has to confirm it.", *([f"Measured on at most {settings['max_sample_rows']} source rows."] if sample else [])]
    evidence = {"metrics": _pair_metrics(r, scope, target, True), "target_key_unique": r["target_key_unique"], "range_relation": p["range_relation"], "range_basis": p["range_basis"], "type_rule": referential.compatible(left.data_type, right.data_type)[1], "scope": scope}
    return {"hypothesis_id": f"hyp_{number}", "status": "hypothesis", "from": {"table": p["from_table"], "columns": [p["from_path"]]}, "to": {"table": p["to_table"], "columns": [p["to_path"]]}, "cardinality": None, "evidence": evidence, "operation_id": op, "limitations": notes}


def hypotheses(config: Mapping[str, Any], targets: int = 0, every: Sequence[Mapping[str, Any]] = (), considered: Sequence[Any] = (), evaluated: int = 0, rejected: Mapping[str, int] | None = None, found: Sequence[Mapping[str, Any]] = (), reason: str | None = None) -> dict[str, Any]:
    s = config["deep"]["relationship_hypotheses"]
    gone = [p["excluded"] for p in every]
    return {
        "enabled": s["enabled"], "reason": reason, "budget": {k: s[k] for k in ("max_pairs", "max_sample_rows", "inclusion_scope", "min_inclusion_ratio")}, "targets": targets, "pairs_considered": len(considered), "pairs_evaluated": evaluated,
        "pairs_not_evaluated": len(considered) - evaluated, "pairs_known_excluded": gone.count("known"), "pairs_disjoint_excluded": gone.count("disjoint"), "pairs_rejected": dict(rejected or {}), "hypotheses": list(found),
        "method": "Targets are single-column keys measured exactly unique in this run; sources are profiled columns of a compatible type whose measured range is not disjoint. Names are not used.",
        "limitations": ["Composite relationships are not looked for.", "Pairs beyond max_pairs and pairs with disjoint ranges are not measured: a missing hypothesis is no evidence."],
    }


# judgements


def _title(f: Mapping[str, Any]) -> dict[str, Any]:
    severity, title, why, limits = judge.FINDINGS[f["code"]]
    limit = {"name": f["threshold_name"], "value": f["threshold_value"]} if f["threshold_name"] else None
    return {"finding_id": "fd_" + encoding.short_hash([f["code"], f["field_id"]]), "code": f["code"], "severity": severity, "field_id": f["field_id"], "display_path": f["path"], "title": title, "message": f["message"], "evidence": json.loads(f["evidence"]), "threshold": limit, "severity_reason": why, "limitations": limits}


def _check(c: Mapping[str, Any], asked: Mapping[str, Any]) -> dict[str, Any]:
    observed = {"metric": c["type"], "value": c["observed"]} if c["observed"] is not None else None
    return {"check_id": c["check_id"], "type": c["type"], "origin": "configured", "target": {"table": c["table"], "column": c["path"]}, "parameters": asked["parameters"], "status": c["status"], "observed": observed, "message": c["message"], "description": asked["description"]}


_RATIONALE = {
    "not_null": "No nulls were observed although the column is declared nullable.", "accepted_values": "Few distinct values were observed; the accepted set is for a data owner to define.", "valid_json": "Sampled values parse as JSON.", "matches_format": "Sampled values consistently match this format.",
    "exact uniqueness check": "Exact uniqueness check: no duplicates in the analysed scope. This says nothing about future data.", "approximate distinct count": "The approximate distinct count is close to the number of values; confirm it with deep.uniqueness before adopting it.",
}


def _rule(r: Mapping[str, Any]) -> dict[str, Any]:
    p = json.loads(r["parameters"])
    p = {"values": None} if r["rule_type"] == "accepted_values" else p
    identity = [r["table"], r["path"], r["rule_type"], *([p] if r["path"] is None else [])]
    return {"rule_id": "sr_" + encoding.short_hash(identity), "table": r["table"], "column": r["path"], "rule_type": r["rule_type"], "parameters": p, "status": "proposed", "requires_review": True, "rationale": _RATIONALE.get(r["basis"], _RATIONALE.get(r["rule_type"], r["basis"])), "evidence": [{"basis": r["basis"]}]}


def add_judgements(tables: Sequence[Profiled], findings: Sequence[Any], rules: Sequence[Any], checks: Sequence[Any], asked: Sequence[Mapping[str, Any]], roles: Sequence[Any], every_check: Mapping[str, Sequence[Mapping[str, Any]]]) -> None:
    """Roles, findings, checks, rules, summary and status of each table."""
    for t in tables:
        record, key = t.record, t.record["table_key"]
        fields = {f["display_path"]: f for f in record["field_profiles"]}
        for r in roles:
            if r["table"] == key and fields[r["path"]]["semantics"] is not None:
                fields[r["path"]]["semantics"]["candidate_roles"].append({"role": r["role"], "evidence": json.loads(r["evidence"]), "limitations": judge.ROLE_LIMITS[r["role"]]})
        record["findings"] = [_title(f.asDict()) for f in findings if f["table"] == key]
        record["suggested_rules"] = sorted((_rule(r.asDict()) for r in rules if r["table"] == key), key=lambda r: (list(fields).index(r["column"]) if r["column"] in fields else 1 << 30, r["rule_type"]))
        evaluated = {c["check_id"]: _check(c.asDict(), asked[c["position"]]) for c in checks if c["table"] == key}
        missing = lambda c: {"check_id": c["check_id"], "type": c["type"], "origin": "configured", "target": {"table": key, "column": c["path"]}, "parameters": c["parameters"], "status": "not_evaluated", "observed": None, "message": "the table could not be profiled, or rows were not read", "description": c["description"]}
        record["quality_checks"] = [evaluated.get(c["check_id"]) or missing(c) for c in every_check.get(key, [])]
        stages = {e["stage"] for e in record["errors"]}
        record["status"] = "failed" if record["schema"] is None or "resolve" in stages else "partial" if stages else "succeeded"
        for f in fields.values():
            f["json_paths"] = json_catalogue(f["json_paths"], f["json_profile"], t.config) if f["json_paths"] is not None else None
        record["summary"] = {
            "top_level_columns": len(record["schema"]["fields"]) + record["schema"]["top_level_omitted"] if record["schema"] else None, "columns_selected": len(record["scope"]["selected_columns"]) if record["scope"]["selected_columns"] is not None else None,
            "schema_nodes": record["schema"]["nodes_total"] if record["schema"] else None, "fields_profiled": sum(f["profiled"] for f in fields.values()), "fields_omitted": len({o["field_id"] for o in record["omissions"] if o["field_id"]}),
            "findings": len(record["findings"]), "quality_checks": len(record["quality_checks"]), "suggested_rules": len(record["suggested_rules"]),
        }


def exposure(config: Mapping[str, Any]) -> dict[str, Any]:
    p = config["value_policy"]
    notes = ["Profiles reveal schema, comments and aggregates; they are not anonymised.", "Sampled values are inspected where the data are and kept only for allow-listed columns.", "Filter values are recorded, since they define the population."]
    if p["aggregate_extremes"] == "include":
        notes.append("Min, max, mean and quantiles are included; value_policy.aggregate_extremes = redact omits them.")
    return {"raw_values_persisted": bool(p["persist_examples"] and p["example_columns"]), "example_columns": list(p["example_columns"]) if p["persist_examples"] else [], "aggregate_extremes": p["aggregate_extremes"], "json_key_names": p["json_key_names"], "redacted_columns": list(p["redact_columns"]), "notes": notes}


def run_status(statuses: Sequence[str]) -> str:
    return "failed" if not statuses or set(statuses) == {"failed"} else "succeeded" if set(statuses) == {"succeeded"} else "partial"


def profile(run: Run, finished: dt.datetime, tables: list[dict[str, Any]], rels: list[dict[str, Any]], referential_record: dict[str, Any] | None, hypotheses_record: dict[str, Any] | None, generation: Mapping[str, Any], sources: Mapping[str, Any], environment: Mapping[str, Any], can: Mapping[str, bool]) -> dict[str, Any]:
    config = run.config
    status = [t["status"] for t in tables]
    checks = [c["status"] for t in tables for c in t["quality_checks"]]
    found = [f["severity"] for t in tables for f in t["findings"]]
    outcomes = [k["outcome"] for t in tables for k in (t["uniqueness"] or {"keys": []})["keys"] if k["status"] == "measured"]
    valid = [r["validation"] for r in rels]
    return {
        "kind": KIND, "schema_version": SCHEMA_VERSION, "tool": {"name": "profilekit", "version": __version__},
        "run": {
            "run_id": run.run_id, "status": run_status(status), "analysis_level": run.level, "started_at": encoding.utc(run.started), "finished_at": encoding.utc(finished), "duration_ms": max(0, round((finished - run.started).total_seconds() * 1000)), "reference_time": encoding.utc(run.reference),
            "environment": dict(environment), "effective_config": dict(config), "config_fingerprint": encoding.fingerprint(config), "parameter_sources": dict(sources), "generation": dict(generation), "purpose": config["purpose"], "capabilities": dict(can),
        },
        "value_exposure": exposure(config), "tables": tables, "relationships": rels,
        "summary": {
            "tables_total": len(tables), **{f"tables_{s}": status.count(s) for s in ("succeeded", "partial", "failed")}, "fields_profiled": sum(t["summary"].get("fields_profiled") or 0 for t in tables),
            "checks": {s: checks.count(s) for s in ("pass", "fail", "not_evaluated", "error")}, "findings": {s: found.count(s) for s in ("info", "warning")}, "suggested_rules": sum(len(t["suggested_rules"]) for t in tables),
            "uniqueness": {"keys_measured": len(outcomes), **{o: outcomes.count(o) for o in ("unique", "unique_non_null", "duplicates", "empty")}}, "relationships": {v: valid.count(v) for v in ("validated", "violated", "not_validated")},
            "relationship_hypotheses": len((hypotheses_record or {"hypotheses": []})["hypotheses"]),
        },
        "referential_validation": referential_record, "relationship_hypotheses": hypotheses_record,
    }
