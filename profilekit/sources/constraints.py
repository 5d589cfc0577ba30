"""Declared keys and the relationships that they and people state."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit import identifiers as ids

KINDS = {"PRIMARY KEY": "primary_key", "FOREIGN KEY": "foreign_key", "UNIQUE": "unique"}
DECLARED = "Declared as a FOREIGN KEY; informational keys are not enforced, so the declaration alone proves nothing about the data."
PROVIDED = "Stated by a person; the statement alone proves nothing about the data."


def key_rows(constraints: DataFrame, usage: DataFrame, references: DataFrame, schema: str, table: str) -> DataFrame:
    """The information_schema rows of one table's keys: an inner and a left join, names folded."""
    lower = lambda c: F.lower(F.col(c))
    ids_ = ["constraint_catalog", "constraint_schema", "constraint_name"]
    own = constraints.where((lower("table_schema") == schema.lower()) & (lower("table_name") == table.lower())).select(*ids_, "constraint_type")
    cols = usage.select(*ids_, "column_name", "ordinal_position", "position_in_unique_constraint")
    refs = references.select(*ids_, "unique_constraint_catalog", "unique_constraint_schema", "unique_constraint_name")
    return own.join(cols, ids_).join(refs, ids_, "left")


def query_keys(spark: SparkSession, parts: list[str]) -> tuple[list[dict[str, Any]], list[str]]:
    """Keys of a three-part table from its catalog's information_schema."""
    catalog, schema, table = parts
    view = lambda name: spark.table(f"{ids.quote(catalog)}.information_schema.{name}")
    usage = view("key_column_usage")
    rows = [r.asDict() for r in key_rows(view("table_constraints"), usage, view("referential_constraints"), schema, table).collect()]
    named = {tuple(r[f"unique_constraint_{p}"] for p in ("catalog", "schema", "name")) for r in rows if r["unique_constraint_name"]}
    targets: list[dict[str, Any]] = []
    for c, s, n in sorted(named):
        targets += [r.asDict() for r in usage.where((F.col("constraint_catalog") == c) & (F.col("constraint_schema") == s) & (F.col("constraint_name") == n)).collect()]
    return assemble(rows, targets)


def _fold(row: Mapping[str, Any], prefix: str, names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(str(row.get(prefix + n) or "").casefold() for n in names)


_WHERE = ("catalog", "schema", "name")


def assemble(rows: Iterable[Mapping[str, Any]], targets: Iterable[Mapping[str, Any]]) -> tuple[list[dict[str, Any]], list[str]]:
    """Constraints by name and notes on foreign keys that cannot be resolved. Names compare without case; the order of rows does not matter."""
    groups: dict[tuple[str, ...], list[Mapping[str, Any]]] = {}
    for r in rows:
        if " ".join(str(r.get("constraint_type") or "").upper().split()) in KINDS:
            groups.setdefault(_fold(r, "constraint_", _WHERE), []).append(r)
    by_target: dict[tuple[str, ...], list[Mapping[str, Any]]] = {}
    for r in targets:
        by_target.setdefault(_fold(r, "constraint_", _WHERE), []).append(r)
    out, notes = [], []
    for members in sorted(groups.values(), key=lambda m: (m[0]["constraint_name"].casefold(), m[0]["constraint_name"])):
        ordered = sorted({int(r["ordinal_position"]): r for r in reversed(members)}.items())
        first = members[0]
        kind = KINDS[" ".join(first["constraint_type"].upper().split())]
        referenced = None
        if kind == "foreign_key":
            ref = next((r for r in members if r.get("unique_constraint_name")), None)
            found = by_target.get(_fold(ref, "unique_constraint_", _WHERE), []) if ref else []
            referenced, problem = _resolve([r for _, r in ordered], ref, found)
            if problem:
                notes.append(f"Foreign key {first['constraint_name']}: {problem}, so the relationship is not documented.")
        out.append({"name": first["constraint_name"], "constraint_type": kind, "columns": [r["column_name"] for _, r in ordered], "expression": None, "referenced": referenced, "enforcement": "not_enforced", "source": "information_schema"})
    return out, notes


def _resolve(ordered: list[Mapping[str, Any]], ref: Mapping[str, Any] | None, found: list[Mapping[str, Any]]) -> tuple[dict[str, Any] | None, str | None]:
    if ref is None:
        return None, "no referenced constraint is listed"
    if not found:
        return None, "the columns of the referenced constraint are not visible"
    names = {int(r["ordinal_position"]): r["column_name"] for r in found}
    want = [int(r["position_in_unique_constraint"] or k) for k, r in enumerate(ordered, 1)]
    if len({_fold(r, "table_", _WHERE) for r in found}) != 1 or sorted(want) != sorted(names):
        return None, "its columns do not match those of the referenced constraint"
    return {"table": ids.table_key([found[0][f"table_{n}"] for n in _WHERE]), "columns": [names[p] for p in want]}, None


def _relationship(rel_id: str, origin: str, name: str, start: dict[str, Any], end: dict[str, Any], **more: Any) -> dict[str, Any]:
    base = {"relationship_id": rel_id, "origin": origin, "name": name, "from": start, "to": end, "cardinality": None, "cardinality_source": None, "enforcement": "unknown", "validation": "not_validated", "scope": "human_provided", "description": None, "notes": [PROVIDED], "validation_detail": None}
    return base | more


def declared(table: str, constraints: Iterable[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Relationships from a table's resolved foreign keys."""
    return [
        _relationship(f"declared:{table}:{c['name']}", "declared_constraint", c["name"], {"table": table, "columns": list(c["columns"])}, {"table": c["referenced"]["table"], "columns": list(c["referenced"]["columns"])}, enforcement=c["enforcement"], scope="declared_metadata", notes=[DECLARED])
        for c in constraints
        if c["constraint_type"] == "foreign_key" and c.get("referenced")
    ]


def provided(items: Iterable[Mapping[str, Any]], origin: str) -> list[dict[str, Any]]:
    """Relationships that a configuration or annotations state; only these have a cardinality."""

    def end(e: Mapping[str, Any]) -> dict[str, Any]:
        return {"table": ids.table_key(ids.parse_table(e["table"])), "columns": [ids.display(ids.reference(c)) for c in e["columns"]]}

    return [
        _relationship(f"{origin}:{x['id']}", origin, x["id"], end(x["from"]), end(x["to"]), cardinality=dict(x["cardinality"]) if x.get("cardinality") else None, cardinality_source="provided" if x.get("cardinality") else None, description=x.get("description"))
        for x in items
    ]


def merged(*groups: Iterable[dict[str, Any]]) -> list[dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {}
    for g in groups:
        for r in g:
            out.setdefault(r["relationship_id"], r)
    return list(out.values())
