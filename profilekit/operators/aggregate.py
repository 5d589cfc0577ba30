"""Shared aggregation: one wide row a pass, then one long row a metric.

All metrics of a table are expressions of a few ``agg`` calls over one frame, so Spark reads the columns once a pass
and combines on the map side; only one row a task is shuffled. The long frame states for each number its status,
scope, accuracy, source and denominator.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.encoding import safe_message
from profilekit.operators import quantiles
from profilekit.plans import registry
from profilekit.plans.measure import MeasurePlan, Spec, owner_of
from profilekit.plans.registry import Metric
from profilekit.plans.tree import Node

LONG = (
    "table string, path string, field_id string, kind string, metric string, status string, value string, number double, value_type string, unit string, "
    "scope string, accuracy string, source string, denominator bigint, denominator_unit string, reason string, method string, details string, position int"
)
_META = "path string, field_id string, kind string, metric string, value_type string, unit string, accuracy string, source string, denominator_unit string, method string, details string, status string, reason string, absent string, position int"
_TIME = "yyyy-MM-dd''T''HH:mm:ss.SSSSSS"


def can_analyze(df: DataFrame, expressions: Sequence[str]) -> str | None:
    """None, or why the analyzer refuses; runs no job."""
    try:
        df.selectExpr(*expressions).schema  # noqa: B018
    except PySparkException as e:
        return safe_message(e)
    return None


def isolate(df: DataFrame, specs: Sequence[Spec]) -> dict[str, str]:
    """Specs that the analyzer refuses, by alias, so that the others still run."""
    if not specs:
        return {}
    reason = can_analyze(df, [s.sql for s in specs])
    if reason is None:
        return {}
    if len(specs) == 1:
        return {specs[0].alias: reason}
    half = len(specs) // 2
    return isolate(df, specs[:half]) | isolate(df, specs[half:])


def pass_frame(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """One row; lazy but for quantiles by exact ranks, whose jobs run now."""
    ranked = [s for s in specs if s.ranked]
    out = df.selectExpr(*[f"{s.sql} AS {s.alias}" for s in specs if not s.ranked]) if len(ranked) < len(specs) else df.sparkSession.range(1).select()
    if not ranked:
        return out
    probabilities = [float(p) for p in re.findall(r"[^,(]+(?=D[,)])", _probabilities(ranked[0]))]  # the same for all of a run
    found = quantiles.least_values(df, {s.alias: s.ranked for s in ranked}, probabilities)
    return out.select("*", *[found[s.alias].alias(s.alias) for s in ranked])


def wide(df: DataFrame, plan: MeasurePlan) -> DataFrame:
    """One row with all passes' results; lazy. Passes are one row each, so joining them is free."""
    plan.failed |= isolate(df, plan.specs)
    frames = [pass_frame(df, some) for p in plan.passes if (some := [s for s in p if s.alias not in plan.failed])]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def run_passes(df: DataFrame, plan: MeasurePlan, operations: list[dict[str, Any]]) -> DataFrame:
    """``wide`` at once, a job a pass: a pass that fails marks its own metrics only. What was done goes to ``operations``."""
    plan.failed |= isolate(df, plan.specs)
    row: dict[str, pa.Array] = {}
    for k, specs in enumerate(plan.passes):
        some, began = [s for s in specs if s.alias not in plan.failed], time.monotonic()
        record = {"operation_id": f"op_{'aggregate' if k < plan.standard_passes else 'deep_aggregate'}_{k + 1}", "status": "succeeded", "expressions": sum(s.metric.cost for s in some), "error": None}
        try:
            got = pass_frame(df, some).toArrow() if some else pa.table({})
            row |= dict(zip(got.column_names, got.columns, strict=True))
        except PySparkException as e:
            record |= {"status": "failed", "error": safe_message(e)}
            plan.failed |= {s.alias: safe_message(e) for s in some}
        operations.append(record | {"duration_ms": round(1000 * (time.monotonic() - began))})
    return df.sparkSession.createDataFrame(pa.table(row or {"nothing": [0]}))


def _probabilities(spec: Spec) -> str:
    return spec.sql[spec.sql.index("array(") : spec.sql.index(")", spec.sql.index("array(")) + 1]


def _value(spec: Spec) -> tuple[str, str, str]:
    """(text, number, value type) of a spec's column, as SQL."""
    a, kind, value_type = spec.alias, spec.node.kind if spec.node else "", spec.metric.value_type
    if value_type == "value":
        if kind == "timestamp":
            return f"date_format(to_utc_timestamp({a}, current_timezone()), '{_TIME.replace(chr(39) * 2, chr(92) + chr(39))}') || 'Z'", "NULL", kind
        if kind == "timestamp_ntz":
            return f"date_format({a}, '{_TIME.replace(chr(39) * 2, chr(92) + chr(39))}')", "NULL", kind
        if kind == "date":
            return f"CAST({a} AS STRING)", "NULL", kind
        value_type = kind
    elif value_type == "mean":
        value_type = "decimal" if kind == "decimal" else "float"
    elif value_type == "quantiles":
        p = _probabilities(spec)
        return f"to_json(transform(sequence(0, size({a}) - 1), i -> named_struct('probability', {p}[i], 'value', {a}[i])))", "NULL", value_type
    if value_type == "boolean":
        return f"CAST({a} AS STRING)", f"CAST(CAST({a} AS INT) AS DOUBLE)", value_type
    a = f"COALESCE({a}, 0)" if spec.metric.zero else a
    return f"CAST({a} AS STRING)", f"CAST({a} AS DOUBLE)", value_type


class _Rows:
    def __init__(self, plan: MeasurePlan):
        self.plan, self.meta, self.values = plan, [], []
        self.rows = plan.alias(None, "row_count")

    def add(self, node: Node | None, metric: str, text: str, number: str, denominator: str | None, **more: Any) -> None:
        record = {"path": node.display if node else None, "field_id": node.field_id if node else None, "kind": node.kind if node else None, "metric": metric, "position": len(self.meta), "status": "measured", "accuracy": "exact", "source": "aggregate"}
        if denominator is None:
            more["denominator_unit"] = None
        self.meta.append(record | more)
        self.values.append(f"named_struct('value', {text}, 'number', CAST({number} AS DOUBLE), 'denominator', CAST({denominator or 'NULL'} AS BIGINT))")

    def absent(self, node: Node, metric: str, status: str, reason: str) -> None:
        self.add(node, metric, "CAST(NULL AS STRING)", "NULL", None, status=status, reason=reason, accuracy="unknown")

    # populations, as SQL over the wide row

    def total(self, node: Node) -> str | None:
        """Rows, or members of the collection that ``node`` is in."""
        if not node.in_collection:
            return self.rows
        return self.members(owner_of(node))

    def members(self, collection: Node) -> str | None:
        a = self.plan.alias(collection, "total_element_count" if collection.kind == "array" else "total_entry_count")
        return a and f"COALESCE({a}, 0)"

    def nulls(self, node: Node) -> str | None:
        a = self.plan.alias(node, "null_count")
        return a and f"COALESCE({a}, 0)"

    def non_null(self, node: Node) -> str | None:
        total, nulls = self.total(node), self.nulls(node)
        return f"({total} - {nulls})" if total and nulls else None

    def finite(self, node: Node) -> str | None:
        if node.kind != "float":
            return self.non_null(node)
        a = self.plan.alias(node, "finite_count")
        return a and f"COALESCE({a}, 0)"

    def basis(self, node: Node, name: str | None) -> str | None:
        if name == "rows":
            return self.rows
        if name == "non_null":
            return self.non_null(node)
        if name == "finite":
            return self.finite(node)
        if name == "members":
            return self.total(node) if node.in_collection else self.members(node)
        if name == "parent":
            return self.non_null(node.parent) if node.parent is not None else None
        return None


def _units(metric: Metric, node: Node) -> tuple[str | None, str | None]:
    kind = owner_of(node).kind if node.in_collection else node.kind
    members = "entries" if kind == "map" else "elements"
    unit = members if metric.unit == "members" else metric.unit
    if node.kind == "binary" and unit == "characters":
        unit = "bytes"
    if node.in_collection or metric.basis == "members":
        return unit, members
    return unit, "values" if metric.basis in ("non_null", "finite") else "rows"


def _why_absent(metric: Metric, node: Node) -> str:
    if metric.name == "stddev":
        return "fewer than two (finite) non-null values in scope"
    things = _units(metric, node)[1] if node.in_collection else "values"
    return f"no {'finite ' if node.kind == 'float' and metric.name in registry.EXTREMES else ''}non-null {things} in scope"


def _details(spec: Spec) -> str | None:
    name, out = spec.metric.name, dict(spec.detail)
    if name == "approx_distinct_count":
        out["relative_standard_deviation"] = float(spec.sql.rsplit(",", 1)[1].strip(" )D"))
    elif spec.metric.value_type == "quantiles":
        out["accuracy_parameter"] = int(spec.sql.rsplit(",", 1)[1].strip(" )"))
    elif name == "after_reference_count":
        out |= {"reference": "run.reference_time", "comparison": "dates with its UTC calendar date, timestamps as instants"}
    return json.dumps(out) if out else None


def long_frame(wide_row: DataFrame, plan: MeasurePlan, table: str, scope: str) -> DataFrame:
    """The wide row turned into ``LONG`` rows, ratios and complements added; metrics of JSON paths are left out."""
    rows = _Rows(plan)
    if rows.rows:
        rows.add(None, "row_count", f"CAST({rows.rows} AS STRING)", rows.rows, None, unit="rows", value_type="integer", method=registry.ROW_COUNT.method)
    by_node: dict[Any, list[Spec]] = {}
    for s in plan.specs:
        if s.node is not None and s.group != "json":
            by_node.setdefault(s.node.path, []).append(s)
    static: dict[Any, list[Any]] = {}
    for x in plan.static:
        static.setdefault(x.node.path, []).append(x)
    for node in [*plan.nodes, *plan.members]:
        unit = "rows"
        if node.in_collection:
            unit = "entries" if owner_of(node).kind == "map" else "elements"
            if total := rows.total(node):
                rows.add(node, "element_count", f"CAST({total} AS STRING)", total, None, unit=unit, value_type="integer", source="derived", method=registry.DERIVED["element_count"])
        for s in by_node.get(node.path, []):
            if s.alias in plan.failed:
                rows.absent(node, s.metric.name, "error", plan.failed[s.alias])
                continue
            own, of = _units(s.metric, node)
            text, number, value_type = _value(s)
            rows.add(node, s.metric.name, text, number, rows.basis(node, s.metric.basis), unit=own, value_type=value_type, accuracy=s.metric.accuracy, method=s.metric.method, denominator_unit=of, details=_details(s), absent=_why_absent(s.metric, node))
        total, nulls, kept = rows.total(node), rows.nulls(node), rows.non_null(node)
        if kept:
            rows.add(node, "non_null_count", f"CAST({kept} AS STRING)", kept, total, unit=unit, value_type="integer", source="derived", method=registry.DERIVED["non_null_count"], denominator_unit=unit)
            rows.add(node, "null_ratio", *_ratio(nulls, total), total, unit="ratio", value_type="ratio", source="derived", method=registry.DERIVED["null_ratio"], denominator_unit=unit, absent=f"undefined: no {unit} in scope (denominator is 0)")
        inside, parents = plan.alias(node, "null_count_parent_present"), rows.basis(node, "parent")
        if inside and parents:
            rows.add(node, "null_ratio_given_parent_present", *_ratio(f"COALESCE({inside}, 0)", parents), parents, unit="ratio", value_type="ratio", source="derived", method=registry.DERIVED["null_ratio_given_parent_present"], denominator_unit=f"{unit} with a non-null parent", absent=f"undefined: no {unit} with a non-null parent in scope (denominator is 0)")
        for x in static.get(node.path, []):
            rows.absent(node, x.metric, x.status, x.reason)
    both = wide_row.select(F.from_json(F.lit(json.dumps(rows.meta)), f"array<struct<{_struct(_META)}>>").alias("m"), F.expr(f"array({', '.join(rows.values)})").alias("v"))
    flat = both.select(F.inline(F.arrays_zip("m", "v"))).select("m.*", "v.*")
    missing = F.col("value").isNull() & (F.col("status") == "measured")
    return flat.select(
        F.lit(table).alias("table"), "path", "field_id", "kind", "metric",
        F.when(missing, "insufficient_data").otherwise(F.col("status")).alias("status"),
        "value", "number",
        F.when(F.col("value").isNotNull(), F.col("value_type")).alias("value_type"),
        "unit", F.lit(scope).alias("scope"),
        F.when(missing, "unknown").otherwise(F.col("accuracy")).alias("accuracy"),
        "source",
        F.when(~missing & F.col("value").isNotNull(), F.col("denominator")).alias("denominator"),
        F.when(~missing & F.col("value").isNotNull(), F.col("denominator_unit")).alias("denominator_unit"),
        F.when(missing, F.coalesce("absent", F.lit("no value in scope"))).otherwise(F.col("reason")).alias("reason"),
        "method", "details", "position",
    )


def _ratio(part: str | None, whole: str | None) -> tuple[str, str]:
    sql = f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE))"
    return f"CAST({sql} AS STRING)", sql


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ") for x in ddl.split(",")))


def measure(df: DataFrame, plan: MeasurePlan, table: str, scope: str = "full_table") -> DataFrame:
    return long_frame(wide(df, plan), plan, table, scope)
