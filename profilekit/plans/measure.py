"""Which expressions a table's shared passes hold, within the budgets, and what is known not to be measured."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from profilekit.operators.quantiles import SUMMARISED
from profilekit.plans import budget, registry
from profilekit.plans.registry import Metric
from profilekit.plans.tree import Node, omission


@dataclass
class Spec:
    """``ranked``: SQL of the values whose quantiles are found by exact ranks instead of ``sql``."""

    metric: Metric
    node: Node | None
    sql: str
    group: str = "standard"
    alias: str = ""
    ranked: str = ""
    detail: dict[str, Any] = field(default_factory=dict)


@dataclass
class Static:
    """A metric known up front to have no value."""

    node: Node
    metric: str
    status: str
    reason: str


@dataclass
class MeasurePlan:
    nodes: list[Node]
    members: list[Node]
    specs: list[Spec]
    passes: list[list[Spec]]
    static: list[Static]
    omissions: list[dict[str, Any]]
    capacity: int
    standard_passes: int
    dropped: list[Spec]
    failed: dict[str, str] = field(default_factory=dict)

    def alias(self, node: Node | None, metric: str) -> str | None:
        """The column of a measured metric in the wide row."""
        key = (node.path if node else None, metric)
        return next((s.alias for s in self._by_key().get(key, []) if s.alias not in self.failed), None)

    def _by_key(self) -> dict[Any, list[Spec]]:
        if not hasattr(self, "_keys"):
            self._keys: dict[Any, list[Spec]] = {}
            for s in self.specs:
                if s.group != "json":
                    self._keys.setdefault((s.node.path if s.node else None, s.metric.name), []).append(s)
        return self._keys


def reference_literal(kind: str, reference: dt.datetime) -> str:
    moment = reference.astimezone(dt.UTC)
    return f"DATE'{moment:%Y-%m-%d}'" if kind == "date" else f"TIMESTAMP'{moment:%Y-%m-%d %H:%M:%S.%f}Z'"


def _run_values(node: Node, config: Mapping[str, Any], reference: dt.datetime) -> dict[str, str]:
    m = config["metrics"]
    return {
        "quantiles": "array(" + ", ".join(f"{float(q)!r}D" for q in m["quantiles"]) + ")",
        "accuracy": str(int(m["quantile_accuracy"])),
        "rsd": f"{float(m['approx_distinct_rsd'])!r}D",
        "reference": reference_literal(node.kind, reference),
    }


def plan_measures(
    nodes: Sequence[Node],
    config: Mapping[str, Any],
    reference: dt.datetime,
    members: Sequence[Node] = (),
    json_nodes: Collection[str] = (),
    redacted: Collection[str] = (),
    json_checks: Sequence[Spec] = (),
    can_parse_json: bool = True,
    only: Collection[str] | None = None,
) -> MeasurePlan:
    """``json_nodes`` and ``redacted`` are display paths; a redacted collection covers its members. ``only`` names the metrics wanted."""
    static: list[Static] = []

    def candidates(some: Sequence[Node], deep: bool) -> list[Spec]:
        out = []
        for node in some:
            values = _run_values(node, config, reference)
            site = registry.member_site(node) if deep else registry.column_site(node)
            hidden = node.display in redacted or (deep and any(_owner(node).display == r for r in redacted))
            for m in registry.member_metrics(node) if deep else registry.column_metrics(node, node.display in json_nodes):
                if only is not None and m.name not in only:
                    continue
                if hidden and m.name in registry.EXTREMES:
                    static.append(Static(node, m.name, "redacted", "the value policy redacts extremes and distribution values of this field"))
                elif m.value_type == "quantiles" and not config["metrics"]["quantiles"]:
                    continue
                elif m.name == "json_invalid_count" and not config["metrics"]["json_full_scope_validation"]:
                    static.append(Static(node, m.name, "not_computed", "full-scope JSON validation is disabled by configuration"))
                elif m.name == "json_invalid_count" and not can_parse_json:
                    static.append(Static(node, m.name, "unsupported", "try_parse_json is not available in this runtime"))
                else:
                    exact = m.of and config["metrics"]["quantile_accuracy"] > SUMMARISED
                    out.append(Spec(replace(m, accuracy="exact", method=m.method.replace("percentile_approx", "values at exact ranks")) if exact else m, node, _fill(m.sql, site | values), "member" if deep else "standard", ranked=_fill(m.of, site) if exact else ""))
            if node.kind == "timestamp_ntz" and (only is None or "after_reference_count" in only):
                static.append(Static(node, "after_reference_count", "not_computed", "timestamps without a time zone have no unambiguous reference instant"))
        return out

    limits = config["limits"]
    size = limits["max_expressions_per_pass"]
    capacity = size * limits["max_aggregate_passes"]
    tier, cost = (lambda s: s.metric.tier), (lambda s: s.metric.cost)
    kept, dropped = budget.fit([Spec(registry.ROW_COUNT, None, registry.ROW_COUNT.sql), *candidates(nodes, False)], capacity, tier, cost)
    omissions: dict[Any, dict[str, Any]] = {}

    def drop(specs: Sequence[Spec], reason: str, detail: str) -> None:
        for s in specs:
            entry = omissions.setdefault((reason, s.node.path if s.node else None), omission(s.node, reason, detail))
            name = "json_path_validation" if s.group == "json" else s.metric.name
            if name not in entry["metrics"]:
                entry["metrics"].append(name)
            if s.group != "json" and s.node is not None:
                static.append(Static(s.node, s.metric.name, "not_computed", f"omitted to respect the {reason.replace('_', ' ')}"))

    drop(dropped, "expression_budget", f"over {capacity} expressions ({size} a pass, {limits['max_aggregate_passes']} passes)")
    passes = budget.pack(kept, size, cost)
    standard_passes, deep = len(passes), [*candidates(members, True), *json_checks]
    extra = config["deep"]["max_extra_passes"]
    lost: list[Spec] = []
    if deep:
        room = size - sum(map(cost, passes[-1]))
        more = min(-(-max(0, sum(map(cost, deep)) - room) // size), extra)
        deep, lost = budget.fit(deep, room + size * more, tier, cost)
        drop(lost, "deep_budget", f"beyond the room in the standard passes and {extra} extra pass(es) of {size} expressions")
        passes = budget.pack(deep, size, cost, passes)
    specs = [*kept, *deep]
    for k, s in enumerate(specs):
        s.alias = f"a{k:04d}"
    return MeasurePlan(list(nodes), list(members), specs, passes, static, list(omissions.values()), capacity, standard_passes, [*dropped, *lost])


def _owner(node: Node) -> Node:
    while node.in_collection:
        assert node.parent is not None
        node = node.parent
    return node


owner_of = _owner


def _fill(template: str, values: Mapping[str, str]) -> str:
    for key, value in values.items():
        template = template.replace("{" + key + "}", value)
    return template
