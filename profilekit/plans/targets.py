"""Which collections and JSON fields the deep level looks into, and why others are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from profilekit import identifiers as ids
from profilekit.config import ALL_TARGETS
from profilekit.plans.measure import owner_of
from profilekit.plans.tree import COLLECTIONS, Node, Tree, omission


@dataclass
class DeepTargets:
    explicit: bool
    requested: list[str]
    collections: list[Node] = field(default_factory=list)
    json_nodes: list[Node] = field(default_factory=list)
    members: list[Node] = field(default_factory=list)
    not_eligible: list[dict[str, str]] = field(default_factory=list)
    omissions: list[dict[str, Any]] = field(default_factory=list)


def context(node: Node) -> dict[str, Any]:
    """What the counts of a member field are counts of."""
    owner = owner_of(node)
    cut = len(owner.path)
    return {"collection_field_id": owner.field_id, "collection_display_path": owner.display, "collection_kind": owner.kind, "segment": node.path[cut].kind, "inner": [s.name for s in node.path[cut + 1 :]], "unit": "entries" if owner.kind == "map" else "elements"}


def _reason(node: Node | None, profiled: Sequence[Node], deep: Mapping[str, Any]) -> str | None:
    if node is None:
        return "not found in the documented schema tree"
    if node not in profiled:
        return "not profiled at the standard level (not selected, inside a collection or beyond limits)"
    if node.kind in COLLECTIONS:
        return None if deep["collections"] else "element profiling is disabled (deep.collections = false)"
    if node.kind == "string":
        return None if deep["json_paths"] else "JSON path profiling is disabled (deep.json_paths = false)"
    return f"deep targets must be arrays, maps or JSON strings, not {node.kind}"


def choose(tree: Tree, profiled: Sequence[Node], config: Mapping[str, Any], table: str) -> DeepTargets:
    deep = config["deep"]
    explicit = deep["targets"] != ALL_TARGETS
    asked = [t["column"] for t in deep["targets"] if ids.lookup_key(t["table"]) == table] if explicit else []
    out = DeepTargets(explicit, asked)
    if not explicit:
        out.collections = [n for n in profiled if n.kind in COLLECTIONS] if deep["collections"] else []
    for text in asked:
        try:
            node = tree.find(ids.parse_path(text))
        except ids.IdentifierError:
            out.not_eligible.append({"display_path": text, "reason": "invalid display path"})
            continue
        reason = _reason(node, profiled, deep)
        if reason or node is None:
            out.not_eligible.append({"display_path": text, "reason": reason or ""})
        elif node not in (into := out.collections if node.kind in COLLECTIONS else out.json_nodes):
            into.append(node)
    for node in tree:
        if not node.in_collection or owner_of(node) not in profiled:
            continue
        levels = sum(s.kind != ids.FIELD for s in node.path)
        if owner_of(node) not in out.collections:
            if levels == 1 and node.path[-1].kind != ids.FIELD:
                out.omissions.append(omission(node, "deep_not_selected", "not listed in deep.targets" if explicit else "element profiling is disabled (deep.collections = false)"))
        elif levels == 1:
            out.members.append(node)
        elif node.parent is not None and sum(s.kind != ids.FIELD for s in node.parent.path) == 1:
            out.omissions.append(omission(node, "nested_collection", "members of collections inside collections are not profiled"))
    return out
