"""The schema tree of a frame: what is documented, what is profiled, and what is left out and why."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from profilekit import identifiers as ids

NUMERIC = ("integer", "float", "decimal")
TEMPORAL = ("date", "timestamp", "timestamp_ntz")
ORDERABLE = (*NUMERIC, "string", "boolean", *TEMPORAL, "binary")
COLLECTIONS = ("array", "map")
_KINDS: tuple[tuple[type | tuple[type, ...], str], ...] = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
    ((T.FloatType, T.DoubleType), "float"),
    (T.DecimalType, "decimal"),
    ((T.StringType, T.VarcharType, T.CharType), "string"),
    (T.BooleanType, "boolean"),
    (T.DateType, "date"),
    (T.TimestampType, "timestamp"),
    (T.TimestampNTZType, "timestamp_ntz"),
    (T.BinaryType, "binary"),
    (T.StructType, "struct"),
    (T.ArrayType, "array"),
    (T.MapType, "map"),
    (T.VariantType, "variant"),
    ((T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType), "interval"),
    (T.NullType, "null"),
)


def kind_of(data_type: T.DataType) -> str:
    return next((kind for types, kind in _KINDS if isinstance(data_type, types)), "other")


@dataclass
class Node:
    """One documented field."""

    path: ids.Path
    data_type: T.DataType
    nullable: bool | None
    comment: str | None = None
    declared: str | None = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    omitted: int = 0
    omitted_reason: str | None = None

    @property
    def kind(self) -> str:
        return kind_of(self.data_type)

    @property
    def display(self) -> str:
        return ids.display(self.path)

    @property
    def field_id(self) -> str:
        return ids.field_id(self.path)

    @property
    def depth(self) -> int:
        return len(self.path)

    @property
    def physical(self) -> str:
        return self.declared or self.data_type.simpleString()

    @property
    def scale(self) -> int | None:
        return self.data_type.scale if isinstance(self.data_type, T.DecimalType) else None

    @property
    def in_collection(self) -> bool:
        return ids.in_collection(self.path)

    def record(self) -> dict[str, Any]:
        shape: dict[str, Any] = {"kind": self.kind, "physical_type": self.physical}
        if isinstance(self.data_type, T.DecimalType):
            shape |= {"precision": self.data_type.precision, "scale": self.data_type.scale}
        return {
            "field_id": self.field_id,
            "name": self.path[-1].name,
            "segment_kind": self.path[-1].kind,
            "path": [s.record() for s in self.path],
            "display_path": self.display,
            "parent_field_id": self.parent.field_id if self.parent else None,
            "depth": self.depth,
            "type": shape,
            "nullable": self.nullable,
            "comment": self.comment,
            "children": [c.record() for c in self.children],
            "children_omitted": self.omitted,
            "children_omitted_reason": self.omitted_reason,
        }


def _below(node: Node) -> list[tuple[ids.Segment, T.DataType, bool | None, dict[str, Any]]]:
    t = node.data_type
    if isinstance(t, T.StructType):
        return [(ids.field(f.name), f.dataType, f.nullable, f.metadata or {}) for f in t.fields]
    if isinstance(t, T.ArrayType):
        return [(ids.Segment(ids.ITEM), t.elementType, t.containsNull, {})]
    if isinstance(t, T.MapType):
        return [(ids.Segment(ids.KEY), t.keyType, False, {}), (ids.Segment(ids.VALUE), t.valueType, t.valueContainsNull, {})]
    return []


def _node(segment: ids.Segment, data_type: T.DataType, nullable: bool | None, metadata: dict[str, Any], parent: Node | None) -> Node:
    declared = metadata.get("__CHAR_VARCHAR_TYPE_STRING")
    return Node(((*parent.path, segment) if parent else (segment,)), data_type, nullable, metadata.get("comment"), declared, parent)


@dataclass
class Tree:
    fields: list[Node]
    max_depth: int
    max_fields: int
    top_omitted: int = 0

    def __iter__(self) -> Iterator[Node]:
        """All documented nodes, depth first."""
        stack = list(reversed(self.fields))
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)

    def find(self, path: ids.Path) -> Node | None:
        return next((n for n in self if n.path == path), None)

    def record(self) -> dict[str, Any]:
        nodes = list(self)
        return {
            "fields": [n.record() for n in self.fields],
            "nodes_total": len(nodes),
            "nodes_omitted": self.top_omitted + sum(n.omitted for n in nodes),
            "top_level_omitted": self.top_omitted,
            "limits": {"max_depth": self.max_depth, "max_fields": self.max_fields},
        }


def schema_tree(schema: T.StructType, max_depth: int = 3, max_fields: int = 200) -> Tree:
    """Breadth first, so that every top-level column comes before nested ones when ``max_fields`` is reached."""
    top = [_node(ids.field(f.name), f.dataType, f.nullable, f.metadata or {}, None) for f in schema.fields[:max_fields]]
    tree = Tree(top, max_depth, max_fields, max(0, len(schema.fields) - max_fields))
    room, queue = max_fields - len(top), deque(top)
    while queue:
        node = queue.popleft()
        below = _below(node)
        take = 0 if node.depth >= max_depth else min(room, len(below))
        node.children = [_node(*b, node) for b in below[:take]]
        node.omitted = len(below) - take
        if node.omitted:
            node.omitted_reason = "max_depth" if node.depth >= max_depth else "max_fields"
        room -= take
        queue += node.children
    return tree


def omission(node: Node | None, reason: str, detail: str, metrics: Sequence[str] = ()) -> dict[str, Any]:
    return {"field_id": node.field_id if node else None, "display_path": node.display if node else None, "reason": reason, "detail": detail, "metrics": list(metrics)}


def select(tree: Tree, columns: Sequence[str] | None = None) -> tuple[list[Node], list[dict[str, Any]]]:
    """Nodes profiled as columns, and what is left out. Members of collections are the deep level's."""
    chosen: list[Node] = []
    left: list[dict[str, Any]] = []
    for node in tree:
        if columns is not None and node.path[0].name not in columns:
            if node.depth == 1:
                left.append(omission(node, "not_selected", "column not in the configured selection"))
        elif node.in_collection:
            if not ids.in_collection(node.path[:-1]):
                left.append(omission(node, "inside_collection", "members of arrays and maps are profiled at the deep level only"))
        else:
            chosen.append(node)
            if node.omitted:
                left.append(omission(node, node.omitted_reason or "limit", f"{node.omitted} child field(s) beyond the {node.omitted_reason} limit"))
    if tree.top_omitted:
        left.append(omission(None, "max_fields", f"{tree.top_omitted} top-level column(s) beyond limits.max_fields"))
    return chosen, left
