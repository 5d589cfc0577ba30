"""The part of JSON Schema (2020-12) that this package's documents use."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

_TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda v: isinstance(v, Mapping),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
}
_NOTES = {"$schema", "$id", "$defs", "title", "description", "default", "examples"}


def _same(a: Any, b: Any) -> bool:
    """JSON equality: 1 equals 1.0, but true does not equal 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (_TYPES["number"](a) and _TYPES["number"](b) and a == b)


def _type(v: Any, want: Any, *_: Any) -> Iterator[str]:
    names = [want] if isinstance(want, str) else want
    if not any(_TYPES[n](v) for n in names):
        yield f"is not of type {' or '.join(names)}"


def _number(test: Callable[[Any, Any], bool], text: str) -> Callable[..., Iterator[str]]:
    def rule(v: Any, want: Any, *_: Any) -> Iterator[str]:
        if _TYPES["number"](v) and not test(v, want):
            yield f"{text} {want}"

    return rule


def _length(kind: Any, test: Callable[[int, int], bool], text: str) -> Callable[..., Iterator[str]]:
    def rule(v: Any, want: Any, *_: Any) -> Iterator[str]:
        if isinstance(v, kind) and not test(len(v), want):
            yield f"{text} {want}"

    return rule


def _pattern(v: Any, want: str, *_: Any) -> Iterator[str]:
    if isinstance(v, str) and not re.search(want, v):
        yield f"does not match {want}"


def _unique(v: Any, want: bool, *_: Any) -> Iterator[str]:
    if want and isinstance(v, list) and any(_same(a, b) for k, a in enumerate(v) for b in v[:k]):
        yield "has equal items"


def _required(v: Any, want: list[str], *_: Any) -> Iterator[str]:
    if isinstance(v, Mapping):
        yield from (f"lacks {n!r}" for n in want if n not in v)


_RULES: dict[str, Callable[..., Iterator[str]]] = {
    "type": _type,
    "const": lambda v, want, *_: iter(() if _same(v, want) else (f"is not {want!r}",)),
    "enum": lambda v, want, *_: iter(() if any(_same(v, w) for w in want) else (f"is none of {want!r}",)),
    "minimum": _number(lambda a, b: a >= b, "is below"),
    "maximum": _number(lambda a, b: a <= b, "is above"),
    "exclusiveMinimum": _number(lambda a, b: a > b, "is not above"),
    "exclusiveMaximum": _number(lambda a, b: a < b, "is not below"),
    "minLength": _length(str, lambda a, b: a >= b, "is shorter than"),
    "maxLength": _length(str, lambda a, b: a <= b, "is longer than"),
    "minItems": _length(list, lambda a, b: a >= b, "has fewer items than"),
    "maxItems": _length(list, lambda a, b: a <= b, "has more items than"),
    "pattern": _pattern,
    "uniqueItems": _unique,
    "required": _required,
}
_NESTED = {"properties", "additionalProperties", "items", "oneOf", "anyOf", "allOf", "$ref"}


def _errors(value: Any, shape: Any, root: Mapping[str, Any], where: str) -> Iterator[str]:
    if isinstance(shape, bool):
        if not shape:
            yield f"{where}: is not allowed"
        return
    if "$ref" in shape:
        target: Any = root
        for part in shape["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        yield from _errors(value, target, root, where)
    for key, want in shape.items():
        if key in _RULES:
            yield from (f"{where}: {e}" for e in _RULES[key](value, want))
    if isinstance(value, Mapping):
        known = shape.get("properties", {})
        for name, item in value.items():
            if name in known:
                yield from _errors(item, known[name], root, f"{where}.{name}")
            elif "additionalProperties" in shape:
                yield from _errors(item, shape["additionalProperties"], root, f"{where}.{name}")
    if isinstance(value, list) and "items" in shape:
        for k, item in enumerate(value):
            yield from _errors(item, shape["items"], root, f"{where}[{k}]")
    for part in shape.get("allOf", []):
        yield from _errors(value, part, root, where)
    for key, fits in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if key in shape and not fits(sum(next(_errors(value, s, root, where), None) is None for s in shape[key])):
            yield f"{where}: does not fit {key}"


def shape_errors(value: Any, shape: Mapping[str, Any], limit: int = 50) -> list[str]:
    out = []
    for e in _errors(value, shape, shape, "$"):
        out.append(e)
        if len(out) == limit:
            break
    return out


def unknown_keywords(shape: Any) -> set[str]:
    """Keywords that this interpreter would pass over."""
    if not isinstance(shape, Mapping):
        return set()
    out = {k for k in shape if k not in _RULES and k not in _NESTED and k not in _NOTES}
    for k in ("properties", "$defs"):
        for s in shape.get(k, {}).values():
            out |= unknown_keywords(s)
    for k in ("items", "additionalProperties"):
        out |= unknown_keywords(shape.get(k))
    for k in ("oneOf", "anyOf", "allOf"):
        for s in shape.get(k, []):
            out |= unknown_keywords(s)
    return out
