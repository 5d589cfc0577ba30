"""The metrics: one line each, as SQL over a site.

``{c}`` is the field, ``{v}`` its values (finite ones where the field is a float), ``{p}`` the parent struct,
``{quantiles}``, ``{accuracy}``, ``{rsd}`` and ``{reference}`` come from the run. Metrics of members of collections
see ``{a}``, an array of the members of one row, instead; nothing is exploded for them.
``basis`` names the population that a count is a share of; a ``zero`` metric is 0 where there is nothing to add up.
``of`` is what quantiles are of; above ``quantiles.SUMMARISED`` they are found by exact ranks instead.
Lower tiers are kept first when there are too many expressions; deep tiers (5 and up) never displace others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from profilekit import identifiers as ids
from profilekit.plans.tree import COLLECTIONS, NUMERIC, ORDERABLE, TEMPORAL, Node

ANY = ("*",)
STRINGS, SIZED = ("string",), ("string", "binary")
EXTREMES = ("min", "max", "mean", "stddev", "quantiles")
FLOATS = ("float",)


@dataclass(frozen=True)
class Metric:
    name: str
    kinds: tuple[str, ...]
    tier: int
    sql: str
    unit: str | None = None
    basis: str | None = None
    method: str = ""
    value_type: str = "integer"
    cost: int = 1
    accuracy: str = "exact"
    zero: bool = False
    of: str = ""

    def fits(self, kind: str) -> bool:
        return self.kinds == ANY or kind in self.kinds


def _where(condition: str) -> str:
    return f"count_if({condition})"


def _size(extra: str) -> str:
    return f"{extra}(CASE WHEN {{c}} IS NOT NULL THEN size({{c}}) END)"


ROW_COUNT = Metric("row_count", (), 0, "count(1)", "rows", method="count(*) over the analysed scope")

COLUMN_METRICS = (
    Metric("null_count", ANY, 1, _where("{c} IS NULL"), "rows", "rows", "rows where the field is null, a null parent included"),
    Metric("null_count_parent_present", ("under_struct",), 1, _where("{p} IS NOT NULL AND {c} IS NULL"), "rows", "parent", "rows whose parent struct is not null and the field is"),
    Metric("approx_distinct_count", ORDERABLE, 3, "approx_count_distinct({c}, {rsd})", "values", None, "approx_count_distinct (HyperLogLog++)", accuracy="approximate"),
    Metric("all_values_equal", ORDERABLE, 3, "min({c}) = max({c})", None, None, "min = max over non-null values", "boolean", cost=2),
    Metric("nan_count", FLOATS, 2, _where("isnan({c})"), "values", "non_null", "NaN values, which are not null"),
    Metric("positive_infinity_count", FLOATS, 2, _where("{c} = double('Infinity')"), "values", "non_null", "+Infinity values"),
    Metric("negative_infinity_count", FLOATS, 2, _where("{c} = double('-Infinity')"), "values", "non_null", "-Infinity values"),
    Metric("finite_count", FLOATS, 2, _where("{v} IS NOT NULL"), "values", "non_null", "values that are neither null, NaN nor infinite"),
    Metric("min", (*NUMERIC, *TEMPORAL), 2, "min({v})", None, None, "least non-null (finite) value", "value"),
    Metric("max", (*NUMERIC, *TEMPORAL), 2, "max({v})", None, None, "greatest non-null (finite) value", "value"),
    Metric("mean", NUMERIC, 2, "avg({v})", None, None, "average of non-null (finite) values", "mean"),
    Metric("zero_count", NUMERIC, 2, _where("{v} = 0"), "values", "finite", "values equal to zero"),
    Metric("negative_count", NUMERIC, 2, _where("{v} < 0"), "values", "finite", "values below zero"),
    Metric("positive_count", NUMERIC, 2, _where("{v} > 0"), "values", "finite", "values above zero"),
    Metric("stddev", NUMERIC, 4, "stddev_samp({v})", None, None, "sample standard deviation in double precision", "float"),
    Metric("quantiles", NUMERIC, 4, "percentile_approx({v}, {quantiles}, {accuracy})", None, None, "percentile_approx of non-null (finite) values", "quantiles", accuracy="approximate", of="{v}"),
    Metric("empty_count", STRINGS, 2, _where("{c} = ''"), "values", "non_null", "empty strings"),
    Metric("min_length", SIZED, 2, "min(length({c}))", "characters", None, "least length of non-null values"),
    Metric("max_length", SIZED, 2, "max(length({c}))", "characters", None, "greatest length of non-null values"),
    Metric("mean_length", STRINGS, 2, "avg(length({c}))", "characters", None, "average length of non-null values", "float"),
    Metric("whitespace_only_count", STRINGS, 4, _where(r"{c} <> '' AND {c} RLIKE '^\\s+$'"), "values", "non_null", "strings of white space alone"),
    Metric("length_quantiles", STRINGS, 4, "percentile_approx(length({c}), {quantiles}, {accuracy})", "characters", None, "percentile_approx of lengths", "quantiles", accuracy="approximate", of="length({c})"),
    Metric("true_count", ("boolean",), 2, _where("{c}"), "values", "non_null", "true values"),
    Metric("false_count", ("boolean",), 2, _where("NOT {c}"), "values", "non_null", "false values"),
    Metric("after_reference_count", ("date", "timestamp"), 3, _where("{c} > {reference}"), "values", "non_null", "values after the run's reference instant (dates: its UTC date)"),
    Metric("empty_count", COLLECTIONS, 2, _where("{c} IS NOT NULL AND size({c}) = 0"), "values", "non_null", "empty collections"),
    Metric("min_size", COLLECTIONS, 2, _size("min"), "members", None, "least size of non-null collections"),
    Metric("max_size", COLLECTIONS, 2, _size("max"), "members", None, "greatest size of non-null collections"),
    Metric("mean_size", COLLECTIONS, 2, _size("avg"), "members", None, "average size of non-null collections", "float"),
    Metric("total_element_count", ("array",), 2, _size("sum"), "members", None, "sum of array sizes", zero=True),
    Metric("total_entry_count", ("map",), 2, _size("sum"), "members", None, "sum of map sizes", zero=True),
    Metric("null_element_count", ("array",), 3, "sum(CASE WHEN {c} IS NOT NULL THEN size(filter({c}, x -> x IS NULL)) END)", "members", "members", "null elements of non-null arrays", zero=True),
    Metric("null_value_count", ("map",), 3, "sum(CASE WHEN {c} IS NOT NULL THEN size(filter(map_values({c}), x -> x IS NULL)) END)", "members", "members", "null values of non-null maps", zero=True),
    Metric("json_invalid_count", ("json",), 3, _where("{c} IS NOT NULL AND try_parse_json({c}) IS NULL"), "values", "non_null", "non-null strings that are not JSON (try_parse_json)"),
)


def _members(condition: str) -> str:
    return f"sum(CASE WHEN {{a}} IS NOT NULL THEN size(filter({{a}}, x -> {condition})) END)"


_FINITE = "x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity')"

MEMBER_METRICS = (
    Metric("null_count", ANY, 5, _members("x IS NULL"), "members", "members", "null members, those of a null element struct included", zero=True),
    Metric("null_count_parent_present", ("under_struct",), 5, "sum(CASE WHEN {pa} IS NOT NULL THEN size(filter({pa}, x -> x IS NOT NULL AND x.{leaf} IS NULL)) END)", "members", "parent", "members whose parent struct is not null and the field is", zero=True),
    Metric("nan_count", FLOATS, 6, _members("isnan(x)"), "members", "non_null", "NaN values, which are not null", zero=True),
    Metric("positive_infinity_count", FLOATS, 6, _members("x = double('Infinity')"), "members", "non_null", "+Infinity values", zero=True),
    Metric("negative_infinity_count", FLOATS, 6, _members("x = double('-Infinity')"), "members", "non_null", "-Infinity values", zero=True),
    Metric("finite_count", FLOATS, 5, _members(_FINITE), "members", "non_null", "values that are neither null, NaN nor infinite", zero=True),
    Metric("min", (*NUMERIC, *TEMPORAL), 6, "min(array_min({va}))", None, None, "array_min by row, then min", "value"),
    Metric("max", (*NUMERIC, *TEMPORAL), 6, "max(array_max({va}))", None, None, "array_max by row, then max", "value"),
    Metric("zero_count", NUMERIC, 6, "sum(CASE WHEN {a} IS NOT NULL THEN size(filter({va}, x -> x = 0)) END)", "members", "finite", "values equal to zero", zero=True),
    Metric("negative_count", NUMERIC, 6, "sum(CASE WHEN {a} IS NOT NULL THEN size(filter({va}, x -> x < 0)) END)", "members", "finite", "values below zero", zero=True),
    Metric("positive_count", NUMERIC, 6, "sum(CASE WHEN {a} IS NOT NULL THEN size(filter({va}, x -> x > 0)) END)", "members", "finite", "values above zero", zero=True),
    Metric("empty_count", STRINGS, 6, _members("x = ''"), "members", "non_null", "empty strings", zero=True),
    Metric("min_length", SIZED, 6, "min(array_min(transform({a}, x -> length(x))))", "characters", None, "least length of non-null values"),
    Metric("max_length", SIZED, 6, "max(array_max(transform({a}, x -> length(x))))", "characters", None, "greatest length of non-null values"),
    Metric("whitespace_only_count", STRINGS, 7, _members(r"x <> '' AND x RLIKE '^\\s+$'"), "members", "non_null", "strings of white space alone", zero=True),
    Metric("true_count", ("boolean",), 6, _members("x"), "members", "non_null", "true values", zero=True),
    Metric("false_count", ("boolean",), 6, _members("NOT x"), "members", "non_null", "false values", zero=True),
    Metric("after_reference_count", ("date", "timestamp"), 7, _members("x > {reference}"), "members", "non_null", "values after the run's reference instant", zero=True),
)

#: Computed from the others, never by the engine's passes.
DERIVED = {
    "non_null_count": "count less null_count",
    "null_ratio": "null_count as a share of the count",
    "null_ratio_given_parent_present": "null_count_parent_present as a share of those with a parent",
    "element_count": "members of the collection in scope",
    "distinct_count": "exact count of distinct non-null values among the members examined",
}
ORDER = {name: k for k, name in enumerate(dict.fromkeys(["row_count", "element_count", "null_count", "non_null_count", "null_ratio", "null_count_parent_present", "null_ratio_given_parent_present", *(m.name for m in COLUMN_METRICS), "distinct_count"]))}


def sql_path(path: ids.Path) -> str:
    return ".".join(ids.quote(s.name or "") for s in path)


def finite(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) <> double('Infinity') THEN {c} END"


def column_site(node: Node) -> dict[str, str]:
    c = sql_path(node.path)
    return {"c": c, "v": finite(c) if node.kind == "float" else c, "p": sql_path(node.path[:-1]) or "NULL"}


def member_site(node: Node) -> dict[str, str]:
    """For a field inside one collection: the array of its values in a row, and that of its parents."""
    cut = next(k for k, s in enumerate(node.path) if s.kind != ids.FIELD)
    c = sql_path(node.path[:cut])
    members = {ids.ITEM: c, ids.KEY: f"map_keys({c})", ids.VALUE: f"map_values({c})"}[node.path[cut].kind]
    inner = node.path[cut + 1 :]

    def at(steps: ids.Path) -> str:
        return f"transform({members}, x -> x.{sql_path(steps)})" if steps else members

    a = at(inner)
    return {"a": a, "va": f"filter({a}, x -> {_FINITE})" if node.kind == "float" else a, "pa": at(inner[:-1]) if inner else members, "leaf": ids.quote(inner[-1].name or "") if inner else ""}


def column_metrics(node: Node, is_json: bool = False) -> Iterator[Metric]:
    tags = {node.kind} | ({"under_struct"} if node.parent is not None and node.parent.kind == "struct" else set()) | ({"json"} if is_json else set())
    return (m for m in COLUMN_METRICS if m.kinds == ANY or tags & set(m.kinds))


def member_metrics(node: Node) -> Iterator[Metric]:
    tags = {node.kind} | ({"under_struct"} if node.path[-1].kind == ids.FIELD else set())
    return (m for m in MEMBER_METRICS if m.kinds == ANY or tags & set(m.kinds))
