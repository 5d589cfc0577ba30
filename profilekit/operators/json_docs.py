"""JSON in string fields: shape, path catalogue, and checks of paths over the full scope.

Texts become variants once; levels are walked breadth first with ``variant_explode``, one level of the catalogue a step.
Keys that look like data (odd names, too many, or in too few documents) are merged into ``*`` before they are
grouped by, so the catalogue stays small on any input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.functions import detect
from profilekit.operators.semantics import whole
from profilekit.plans.measure import Spec
from profilekit.plans.registry import Metric, sql_path
from profilekit.plans.tree import Node

# Which keys count as names of fields, how often they must occur, and how types read in variant schemas.
KEY_NAME = r"^[A-Za-z_][A-Za-z0-9_\-. ]{0,63}$"
PLAIN_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
LEAST_SHARE, LEAST_DOCUMENTS, MAX_LISTED_KEYS = 0.1, 2.0, 50
TYPE_PATTERNS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", "null": "^VOID$"}
TYPES = tuple(TYPE_PATTERNS)


def _type(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    out = F.when(shape == "VOID", "null")
    for name, pattern in TYPE_PATTERNS.items():
        out = out.when(shape.rlike(pattern), name)
    return out


def documents(values: DataFrame) -> DataFrame:
    """path, doc, v (variant), root (type, NULL: no JSON) of complete values; a blank text is no JSON."""
    parsed = whole(values).select("path", F.monotonically_increasing_id().alias("doc"), F.try_parse_json(detect.stripped(F.col("value"))).alias("v"))
    return parsed.withColumn("root", _type(F.col("v")))


def _members(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Members of objects and arrays: ``keep`` columns, key (NULL: array), child, type."""
    columns = ", ".join(keep)
    return docs.sparkSession.sql(f"SELECT {columns}, m.key AS key, m.value AS child FROM {{docs}} d, LATERAL variant_explode(d.v) m", docs=docs).withColumn("type", _type(F.col("child")))


def shape(docs: DataFrame) -> DataFrame:
    """One row a path: counts of roots, share of valid texts, kinds present, distinct key sets, conflicting keys, number of keys, odd keys."""

    def n(condition: Column, name: str) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    root = F.col("root")
    keys = F.when(root == "object", F.array_sort(F.array_distinct(F.json_object_keys(F.to_json("v")))))
    base = docs.groupBy("path").agg(
        F.count(F.lit(1)).alias("eligible"), n(root == "object", "object"), n(root == "array", "array"), n(root.isin("string", "number", "boolean"), "scalar"),
        n(root == "null", "json_null_literal"), n(root.isNull(), "invalid"), F.count_distinct(keys).alias("distinct_object_key_sets"),
    )
    by_key = key_types(docs).groupBy("path").agg(F.count_if(F.size(F.filter("types", lambda t: t["type"] != "null")) > 1).alias("keys_with_conflicting_types"), F.count(F.lit(1)).alias("n_keys"), F.count_if(~F.col("key").rlike(KEY_NAME)).alias("odd_keys"))
    present = sum((F.col(c) > 0).cast("int") for c in ("object", "array", "scalar", "json_null_literal"))
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("keys_with_conflicting_types", "n_keys", "odd_keys")}
    out = base.join(by_key, "path", "left").withColumns(zeros)
    return out.withColumn("valid_ratio", (F.col("eligible") - F.col("invalid")) / F.nullif("eligible", F.lit(0))).withColumn("top_level_kinds_present", present.cast("long"))


def key_types(docs: DataFrame) -> DataFrame:
    """path, key, present_in, presence_ratio, types (type, n) of the keys of root objects."""
    objects = docs.where("root = 'object'")
    each = _members(objects, ["path", "doc"]).groupBy("path", "key", "type").agg(F.count(F.lit(1)).alias("n"))
    keyed = each.groupBy("path", "key").agg(F.sum("n").alias("present_in"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"))  # at most one entry a type
    total = objects.groupBy("path").agg(F.count(F.lit(1)).alias("objects"))
    return keyed.join(total, "path").select("path", "key", "present_in", (F.col("present_in") / F.col("objects")).alias("presence_ratio"), "types")


def _listed_keys(members: DataFrame, frontier: DataFrame, max_keys: int) -> DataFrame:
    """(path, at, key) of the keys that keep their names: at most ``max_keys`` an object path.

    Collected and given back as a local frame, so that each level's plan is one step longer than the last one's instead
    of several times as large.
    """
    by = ["path", "at"]
    objects = frontier.where("type = 'object'").groupBy(*by).agg(F.count_distinct("doc").alias("documents"))
    keys = members.where("key is not null").groupBy(*by, "key").agg(F.count_distinct("doc").alias("docs"))
    least = F.greatest(F.lit(LEAST_DOCUMENTS), LEAST_SHARE * F.col("documents"))
    judged = keys.join(objects, by).withColumn("rare", F.col("docs") < least)
    kept = F.when(~F.col("rare") & F.col("key").rlike(KEY_NAME), F.col("key"))
    few = judged.groupBy(*by).agg(F.max((~F.col("key").rlike(KEY_NAME)).cast("int")).alias("odd"), F.count(F.lit(1)).alias("n"), F.collect_set(kept).alias("keys"))
    rows = few.where((F.col("odd") == 0) & (F.col("n") <= max_keys)).select(*by, F.explode("keys").alias("key")).collect()
    return members.sparkSession.createDataFrame(rows, "path string, at string, key string")


def _named(members: DataFrame, frontier: DataFrame, max_keys: int) -> DataFrame:
    """Members with ``step``, the segment of the path that leads to them."""
    listed = _listed_keys(members, frontier, max_keys).withColumn("listed", F.lit(True))
    out = members.join(F.broadcast(listed), ["path", "at", "key"], "left")  # at most max_keys rows an object path
    name = F.when(F.col("key").rlike(PLAIN_NAME), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit('["'), F.col("key"), F.lit('"]')))
    return out.withColumn("step", F.when(F.col("key").isNull(), "[*]").when(F.col("listed"), name).otherwise(".*"))


def catalogue(docs: DataFrame, max_depth: int = 3, max_keys: int = 50) -> DataFrame:
    """path, json_path, depth, present_in, presence_ratio, occurrences, n_<type>, heterogeneous, dominant_type, map_like; deeper says if members lie below ``max_depth``."""
    roots = docs.where("root in ('object', 'array')")
    total = roots.groupBy("path").agg(F.count(F.lit(1)).alias("documents"))
    frontier = roots.select("path", F.lit("$").alias("at"), "doc", "v", F.col("root").alias("type"))
    out = None
    for depth in range(1, max_depth + 1):
        named = _named(_members(frontier, ["path", "at", "doc"]), frontier, max_keys).select("path", F.concat("at", "step").alias("at"), "doc", F.col("child").alias("v"), "type")
        filled = F.col("type").isin("object", "array") & ~F.to_json("v").isin("{}", "[]")
        stats = named.groupBy("path", "at").agg(
            F.count_distinct("doc").alias("present_in"), F.count(F.lit(1)).alias("occurrences"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
            (F.max(filled.cast("int")) > 0).alias("deeper"),
        ).withColumn("depth", F.lit(depth))
        out = stats if out is None else out.union(stats)
        frontier = named.where(filled)
    assert out is not None
    seen = F.array(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(t).alias("t")) for t in TYPES if t != "null"])
    listed = out.join(total, "path").withColumn("best", F.array_max(seen))
    merged = F.when(F.col("at").endswith(".*"), F.expr("substring(at, 1, length(at) - 2)"))
    likes = F.collect_set(merged).over(Window.partitionBy("path"))  # over paths, not documents
    return listed.withColumn("map_like", F.array_contains(likes, F.col("at"))).select(
        "path", F.col("at").alias("json_path"), "depth", "documents", "present_in", (F.col("present_in") / F.col("documents")).alias("presence_ratio"), "occurrences", *[f"n_{t}" for t in TYPES],
        (sum(((F.col(f"n_{t}") > 0).cast("int") for t in TYPES if t != "null"), F.lit(0)) > 1).alias("heterogeneous"),
        F.when(F.col("best.n") > 0, F.col("best.t")).alias("dominant_type"), F.coalesce("map_like", F.lit(False)).alias("map_like"),
        (F.col("deeper") & (F.col("depth") == max_depth)).alias("deeper"),
    )


def listed_paths(paths: DataFrame, max_paths: int) -> DataFrame:
    """The first ``max_paths`` of each field: by depth, then presence, then name."""
    order = Window.partitionBy("path").orderBy("depth", F.desc("present_in"), "json_path")
    return paths.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_paths)


def engine_path(json_path: str) -> str | None:
    """The path for the engine's own functions; None if it has a wildcard."""
    return None if "[*]" in json_path or ".*" in json_path else json_path.replace('["', "['").replace('"]', "']")


def path_checks(node: Node, paths: Sequence[Mapping[str, Any]], method: str | None = "variant") -> list[Spec]:
    """Expressions that count, over the full scope, where listed paths are and whether they hold their usual type.

    ``get_json_object`` is for runtimes without variants: it cannot tell a JSON null from an absent path.
    """
    usable = [(p, at) for p in paths if (at := engine_path(p["json_path"]))]
    if method is None or not usable:
        return []
    c = sql_path(node.path)
    v = f"try_parse_json({c})"
    root = f"schema_of_variant({v}) RLIKE '^(OBJECT|ARRAY)'" if method == "variant" else f"ltrim({c}) RLIKE '^[{{\\\\[]' AND get_json_object({c}, '$') IS NOT NULL"
    out = [_check(node, "json_documents", f"count_if({root})", method)]
    for p, at in usable:
        sql = at.replace("'", "\\'")
        got = f"try_variant_get({v}, '{sql}', 'variant')"
        if method == "variant":
            out += [_check(node, "path_present_count", f"count_if({got} IS NOT NULL)", method, p), _check(node, "path_json_null_count", f"count_if(is_variant_null({got}))", method, p)]
            if p["dominant_type"]:
                out.append(_check(node, "path_type_match_count", f"count_if(schema_of_variant({got}) RLIKE '{TYPE_PATTERNS[p['dominant_type']]}')", method, p))
        else:
            out.append(_check(node, "path_non_null_count", f"count_if(get_json_object({c}, '{sql}') IS NOT NULL)", method, p))
    return out


_METHODS = {
    "json_documents": "values whose root is a JSON object or array",
    "path_present_count": "documents that have the path, a JSON null included",
    "path_json_null_count": "documents in which the path is a JSON null",
    "path_type_match_count": "documents in which the path has the type most frequent in the sample",
    "path_non_null_count": "documents for which get_json_object gives a value",
}


def _check(node: Node, name: str, sql: str, method: str, path: Mapping[str, Any] | None = None) -> Spec:
    detail = {"method": method} | ({"json_path": path["json_path"], "expected_type": path["dominant_type"] if name == "path_type_match_count" else None} if path else {})
    return Spec(Metric(name, (), 7, sql, "documents", None, _METHODS[name]), node, sql, "json", detail=detail)
