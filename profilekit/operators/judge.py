"""Roles, findings, checks and proposed rules: relational work on the long metrics frame; data are never read again."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("row_count", "element_count", "null_count", "non_null_count", "null_ratio", "approx_distinct_count", "all_values_equal", "min", "max", "empty_count", "max_size", "mean_size", "json_invalid_count")
_TEXTS = ("min", "max", "quantiles")
# Formats that a rule may ask for, and what is said of roles.
RULE_FORMATS = ("uuid", "iso_date", "iso_timestamp", "url", "email_candidate", "numeric_string")
ROLE_LIMITS = {
    "identifier_candidate": "An approximate distinct count proves neither uniqueness nor a primary key; deep.uniqueness checks it exactly.",
    "categorical_candidate": "Few distinct values in the analysed scope; which values are allowed is for a data owner to say.",
    "json_document_candidate": "Based on a sample; json_profile has validity and shape.",
}
FINDINGS = {
    "all_null": ("warning", "All values are null", "A field without any value is often unused, but may be legitimate.", "Holds for the analysed scope only."),
    "high_null_ratio": ("info", "High null ratio", "Sparse fields are often legitimate.", "Nulls of nested fields include rows whose parent is null; see null_count_parent_present."),
    "possible_constant": ("info", "Possibly constant", "Constancy may be a property of the scope.", "Exact for the analysed scope; other data may differ."),
    "possible_categorical": ("info", "Possibly categorical", "A descriptive signal only.", ROLE_LIMITS["categorical_candidate"]),
    "identifier_candidate": ("info", "Identifier candidate", "Approximate cardinality does not prove uniqueness.", ROLE_LIMITS["identifier_candidate"]),
    "probable_json": ("info", "Probable JSON document", "How values are stored is no quality defect.", "Sample-based unless json_invalid_count was measured over the full scope."),
    "extreme_numeric_tail": ("info", "Extreme numeric tail", "Heavy tails are common in amounts and counts.", "Quantiles are approximate; min and max are exact over finite values."),
    "large_arrays": ("warning", "Very large arrays", "Very large arrays cost memory wherever they are exploded.", "Exact over the analysed scope."),
}
NO_FORMATS = "table string, path string, status string, format string, eligible long"


def facts(metrics: DataFrame) -> DataFrame:
    """One row a field (path NULL: the table itself) with the measured metrics that judgements need."""
    ok = F.col("status") == "measured"
    numbers = [F.max(F.when(ok & (F.col("metric") == m), F.col("number"))).alias(m) for m in _NUMBERS]
    texts = [F.max(F.when(ok & (F.col("metric") == m), F.col("value"))).alias(f"{m}_text") for m in _TEXTS]
    reasons = F.max(F.when(F.col("metric").isin("null_count", "null_ratio") & ~ok, F.col("reason"))).alias("null_reason")
    return metrics.groupBy("table", "path", "field_id", "kind").agg(*numbers, *texts, reasons, F.min("position").alias("place"), F.max("scope").alias("scope"), F.first("unit", ignorenulls=True).alias("any_unit"))


def _inside() -> Column:
    return F.col("element_count").isNotNull() | F.col("path").rlike(r"\[\]|\{(key|value)\}")


def roles(fact: DataFrame, thresholds: Mapping[str, Any], formats: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """table, path, role, evidence (JSON). ``nodes``: (table, path, scale) where decimals may be keys (scale 0)."""
    fact = fact.where(F.col("path").isNotNull() & ~_inside())
    n, d, r = F.col("non_null_count"), F.col("approx_distinct_count"), F.col("null_ratio")
    fact = fact.join(F.broadcast(nodes), ["table", "path"], "left") if nodes is not None else fact.withColumn("scale", F.lit(None).cast("int"))
    detected = formats.where("status = 'detected'").select("table", "path", "format") if formats is not None else None
    fact = fact.join(detected, ["table", "path"], "left") if detected is not None else fact.withColumn("format", F.lit(None).cast("string"))
    key_like = F.col("kind").isin("integer", "string") | ((F.col("kind") == "decimal") & (F.col("scale") == 0))
    identifier = key_like & (n >= thresholds["identifier_min_rows"]) & (d / n >= thresholds["identifier_min_distinct_ratio"]) & (r <= thresholds["identifier_max_null_ratio"])
    categorical = F.col("kind").isin("string", "integer") & (n >= thresholds["categorical_min_rows"]) & d.between(2, thresholds["categorical_max_distinct"])

    def metric(name: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))

    base = [metric("approx_distinct_count"), metric("non_null_count")]
    has_format = F.when(F.col("format").isNotNull(), F.format_string('{"observed_format":"%s"}', "format"))
    extra = F.array_compact(F.array(*[F.to_json(b) for b in [*base, metric("null_ratio")]], has_format))
    found = F.array_compact(
        F.array(
            F.when(identifier, F.struct(F.lit("identifier_candidate").alias("role"), F.concat(F.lit("["), F.concat_ws(",", extra), F.lit("]")).alias("evidence"))),
            F.when(categorical, F.struct(F.lit("categorical_candidate").alias("role"), F.to_json(F.array(*base)).alias("evidence"))),
            F.when(F.col("format").isin("json_object", "json_array"), F.struct(F.lit("json_document_candidate").alias("role"), F.format_string('[{"observed_format":"%s"}]', "format").alias("evidence"))),
        )
    )
    return fact.select("table", "path", "field_id", "kind", "place", F.inline(found))


def _quantile(p: float) -> Column:
    points = F.from_json("quantiles_text", "array<struct<probability: double, value: double>>")
    return F.get(F.filter(points, lambda x: x["probability"] == p), F.lit(0))["value"]


def findings(fact: DataFrame, role: DataFrame, thresholds: Mapping[str, Any], json_shapes: DataFrame | None = None) -> DataFrame:
    """table, path, field_id, code, severity, message, evidence (JSON), threshold_name, threshold_value. ``json_shapes``: (table, path, eligible, object, array, scalar, json_null_literal, invalid)."""
    t = thresholds
    held = role.groupBy("table", "path").agg(F.map_from_entries(F.collect_list(F.struct("role", "evidence"))).alias("roles"))  # at most three a field
    f = fact.where(F.col("path").isNotNull()).join(held, ["table", "path"], "left")
    if json_shapes is not None:
        f = f.join(json_shapes.select("table", "path", F.struct("eligible", "object", "array", "scalar", "json_null_literal", "invalid").alias("js")), ["table", "path"], "left")
    else:
        f = f.withColumn("js", F.lit(None).cast("struct<eligible:long,object:long,array:long,scalar:long,json_null_literal:long,invalid:long>"))
    rows = fact.where("path is null").select("table", F.col("row_count").alias("table_rows"))
    f = f.join(F.broadcast(rows), "table", "left")  # a row a table
    unit = F.when(F.col("element_count").isNotNull(), F.col("any_unit")).otherwise("rows")
    size = F.coalesce("element_count", "table_rows")

    def evidence(*names: str) -> Column:
        some = F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(f"{n}_text") if n in ("min", "max") else F.col(n).cast("string")).alias("value")) for n in names]), lambda x: x["value"].isNotNull())
        return F.to_json(some)

    def finding(code: str, when: Column, message: Column, proof: Column, name: str | None = None) -> Column:
        limit = F.lit(float(t[name])) if name else F.lit(None).cast("double")
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(FINDINGS[code][0]).alias("severity"), message.alias("message"), proof.alias("evidence"), F.lit(name).alias("threshold_name"), limit.alias("threshold_value")))

    all_null = (size > 0) & (F.col("null_count") == size)
    high = ~F.coalesce(all_null, F.lit(False)) & (F.col("null_ratio") >= t["high_null_ratio"])
    q1, q3 = _quantile(0.25), _quantile(0.75)
    spread = F.when(q3 > q1, q3 - q1)
    upper, lower = (F.col("max") - q3) / spread, (q1 - F.col("min")) / spread
    structured = (F.col("js.object") + F.col("js.array")) / F.nullif(F.col("js.eligible"), F.lit(0))
    whole = lambda c: c.cast("long")
    found = F.array(
        finding("all_null", all_null, F.format_string("All %d %s in scope are null for this field.", whole(size), unit), evidence("null_count", "null_ratio")),
        finding("high_null_ratio", high, F.format_string("%.1f%% of %s in scope are null.", F.col("null_ratio") * 100, unit), evidence("null_count", "null_ratio"), "high_null_ratio"),
        finding("possible_constant", (F.col("all_values_equal") == 1) & (F.col("non_null_count") >= t["constant_min_rows"]), F.format_string("All %d non-null value(s) in scope are equal.", whole(F.col("non_null_count"))), evidence("all_values_equal", "non_null_count"), "constant_min_rows"),
        finding("possible_categorical", F.col("roles")["categorical_candidate"].isNotNull(), F.lit("Few distinct values relative to rows in scope."), F.col("roles")["categorical_candidate"], "categorical_max_distinct"),
        finding("identifier_candidate", F.col("roles")["identifier_candidate"].isNotNull(), F.lit("The approximate distinct count is close to the number of non-null values."), F.col("roles")["identifier_candidate"], "identifier_min_distinct_ratio"),
        finding("probable_json", structured >= t["json_min_ratio"], F.format_string("%.1f%% of eligible sampled values parse as JSON objects or arrays; %d sampled value(s) are not valid JSON.", structured * 100, F.col("js.invalid")), F.concat(F.lit('[{"sample_json_counts":'), F.to_json(F.col("js").dropFields("eligible")), F.lit("}]")), "json_min_ratio"),
        finding("extreme_numeric_tail", F.col("kind").isin("integer", "float", "decimal") & (F.greatest(upper, lower) > float(t["tail_iqr_multiplier"])), F.format_string("The minimum or maximum lies far outside the interquartile range (upper tail %.1fx, lower tail %.1fx).", upper, lower), evidence("min", "max"), "tail_iqr_multiplier"),
        finding("large_arrays", (F.col("kind") == "array") & (F.col("max_size") >= t["large_array_size"]), F.format_string("The largest array in scope has %d element(s).", whole(F.col("max_size"))), evidence("max_size", "mean_size"), "large_array_size"),
    )
    return f.select("table", "path", "field_id", "place", F.posexplode(F.array_compact(found)).alias("nth", "f")).select("table", "path", "field_id", "place", "nth", "f.*")


_CHECKS = "table string, check_id string, type string, path string, low double, high double, known boolean, profiled boolean, kind string, position int"


def checks(fact: DataFrame, asked: Sequence[Mapping[str, Any]], precise: bool = True) -> DataFrame:
    """One row a configured check: table, check_id, type, path, status, message, observed (text).

    ``asked``: dicts of ``_CHECKS`` without position; ``known`` says whether the column exists, ``profiled`` whether it was
    profiled. Bounds of ``value_range`` are compared as decimals where values have no more than 18 digits on either side.
    """
    spark = fact.sparkSession
    listed = spark.createDataFrame([tuple({**a, "position": k}.get(c.strip().split(" ")[0]) for c in _CHECKS.split(",")) for k, a in enumerate(asked)], _CHECKS)
    f = fact.select(F.col("table").alias("t"), F.col("path").alias("p"), "row_count", "null_count", "null_ratio", "empty_count", "non_null_count", "min", "max", "min_text", "max_text", "null_reason")
    c = listed.join(f, (F.col("table") == F.col("t")) & F.col("path").eqNullSafe(F.col("p")), "left")
    exact = (lambda x: x.try_cast("decimal(38,18)")) if precise else (lambda x: x.cast("double"))
    kind, low, high = F.col("type"), F.col("low"), F.col("high")
    share = F.col("empty_count") / F.nullif("non_null_count", F.lit(0))
    nulls = F.when(kind == "max_null_ratio", F.col("null_ratio")).otherwise(F.col("null_count"))
    table_level = kind.isin("min_row_count", "max_row_count")
    too_low, too_high = exact(F.col("min_text")) < exact(low), exact(F.col("max_text")) > exact(high)
    missing = (low.isNotNull() & F.col("min_text").isNull()) | (high.isNotNull() & F.col("max_text").isNull())

    def verdict(value: Column, good: Column) -> Column:
        return F.when(value.isNull(), "not_evaluated").when(good, "pass").otherwise("fail")

    status = (
        F.when(table_level, verdict(F.col("row_count"), F.when(kind == "min_row_count", F.col("row_count") >= low).otherwise(F.col("row_count") <= high)))
        .when(~F.col("known"), "error")
        .when(~F.col("profiled"), "not_evaluated")
        .when(kind.isin("max_null_ratio", "max_null_count"), verdict(nulls, nulls <= high))
        .when((kind == "max_empty_string_ratio") & (F.col("kind") != "string"), "error")
        .when(kind == "max_empty_string_ratio", verdict(share, share <= high))
        .when(~F.col("kind").isin("integer", "float", "decimal"), "error")
        .when(missing, "not_evaluated")
        .otherwise(F.when(F.coalesce(too_low, F.lit(False)) | F.coalesce(too_high, F.lit(False)), "fail").otherwise("pass"))
    )
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    observed = (
        F.when(table_level, number(F.col("row_count")))
        .when(kind.isin("max_null_ratio", "max_null_count"), number(nulls))
        .when(kind == "max_empty_string_ratio", number(share))
        .otherwise(F.concat_ws(" .. ", "min_text", "max_text"))
    )
    message = (
        F.when(table_level & F.col("row_count").isNull(), "row count in scope was not measured")
        .when(table_level, F.concat(observed, F.lit(" row(s) in scope")))
        .when(~F.col("known"), "column not found in the table schema")
        .when(~F.col("profiled"), "column was not profiled in this run")
        .when(F.col("status") == "error", F.concat(kind, F.when(kind == "value_range", " requires a numeric column").otherwise(" requires a string column")))
        .when(F.col("status") == "not_evaluated", F.concat(F.lit("not measured: "), F.coalesce("null_reason", F.lit("no values in scope, or redacted"))))
        .when(kind == "value_range", F.when(F.col("status") == "pass", "observed finite values within bounds").otherwise(F.concat(F.lit("observed "), observed)))
        .otherwise(F.concat(kind, F.lit(": observed "), observed))
    )
    out = c.withColumn("status", status).withColumn("observed", F.when(F.col("status").isin("pass", "fail"), observed)).withColumn("message", message)
    return out.select("table", "check_id", "type", "path", "status", "message", "observed", "position")


def rules(fact: DataFrame, role: DataFrame, thresholds: Mapping[str, Any], formats: DataFrame | None = None, keys: DataFrame | None = None, nullable: DataFrame | None = None) -> DataFrame:
    """table, path, rule_type, parameters (JSON), basis. Proposals only; an exact check with duplicates rules ``unique`` out.

    ``keys``: (table, columns array, outcome); ``nullable``: (table, path, nullable) as declared.
    """
    f = fact.where(F.col("path").isNotNull() & ~_inside())
    f = f.join(nullable, ["table", "path"], "left") if nullable is not None else f.withColumn("nullable", F.lit(True))
    spark = fact.sparkSession
    none = F.lit("{}")
    out = f.where((F.col("null_count") == 0) & (F.col("non_null_count") >= thresholds["identifier_min_rows"]) & F.coalesce("nullable", F.lit(True))).select("table", "path", F.lit("not_null").alias("rule_type"), none.alias("parameters"), F.lit("no nulls although declared nullable").alias("basis"))
    keys = keys if keys is not None else spark.createDataFrame([], "table string, columns array<string>, outcome string")
    single = keys.where(F.size("columns") == 1).select("table", F.get("columns", F.lit(0)).alias("path"), "outcome")
    good = ["unique", "unique_non_null"]
    ids = role.where("role = 'identifier_candidate'").join(single, ["table", "path"], "left").where(F.col("outcome").isNull() | F.col("outcome").isin(*good))
    out = out.union(ids.select("table", "path", F.lit("unique"), none, F.when(F.col("outcome").isNull(), "approximate distinct count").otherwise("exact uniqueness check")))
    out = out.union(role.where("role = 'categorical_candidate'").select("table", "path", F.lit("accepted_values"), F.lit('{"values":null}'), F.lit("few distinct values")))
    if formats is not None:
        seen = formats.where("status = 'detected'")
        top = F.when(F.col("format") == "json_object", '{"expected_top_level":"object"}').otherwise('{"expected_top_level":"array"}')
        out = out.union(seen.where(F.col("format").isin("json_object", "json_array")).select("table", "path", F.lit("valid_json"), top, F.lit("sampled values parse as JSON")))
        out = out.union(seen.where(F.col("format").isin(*RULE_FORMATS)).select("table", "path", F.lit("matches_format"), F.format_string('{"format":"%s"}', "format"), F.lit("sampled values match the format")))
    rest = keys.where(F.col("outcome").isin(*good)).join(role.where("role = 'identifier_candidate'").select("table", F.array("path").alias("columns")), ["table", "columns"], "left_anti")
    one = F.size("columns") == 1
    return out.union(rest.select("table", F.when(one, F.get("columns", F.lit(0))), F.lit("unique"), F.when(one, none).otherwise(F.to_json(F.struct("columns"))), F.lit("exact uniqueness check")))


def as_json(text: str | None) -> Any:
    return json.loads(text) if text else None
