"""The catalogue of queries over the supplied tables, each with SQL for an independent engine where SQL can say it.

Inputs have no nulls, structs, maps, decimals or dates, so several queries first derive columns that do; the SQL derives
the same. Results are long: names, and values as double, bigint, varchar or boolean.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit import identifiers as ids
from profilekit import runner
from profilekit.config import defaults, merge, validated
from profilekit.contract.invariants import profile_errors
from profilekit.functions import access
from profilekit.operators import aggregate, distinct, judge, json_docs, keys, quantiles, referential, semantics
from profilekit.plans.measure import plan_measures
from profilekit.plans.tree import Node, Tree, schema_tree, select
from profilekit.sources import constraints
from profilekit.sources.tables import at_path
from profilekit.streaming import profile as stream

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CONFIG, PRECISE = defaults(), merge(defaults(), {"metrics": {"quantile_accuracy": 1000000}})
REFERENCE = dt.datetime(1998, 1, 1, tzinfo=dt.UTC)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return at_path(spark, f"{sf_dir}/{name}.parquet").frame


def path(text: str) -> ids.Path:
    return ids.parse_path(text)


def nodes_of(df: DataFrame, columns: Collection[str] | None = None, depth: int = 5) -> tuple[Tree, list[Node]]:
    tree = schema_tree(df.schema, depth)
    return tree, select(tree, columns)[0]


def members_of(tree: Tree) -> list[Node]:
    return [n for n in tree if sum(s.kind != ids.FIELD for s in n.path) == 1]


def long(df: DataFrame, only: Collection[str], name: str = "t", columns: Collection[str] | None = None, config: Mapping[str, Any] = CONFIG, deep: bool = False, **more: Any) -> DataFrame:
    tree, nodes = nodes_of(df, columns)
    plan = plan_measures(nodes, config, REFERENCE, members=members_of(tree) if deep else (), only=only, **more)
    return aggregate.measure(df, plan, name)


def values(frame: DataFrame, *metrics: str, digits: int | None = None) -> DataFrame:
    """field, metric, value of measured rows."""
    number = F.round("number", digits) if digits is not None else F.col("number") + 0.0  # -0.0 is 0.0
    return frame.where(F.col("metric").isin(*metrics) & (F.col("status") == "measured")).select(F.coalesce("path", F.lit("")).alias("field"), "metric", number.alias("value"))


def stacked(source: str, rows: Sequence[tuple[str, str, str]], with_: str = "", digits: int | None = None) -> str:
    """SQL for field, metric, value: one aggregate a row."""
    shape = "CAST({} AS DOUBLE) + 0" if digits is None else f"round(CAST({{}} AS DOUBLE), {digits})"
    selects = [f"SELECT '{f}' AS field, '{m}' AS metric, {shape.format(e)} AS value FROM {source}" for f, m, e in rows]
    return with_ + "\nUNION ALL ".join(selects)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# standard level

_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS partly, CASE WHEN o_orderkey >= 0 THEN NULL ELSE o_orderstatus END AS none FROM {}"
_NULL_METRICS = ("row_count", "null_count", "non_null_count", "null_ratio")


def _null_rows(fields: Sequence[str]) -> list[tuple[str, str, str]]:
    out = [("", "row_count", "count(*)")]
    for f in fields:
        out += [(f, "null_count", f"count(*) FILTER (WHERE {f} IS NULL)"), (f, "non_null_count", f"count({f})"), (f, "null_ratio", f"round(count(*) FILTER (WHERE {f} IS NULL) / count(*), 9)")]
    return out


def _named(sql: str, name: str) -> str:
    return f"SELECT '{name}' AS table_name, field, metric, value FROM ({sql})"


@query("\nUNION ALL ".join([_named(stacked(t, _null_rows(c.split())), t) for t, c in _COLUMNS.items()] + [_named(stacked(f"({_HOLES.format('orders')})", _null_rows(["o_orderkey", "partly", "none"])), "holes")]))
def std_row_and_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    frames["holes"] = spark.sql(_HOLES.format("{orders}"), orders=frames["orders"])
    out = [long(df, ("null_count",), t) for t, df in frames.items()]
    whole = [values(f, *_NULL_METRICS).withColumn("value", F.when(F.col("metric") == "null_ratio", F.round("value", 9)).otherwise(F.col("value"))).withColumn("table_name", F.lit(t)) for t, f in zip(frames, out, strict=True)]
    return union(whole)


_NUMERIC_FIELDS = {"lineitem": ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "customer": ("c_custkey", "c_nationkey", "c_acctbal")}
_SIGNS = {"min": "min({})", "max": "max({})", "zero_count": "count(*) FILTER (WHERE {} = 0)", "negative_count": "count(*) FILTER (WHERE {} < 0)", "positive_count": "count(*) FILTER (WHERE {} > 0)"}


@query("\nUNION ALL ".join(stacked(t, [(f, m, e.format(f)) for f in fs for m, e in _SIGNS.items()]) for t, fs in _NUMERIC_FIELDS.items()))
def std_numeric_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([values(long(table(spark, sf_dir, t), _SIGNS, t, fs), *_SIGNS) for t, fs in _NUMERIC_FIELDS.items()])


_MOMENTS = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount"), "orders": ("o_totalprice", "o_custkey")}


@query("\nUNION ALL ".join(stacked(t, [(f, m, e.format(f)) for f in fs for m, e in (("mean", "avg({})"), ("stddev", "stddev_samp({})"))], digits=4) for t, fs in _MOMENTS.items()))
def std_numeric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([values(long(table(spark, sf_dir, t), ("mean", "stddev"), t, fs), "mean", "stddev", digits=4) for t, fs in _MOMENTS.items()])


_Q = (0.05, 0.25, 0.5, 0.75, 0.95)


def _points(frame: DataFrame, metric: str) -> DataFrame:
    points = F.from_json("value", "array<struct<probability: double, value: double>>")
    return frame.where(F.col("metric") == metric).select(F.col("path").alias("field"), F.inline(points)).select("field", "probability", "value")


def _quantile_sql(source: str, fields: Mapping[str, str], function: str, digits: int | None = None) -> str:
    one = f"CAST({function}({{e}}, {{q}}) AS DOUBLE)" if digits is None else f"round(CAST({function}({{e}}, {{q}}) AS DOUBLE), {digits})"
    return "\nUNION ALL ".join(f"SELECT '{f}' AS field, CAST({q} AS DOUBLE) AS probability, {one.format(e=e, q=q)} AS value FROM {source}" for f, e in fields.items() for q in _Q)


_QF = {f: f for f in ("l_quantity", "l_extendedprice", "l_discount")}


@query(_quantile_sql("lineitem", _QF, "quantile_disc"))
def std_quantiles_high_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(long(table(spark, sf_dir, "lineitem"), ("quantiles",), columns=_QF, config=PRECISE), "quantiles")


@query(_quantile_sql("lineitem", _QF, "quantile_cont", 4) + "\nUNION ALL " + _quantile_sql("orders", {"o_totalprice": "o_totalprice"}, "quantile_cont", 4))
def std_quantiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, as ``percentile`` has it, by ranks: no task holds the distinct values."""
    def exact(t: str, fields: Collection[str]) -> DataFrame:
        found = quantiles.interpolated(table(spark, sf_dir, t), list(fields), _Q)
        cells = [F.struct(F.lit(f).alias("field"), F.lit(q).alias("probability"), F.round(F.lit(v).cast("double"), 4).alias("value")) for f, vs in found.items() for q, v in zip(_Q, vs, strict=True)]
        return spark.range(1).select(F.inline(F.array(*cells)))

    return exact("lineitem", list(_QF)).union(exact("orders", ["o_totalprice"]))


@query("\nUNION ALL ".join(f"SELECT '{f}' AS field, CAST({q} AS DOUBLE) AS probability, CAST(count({f}) AS BIGINT) AS n, true AS within FROM lineitem" for f in _QF for q in _Q))
def std_quantiles_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default accuracy: the ranks of each value, counted exactly, hold the probability within the promised error."""
    d = table(spark, sf_dir, "lineitem")
    points = _points(long(d, ("quantiles",), columns=_QF), "quantiles")
    members = d.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in _QF])))
    ranks = members.join(F.broadcast(points), "field").groupBy("field", "probability")  # a row a field and probability
    counted = ranks.agg(F.count("x").alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    error = F.col("n") / CONFIG["metrics"]["quantile_accuracy"] + 1  # ranks; a rank is a whole number
    within = (F.col("below") <= F.col("probability") * F.col("n") + error) & (F.col("upto") >= F.col("probability") * F.col("n") - error)
    return counted.select("field", "probability", "n", within.alias("within"))


_DISTINCT = {"lineitem": ("l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag"), "orders": ("o_custkey", "o_orderpriority"), "events": ("user_id", "value", "event_type")}


@query("\nUNION ALL ".join(f"SELECT '{f}' AS field, CAST(count(DISTINCT {f}) AS BIGINT) AS exact_count, true AS within FROM {t}" for t, fs in _DISTINCT.items() for f in fs))
def std_distinct_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate count, held against an exact one within three standard errors."""
    out = []
    for t, fs in _DISTINCT.items():
        df = table(spark, sf_dir, t)
        near = long(df, ("approx_distinct_count",), t, fs).where("metric = 'approx_distinct_count'").select(F.col("path").alias("field"), "number")
        exact = keys.uniqueness(df, {f: [path(f)] for f in fs}).select(F.col("key").alias("field"), F.col("distinct_keys").alias("exact_count"))
        error = F.abs(F.col("number") - F.col("exact_count")) <= 3 * CONFIG["metrics"]["approx_distinct_rsd"] * F.col("exact_count") + 1
        out.append(near.join(exact, "field").select("field", "exact_count", error.alias("within")))
    return union(out)


_SAME = "SELECT c_custkey, 'x' AS one, 7 AS seven, CASE WHEN c_custkey < 0 THEN 1 END AS nothing FROM {}"


@query(f"WITH d AS ({_SAME.format('customer')}) SELECT 'c_custkey' AS field, min(c_custkey) = max(c_custkey) AS equal, 'measured' AS status FROM d UNION ALL SELECT 'one', min(one) = max(one), 'measured' FROM d UNION ALL SELECT 'seven', min(seven) = max(seven), 'measured' FROM d UNION ALL SELECT 'nothing', NULL, 'insufficient_data'")
def std_all_values_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_SAME.format("{c}"), c=table(spark, sf_dir, "customer"))
    return long(d, ("all_values_equal",)).where("metric = 'all_values_equal'").select(F.col("path").alias("field"), F.col("value").cast("boolean").alias("equal"), "status")


_SPECIAL = "SELECT CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 83 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM {}"
_SPECIALS = {
    "nan_count": "count(*) FILTER (WHERE isnan(v))", "positive_infinity_count": "count(*) FILTER (WHERE v = CAST('Infinity' AS DOUBLE))", "negative_infinity_count": "count(*) FILTER (WHERE v = CAST('-Infinity' AS DOUBLE))",
    "finite_count": "count(*) FILTER (WHERE isfinite(v))", "min": "min(v) FILTER (WHERE isfinite(v))", "max": "max(v) FILTER (WHERE isfinite(v))", "mean": "avg(v) FILTER (WHERE isfinite(v))",
    "zero_count": "count(*) FILTER (WHERE isfinite(v) AND v = 0)", "negative_count": "count(*) FILTER (WHERE isfinite(v) AND v < 0)", "positive_count": "count(*) FILTER (WHERE isfinite(v) AND v > 0)", "null_count": "count(*) FILTER (WHERE v IS NULL)",
}


@query(stacked("d", [("v", m, e) for m, e in _SPECIALS.items()], f"WITH d AS ({_SPECIAL.format('events')}) ", digits=6))
def std_float_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_SPECIAL.format("{e}"), e=table(spark, sf_dir, "events"))
    return values(long(d, _SPECIALS), *_SPECIALS, digits=6)


_TEXTS = {"part": ("p_name", "p_brand"), "documents": ("text", "lang"), "customer": ("c_name",)}
_BLANKED = "SELECT CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '  ' WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS blanked FROM {}"
_LENGTHS = {"empty_count": "count(*) FILTER (WHERE {} = '')", "whitespace_only_count": r"count(*) FILTER (WHERE {} <> '' AND regexp_matches({}, '^\s+$'))", "min_length": "min(length({}))", "max_length": "max(length({}))", "mean_length": "avg(length({}))"}


@query("\nUNION ALL ".join([stacked(t, [(f, m, e.format(f, f)) for f in fs for m, e in _LENGTHS.items()], digits=4) for t, fs in _TEXTS.items()] + [stacked(f"({_BLANKED.format('part')})", [("blanked", m, e.format("blanked", "blanked")) for m, e in _LENGTHS.items()], digits=4)]))
def std_string_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [(table(spark, sf_dir, t), fs) for t, fs in _TEXTS.items()] + [(spark.sql(_BLANKED.format("{p}"), p=table(spark, sf_dir, "part")), ("blanked",))]
    return union([values(long(df, _LENGTHS, columns=fs), *_LENGTHS, digits=4) for df, fs in frames])


@query(_quantile_sql("documents", {"text": "length(text)", "lang": "length(lang)"}, "quantile_disc"))
def std_string_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(long(table(spark, sf_dir, "documents"), ("length_quantiles",), columns=("text", "lang"), config=PRECISE), "length_quantiles")


_FLAGS = "SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag = 'R' END AS flag FROM {}"


@query(stacked("d", [("flag", "true_count", "count(*) FILTER (WHERE flag)"), ("flag", "false_count", "count(*) FILTER (WHERE NOT flag)"), ("flag", "null_count", "count(*) FILTER (WHERE flag IS NULL)")], f"WITH d AS ({_FLAGS.format('lineitem')}) "))
def std_boolean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_FLAGS.format("{l}"), l=table(spark, sf_dir, "lineitem"))
    wanted = ("true_count", "false_count", "null_count")
    return values(long(d, wanted), *wanted)


_TIMES = "SELECT CAST(o_orderdate AS DATE) AS day, o_orderdate AS local_time FROM {}"
_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


@query(
    f"WITH d AS ({_TIMES.format('orders')}) SELECT 'day' AS field, 'min' AS metric, 'measured' AS status, CAST(min(day) AS VARCHAR) AS value FROM d UNION ALL SELECT 'day', 'max', 'measured', CAST(max(day) AS VARCHAR) FROM d"
    f" UNION ALL SELECT 'local_time', 'min', 'measured', {_STAMP.format('min(local_time)')} FROM d UNION ALL SELECT 'local_time', 'max', 'measured', {_STAMP.format('max(local_time)')} FROM d"
    f" UNION ALL SELECT 'day', 'after_reference_count', 'measured', CAST(count(*) FILTER (WHERE day > DATE '1998-01-01') AS VARCHAR) FROM d UNION ALL SELECT 'local_time', 'after_reference_count', 'not_computed', NULL"
    f" UNION ALL SELECT 'instant', 'min', 'measured', {_STAMP.format('min(local_time)')} || 'Z' FROM d UNION ALL SELECT 'instant', 'max', 'measured', {_STAMP.format('max(local_time)')} || 'Z' FROM d"
    " UNION ALL SELECT 'instant', 'after_reference_count', 'measured', CAST(count(*) FILTER (WHERE local_time > TIMESTAMP '1998-01-01 00:00:00') AS VARCHAR) FROM d"
)
def std_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_TIMES.format("{o}"), o=table(spark, sf_dir, "orders")).withColumn("instant", F.to_utc_timestamp(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "local_time").cast("timestamp"), "UTC"))
    wanted = ("min", "max", "after_reference_count")
    return long(d, wanted).where(F.col("metric").isin(*wanted)).select(F.col("path").alias("field"), "metric", "status", "value")


@query(stacked("part", [("b", "min_length", "min(strlen(p_name))"), ("b", "max_length", "max(strlen(p_name))"), ("b", "null_count", "count(*) - count(p_name)"), ("b", "non_null_count", "count(p_name)")]))
def std_binary_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_name").cast("binary").alias("b"))
    wanted = ("min_length", "max_length", "null_count", "non_null_count")
    return values(long(d, wanted), *wanted)


_OUTER = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1 END"
_INNER = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END"


@query(
    f"WITH d AS (SELECT {_OUTER} AS p, {_INNER} AS c FROM orders) SELECT 's' AS field, 'null_count' AS metric, CAST(count(*) FILTER (WHERE p IS NULL) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS denominator FROM d"
    " UNION ALL SELECT 's.c', 'null_count', CAST(count(*) FILTER (WHERE p IS NULL OR c IS NULL) AS DOUBLE), count(*) FROM d"
    " UNION ALL SELECT 's.c', 'null_count_parent_present', CAST(count(*) FILTER (WHERE p IS NOT NULL AND c IS NULL) AS DOUBLE), count(p) FROM d"
    " UNION ALL SELECT 's.c', 'null_ratio_given_parent_present', round(CAST(count(*) FILTER (WHERE p IS NOT NULL AND c IS NULL) AS DOUBLE) / count(p), 9), count(p) FROM d"
)
def std_struct_parent_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").selectExpr(f"CASE WHEN {_OUTER} IS NOT NULL THEN named_struct('c', {_INNER}) END AS s")
    wanted = ("null_count", "null_count_parent_present", "null_ratio_given_parent_present")
    out = long(d, wanted).where(F.col("metric").isin(*wanted))
    return out.select(F.col("path").alias("field"), "metric", F.round("number", 9).alias("value"), "denominator")


_SIZES = ("null_count", "empty_count", "min_size", "max_size", "mean_size", "total_element_count", "null_element_count")


def _size_rows(f: str) -> list[tuple[str, str, str]]:
    return [
        (f, "null_count", f"count(*) FILTER (WHERE {f} IS NULL)"), (f, "empty_count", f"count(*) FILTER (WHERE len({f}) = 0)"), (f, "min_size", f"min(len({f}))"), (f, "max_size", f"max(len({f}))"), (f, "mean_size", f"avg(len({f}))"),
        (f, "total_element_count", f"coalesce(sum(len({f})), 0)"), (f, "null_element_count", f"coalesce(sum(len(list_filter({f}, lambda x: x IS NULL))), 0)"),
    ]


_LISTS = "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN {empty} WHEN o_orderkey % 6 = 2 THEN {some} ELSE {one} END"
_DUCK_LISTS = _LISTS.format(empty="CAST([] AS BIGINT[])", some="[o_custkey, NULL, o_orderkey, -1]", one="[o_custkey]")
_SPARK_LISTS = _LISTS.format(empty="CAST(array() AS array<bigint>)", some="array(o_custkey, NULL, o_orderkey, -1L)", one="array(o_custkey)")


@query(stacked("embeddings", _size_rows("embedding"), digits=4) + "\nUNION ALL " + stacked(f"(SELECT {_DUCK_LISTS} AS list FROM orders)", _size_rows("list"), digits=4))
def std_array_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").selectExpr(f"{_SPARK_LISTS} AS list")
    return values(long(table(spark, sf_dir, "embeddings"), _SIZES, columns=("embedding",)), *_SIZES, digits=4).union(values(long(made, _SIZES), *_SIZES, digits=4))


_DUCK_MAP = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN MAP([o_orderstatus, 'k'], [NULL, o_custkey]) ELSE MAP([o_orderstatus], [o_custkey]) END"
_SPARK_MAP = _DUCK_MAP.replace("MAP([o_orderstatus, 'k'], [NULL, o_custkey])", "map(o_orderstatus, NULL, 'k', o_custkey)").replace("MAP([o_orderstatus], [o_custkey])", "map(o_orderstatus, o_custkey)")
_MAP_METRICS = {"null_count": "count(*) FILTER (WHERE m IS NULL)", "min_size": "min(cardinality(m))", "max_size": "max(cardinality(m))", "mean_size": "avg(cardinality(m))", "total_entry_count": "sum(cardinality(m))", "null_value_count": "sum(len(list_filter(map_values(m), lambda x: x IS NULL)))"}


@query(stacked(f"(SELECT {_DUCK_MAP} AS m FROM orders)", [("m", k, v) for k, v in _MAP_METRICS.items()], digits=4))
def std_map_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(long(table(spark, sf_dir, "orders").selectExpr(f"{_SPARK_MAP} AS m"), _MAP_METRICS), *_MAP_METRICS, digits=4)


_BROKEN = "SELECT CASE WHEN event_id % 10 = 0 THEN '{{\"k\": ' WHEN event_id % 10 = 1 THEN 'no json' WHEN event_id % 10 = 2 THEN NULL ELSE props END AS j FROM {}"


@query(stacked("d", [("j", "json_invalid_count", "count(*) FILTER (WHERE j IS NOT NULL AND NOT json_valid(j))"), ("j", "null_count", "count(*) FILTER (WHERE j IS NULL)")], f"WITH d AS ({_BROKEN.format('events')}) "))
def std_json_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").selectExpr(_BROKEN.replace("{{", "{").removeprefix("SELECT ").removesuffix(" FROM {}"))
    return values(long(d, ("json_invalid_count", "null_count"), json_nodes={"j"}), "json_invalid_count", "null_count")


# filters, plans, schema

_FILTERS: dict[str, tuple[dict[str, Any], str]] = {
    "eq": ({"operator": "eq", "value": "F", "column": "o_orderstatus"}, "o_orderstatus = 'F'"),
    "ne": ({"operator": "ne", "value": 7, "value_type": "integer", "column": "cust"}, "cust <> 7"),
    "lt": ({"operator": "lt", "value": "1000.5", "value_type": "decimal", "column": "o_totalprice"}, "o_totalprice < 1000.5"),
    "le": ({"operator": "le", "value": 100000, "value_type": "double", "column": "o_totalprice"}, "o_totalprice <= 100000"),
    "gt": ({"operator": "gt", "value": "1998-01-01", "value_type": "date", "column": "day"}, "day > DATE '1998-01-01'"),
    "ge": ({"operator": "ge", "value": 500, "column": "cust"}, "cust >= 500"),
    "in": ({"operator": "in", "value": ["1-URGENT", "5-LOW"], "column": "o_orderpriority"}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in": ({"operator": "not_in", "value": [1, 2, 3], "value_type": "integer", "column": "cust"}, "cust NOT IN (1, 2, 3)"),
    "between": ({"operator": "between", "value": [10, 20], "column": "cust"}, "cust BETWEEN 10 AND 20"),
    "is_null": ({"operator": "is_null", "column": "cust"}, "cust IS NULL"),
    "is_not_null": ({"operator": "is_not_null", "column": "cust"}, "cust IS NOT NULL"),
    "like": ({"operator": "like", "value": "%-%O%", "column": "o_orderpriority"}, "o_orderpriority LIKE '%-%O%'"),
    "nested": ({"operator": "lt", "value": 50, "column": ["s", "c"]}, "cust < 50"),
}
_FILTERED = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS cust FROM {}"


@query(f"WITH d AS ({_FILTERED.format('orders')}) " + "\nUNION ALL ".join(f"SELECT '{k}' AS operator, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM d WHERE {w}" for k, (_, w) in _FILTERS.items()))
def flt_each_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_FILTERED.format("{o}"), o=table(spark, sf_dir, "orders")).withColumn("s", F.struct(F.col("cust").alias("c")))
    each = [F.struct(F.lit(k).alias("operator"), F.count_if(access.condition(f)).alias("n"), F.sum(F.when(access.condition(f), F.col("o_orderkey"))).alias("checksum")) for k, (f, _) in _FILTERS.items()]
    return d.agg(F.array(*each).alias("all")).select(F.inline("all"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_custkey BETWEEN 1 AND 500")
def flt_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters before projection: they may use columns that are not selected, and reach the scan."""
    filters = [{"column": "o_orderstatus", "operator": "eq", "value": "F"}, {"column": "o_totalprice", "operator": "gt", "value": 100000.0}, {"column": "o_custkey", "operator": "between", "value": [1, 500]}]
    d = access.projected(access.filtered(table(spark, sf_dir, "orders"), filters), ["o_orderkey"])
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("checksum"))


def _local(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _values_sql(rows: Sequence[tuple[Any, ...]], names: str) -> str:
    def lit(v: Any) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    first = names.split(", ")
    casts = ", ".join(f"CAST({n} AS {'BIGINT' if all(isinstance(r[k], int) and not isinstance(r[k], bool) for r in rows) else 'BOOLEAN' if all(isinstance(r[k], bool) for r in rows) else 'VARCHAR'}) AS {n}" for k, n in enumerate(first))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


_TINY = merge(CONFIG, {"limits": {"max_expressions_per_pass": 10, "max_aggregate_passes": 2}})
_DROPPED = [(c, m) for c in ("a", "b") for m in ("stddev", "quantiles")] + [("s", "whitespace_only_count"), ("s", "length_quantiles")] + [("s", "approx_distinct_count"), ("s", "all_values_equal"), ("b", "approx_distinct_count"), ("b", "all_values_equal"), ("a", "all_values_equal"), ("a", "approx_distinct_count")]


@query(_values_sql(sorted(_DROPPED), "field, metric"))
def plan_budget_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expressions go when 20 are allowed: the highest tier first, of a tier the last."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("s"))
    plan = plan_measures(nodes_of(d)[1], _TINY, REFERENCE)
    return _local(spark, [(o["display_path"], m) for o in plan.omissions for m in o["metrics"]], "field string, metric string")


_TREE = [("id", "integer", 1, None), ("s", "struct", 1, None), ("l", "array", 1, None), ("m", "map", 1, None), ("s.a", "decimal", 2, None), ("s.t", "struct", 2, "max_depth"), ("l[]", "struct", 2, "max_depth"), ("m{key}", "string", 2, None), ("m{value}", "float", 2, None)]


@query(_values_sql([(a, b, c, d or "") for a, b, c, d in _TREE], "field, kind, depth, omitted"))
def schema_tree_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "named_struct('a', CAST(1 AS decimal(5,2)), 't', named_struct('x', 1)) AS s", "array(named_struct('q', 1)) AS l", "map('k', 1.5D) AS m")
    return _local(spark, [(n.display, n.kind, n.depth, n.omitted_reason or "") for n in schema_tree(d.schema, 2, 9)], "field string, kind string, depth long, omitted string")


# deep level

_KINDS = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE {array}({items}) END"
_KIND_ITEMS = {
    "b": "event_id % 2 = 0, CAST(NULL AS BOOLEAN), event_id % 5 = 0",
    "t": "ts, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '1990-01-01 00:00:00' END",
    "x": "value, CASE WHEN event_id % 3 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END",
    "s": "event_type, CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN '' ELSE ' x' END",
}
_KIND_SQL = {
    "b": {"element_count": "count(*)", "null_count": "count(*) FILTER (WHERE v IS NULL)", "true_count": "count(*) FILTER (WHERE v)", "false_count": "count(*) FILTER (WHERE NOT v)"},
    "t": {"null_count": "count(*) FILTER (WHERE v IS NULL)", "after_reference_count": "count(*) FILTER (WHERE v > TIMESTAMP '1998-01-01 00:00:00')"},
    "x": {"positive_infinity_count": "count(*) FILTER (WHERE v = CAST('Infinity' AS DOUBLE))", "negative_infinity_count": "count(*) FILTER (WHERE v = CAST('-Infinity' AS DOUBLE))", "nan_count": "count(*) FILTER (WHERE isnan(v))", "finite_count": "count(*) FILTER (WHERE isfinite(v))"},
    "s": {"empty_count": "count(*) FILTER (WHERE v = '')", "whitespace_only_count": "count(*) FILTER (WHERE v <> '' AND trim(v) = '')", "min_length": "min(length(v))", "max_length": "max(length(v))"},
}


@query("\nUNION ALL ".join(stacked(f"(SELECT unnest({_KINDS.format(array='list_value', items=_KIND_ITEMS[f])}) AS v FROM events)", [(f"{f}[]", m, e) for m, e in ms.items()]) for f, ms in _KIND_SQL.items()))
def deep_member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are booleans, instants, infinities and blank strings."""
    d = table(spark, sf_dir, "events").selectExpr(*[f"{_KINDS.format(array='array', items=i)} AS {f}" for f, i in _KIND_ITEMS.items()])
    wanted = tuple(dict.fromkeys(m for ms in _KIND_SQL.values() for m in ms))
    found = values(long(d, (*wanted, "total_element_count", "null_count", "non_null_count"), deep=True).where("path like '%[]'"), *wanted)
    asked = F.array(*[F.lit(f"{f}[] {m}") for f, ms in _KIND_SQL.items() for m in ms])
    return found.where(F.array_contains(asked, F.concat_ws(" ", "field", "metric")))


_MEMBERS = ("element_count", "null_count", "non_null_count", "min", "max", "zero_count", "negative_count", "positive_count", "finite_count", "nan_count")


def _member_sql(field: str, source: str) -> str:
    rows = [(field, "element_count", "count(*)"), (field, "null_count", "count(*) FILTER (WHERE x IS NULL)"), (field, "non_null_count", "count(x)"), (field, "min", "min(x)"), (field, "max", "max(x)"), (field, "zero_count", "count(*) FILTER (WHERE x = 0)"), (field, "negative_count", "count(*) FILTER (WHERE x < 0)"), (field, "positive_count", "count(*) FILTER (WHERE x > 0)")]
    return stacked(f"({source})", rows, digits=6)


_STRUCTS = "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN {two} ELSE {one} END"
_SPARK_STRUCTS = _STRUCTS.format(two="array(named_struct('q', o_custkey, 'n', o_orderstatus), NULL, named_struct('q', CAST(NULL AS bigint), 'n', ''))", one="array(named_struct('q', o_orderkey, 'n', o_orderpriority))")
_DUCK_STRUCTS = _STRUCTS.format(two="[{'q': o_custkey, 'n': o_orderstatus}, NULL, {'q': NULL, 'n': ''}]", one="[{'q': o_orderkey, 'n': o_orderpriority}]")


@query(
    _member_sql("embedding[]", "SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings") + "\nUNION ALL " + stacked("(SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)", [("embedding[]", "finite_count", "count(*) FILTER (WHERE isfinite(x))"), ("embedding[]", "nan_count", "count(*) FILTER (WHERE isnan(x))")])
    + "\nUNION ALL " + _member_sql("l[].q", f"SELECT struct_extract(e, 'q') AS x FROM (SELECT unnest({_DUCK_STRUCTS}) AS e FROM orders)")
    + "\nUNION ALL " + stacked(f"(SELECT e, struct_extract(e, 'q') AS q, struct_extract(e, 'n') AS n FROM (SELECT unnest({_DUCK_STRUCTS}) AS e FROM orders))", [
        ("l[]", "element_count", "count(*)"), ("l[]", "null_count", "count(*) FILTER (WHERE e IS NULL)"), ("l[]", "non_null_count", "count(e)"), ("l[].q", "null_count_parent_present", "count(*) FILTER (WHERE e IS NOT NULL AND q IS NULL)"),
        ("l[].n", "element_count", "count(*)"), ("l[].n", "null_count", "count(*) FILTER (WHERE n IS NULL)"), ("l[].n", "non_null_count", "count(n)"), ("l[].n", "null_count_parent_present", "count(*) FILTER (WHERE e IS NOT NULL AND n IS NULL)"), ("l[].n", "empty_count", "count(*) FILTER (WHERE n = '')"), ("l[].n", "min_length", "min(length(n))"), ("l[].n", "max_length", "max(length(n))")])
)
def deep_array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (*_MEMBERS, "null_count_parent_present", "empty_count", "min_length", "max_length")
    made = table(spark, sf_dir, "orders").selectExpr(f"{_SPARK_STRUCTS} AS l")
    frames = [long(df, (*wanted, "total_element_count"), deep=True) for df in (table(spark, sf_dir, "embeddings").select("embedding"), made)]
    return union([values(f.where("path like '%[]%'"), *wanted, digits=6) for f in frames])


@query(
    "WITH e AS (SELECT unnest(map_entries(m)) AS e FROM (SELECT " + _DUCK_MAP + " AS m FROM orders)), d AS (SELECT struct_extract(e, 'key') AS k, struct_extract(e, 'value') AS v FROM e) "
    + stacked("d", [("m{key}", "element_count", "count(*)"), ("m{key}", "null_count", "count(*) FILTER (WHERE k IS NULL)"), ("m{key}", "min_length", "min(length(k))"), ("m{key}", "max_length", "max(length(k))"), ("m{value}", "element_count", "count(*)"), ("m{value}", "null_count", "count(*) FILTER (WHERE v IS NULL)"), ("m{value}", "min", "min(v)"), ("m{value}", "max", "max(v)"), ("m{value}", "positive_count", "count(*) FILTER (WHERE v > 0)")])
)
def deep_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("element_count", "null_count", "min_length", "max_length", "min", "max", "positive_count")
    d = table(spark, sf_dir, "orders").selectExpr(f"{_SPARK_MAP} AS m")
    return values(long(d, (*wanted, "total_entry_count"), deep=True).where("path like 'm{%'"), *wanted)


@query(
    "SELECT 'embedding[]' AS field, CAST(count(*) AS BIGINT) AS members, CAST(count(x) AS BIGINT) AS non_null_members, CAST(count(DISTINCT x) AS BIGINT) AS distinct_count FROM (SELECT unnest(embedding) AS x FROM embeddings)"
    f" UNION ALL SELECT 'l[].q', count(*), count(struct_extract(e, 'q')), count(DISTINCT struct_extract(e, 'q')) FROM (SELECT unnest({_DUCK_STRUCTS}) AS e FROM orders)"
    f" UNION ALL SELECT 'l[].n', count(*), count(struct_extract(e, 'n')), count(DISTINCT struct_extract(e, 'n')) FROM (SELECT unnest({_DUCK_STRUCTS}) AS e FROM orders)"
)
def deep_element_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for d in (table(spark, sf_dir, "embeddings").select("embedding"), table(spark, sf_dir, "orders").selectExpr(f"{_SPARK_STRUCTS} AS l")):
        out.append(distinct.member_distinct(d, distinct.countable(members_of(schema_tree(d.schema, 5)))).withColumnRenamed("path", "field"))
    return union(out)


# keys

_KEY_SQL = (
    "SELECT '{name}' AS key, CAST(r AS BIGINT) AS rows_in_scope, CAST(r - c AS BIGINT) AS rows_with_null_key, CAST(c AS BIGINT) AS rows_with_complete_key, CAST(d AS BIGINT) AS distinct_keys, CAST(g AS BIGINT) AS duplicate_key_groups, CAST(w AS BIGINT) AS rows_in_duplicate_groups,"
    " CAST(c - d AS BIGINT) AS surplus_duplicate_rows, CAST(m AS BIGINT) AS max_rows_per_key, CASE WHEN c = 0 THEN 'empty' WHEN g > 0 THEN 'duplicates' WHEN r > c THEN 'unique_non_null' ELSE 'unique' END AS outcome"
    " FROM (SELECT coalesce(sum(n), 0) AS r, coalesce(sum(n) FILTER (WHERE ok), 0) AS c, count(*) FILTER (WHERE ok) AS d, count(*) FILTER (WHERE ok AND n > 1) AS g, coalesce(sum(n) FILTER (WHERE ok AND n > 1), 0) AS w, max(n) FILTER (WHERE ok) AS m"
    " FROM (SELECT {cols}, {ok} AS ok, count(*) AS n FROM {source} GROUP BY ALL))"
)


def _key_sql(source: str, wanted: Mapping[str, Sequence[str]]) -> str:
    return "\nUNION ALL ".join(_KEY_SQL.format(name=n, cols=", ".join(c), ok=" AND ".join(f"{x} IS NOT NULL" for x in c), source=source) for n, c in wanted.items())


def _keys(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    return keys.uniqueness(df, {n: [path(c) for c in cols] for n, cols in wanted.items()})


_SINGLE = {"customer": {"c_custkey": ["c_custkey"], "c_name": ["c_name"]}, "orders": {"o_orderkey": ["o_orderkey"]}, "part": {"p_partkey": ["p_partkey"], "p_name": ["p_name"]}, "events": {"event_id": ["event_id"]}, "documents": {"text": ["text"]}}


@query("\nUNION ALL ".join(_key_sql(t, k) for t, k in _SINGLE.items()))
def key_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([_keys(table(spark, sf_dir, t), k) for t, k in _SINGLE.items()])


@query(_key_sql("lineitem", {"l_orderkey,l_linenumber": ["l_orderkey", "l_linenumber"]}))
def key_composite_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(table(spark, sf_dir, "lineitem"), {"l_orderkey,l_linenumber": ["l_orderkey", "l_linenumber"]})


_NULL_KEYS = {"partly": ["partly"], "none": ["none"], "both": ["partly", "o_orderkey"]}
_NULL_KEY_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS partly, CASE WHEN o_orderkey < 0 THEN 1 END AS none FROM {}"


@query(_key_sql(f"({_NULL_KEY_SQL.format('orders')})", _NULL_KEYS))
def key_null_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark.sql(_NULL_KEY_SQL.format("{o}"), o=table(spark, sf_dir, "orders")), _NULL_KEYS)


_MANY = {"a": ["l_orderkey", "l_linenumber"], "b": ["l_partkey"], "c": ["l_orderkey"], "d": ["l_partkey", "l_suppkey"], "e": ["l_shipdate"]}


@query(_key_sql("lineitem", _MANY))
def key_many_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(table(spark, sf_dir, "lineitem"), _MANY)


# references

_REF_COLUMNS = ("source_rows", "source_rows_with_null_key", "source_rows_with_complete_key", "orphan_rows", "target_rows", "target_rows_with_null_key", "target_distinct_keys", "target_duplicate_key_groups")


def _ref_sql(name: str, source: str, s: Sequence[str], target: str, t: Sequence[str]) -> str:
    ok_s, ok_t = " AND ".join(f"s.{c} IS NOT NULL" for c in s), " AND ".join(f"t.{c} IS NOT NULL" for c in t)
    on = " AND ".join(f"t.{b} = s.{a}" for a, b in zip(s, t, strict=True))
    return (
        f"SELECT '{name}' AS relationship, CAST(a AS BIGINT) AS source_rows, CAST(a - c AS BIGINT) AS source_rows_with_null_key, CAST(c AS BIGINT) AS source_rows_with_complete_key, CAST(o AS BIGINT) AS orphan_rows, CAST(ta AS BIGINT) AS target_rows, CAST(ta - tc AS BIGINT) AS target_rows_with_null_key,"
        " CAST(td AS BIGINT) AS target_distinct_keys, CAST(tg AS BIGINT) AS target_duplicate_key_groups, round(o / nullif(c, 0), 9) AS orphan_ratio, CASE WHEN td > 0 THEN tg = 0 END AS target_key_unique, CASE WHEN c = 0 THEN 'not_validated' WHEN o > 0 THEN 'violated' ELSE 'validated' END AS status FROM"
        f" (SELECT count(*) AS a, count(*) FILTER (WHERE {ok_s}) AS c FROM {source} s), (SELECT count(*) AS o FROM {source} s WHERE {ok_s} AND NOT EXISTS (SELECT 1 FROM {target} t WHERE {on})),"
        f" (SELECT count(*) AS ta, count(*) FILTER (WHERE {ok_t}) AS tc FROM {target} t), (SELECT count(*) AS td, count(*) FILTER (WHERE n > 1) AS tg FROM (SELECT count(*) AS n FROM {target} t WHERE {ok_t} GROUP BY {', '.join(f't.{c}' for c in t)}))"
    )


def _ref(name: str, source: DataFrame, s: Sequence[str], target: DataFrame, t: Sequence[str]) -> DataFrame:
    counts = referential.inclusion(source, [F.col(c) for c in s], target, [F.col(c) for c in t])
    return referential.judged(counts).select(F.lit(name).alias("relationship"), *_REF_COLUMNS, F.round("orphan_ratio", 9).alias("orphan_ratio"), "target_key_unique", "status")


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]
_BAD = [("documents", "doc_id", "labels", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]


def _refs(spark: SparkSession, sf_dir: str, some: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    return union([_ref(f"{a}.{b}", table(spark, sf_dir, a), [b], table(spark, sf_dir, c), [d]) for a, b, c, d in some])


def _refs_sql(some: Sequence[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(_ref_sql(f"{a}.{b}", a, [b], c, [d]) for a, b, c, d in some)


@query(_refs_sql(_FKS))
def ref_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, _FKS)


@query(_refs_sql(_BAD))
def ref_violated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir, _BAD)


_PARTS = "SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey END AS a, CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS b FROM {}"
_TARGETS = "SELECT CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_orderkey END AS a, CAST(l_linenumber AS BIGINT) AS b FROM {} WHERE l_orderkey % 7 <> 0"


@query(_ref_sql("composite", f"({_PARTS.format('lineitem')})", ["a", "b"], f"({_TARGETS.format('lineitem')})", ["a", "b"]))
def ref_null_and_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return _ref("composite", spark.sql(_PARTS.format("{l}"), l=li), ["a", "b"], spark.sql(_TARGETS.format("{l}"), l=li), ["a", "b"])


@query(_ref_sql("customer.c_custkey", "customer", ["c_custkey"], "orders", ["o_custkey"]))
def ref_non_unique_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ref("customer.c_custkey", table(spark, sf_dir, "customer"), ["c_custkey"], table(spark, sf_dir, "orders"), ["o_custkey"])


_TYPE_PAIRS = [("int", "bigint", True), ("int", "decimal(10,2)", True), ("int", "string", False), ("float", "double", True), ("double", "decimal(5,1)", False), ("timestamp", "timestamp_ntz", False), ("date", "timestamp", False), ("string", "string", True), ("array<int>", "array<int>", False), ("binary", "binary", True)]


@query(_values_sql(_TYPE_PAIRS, "source_type, target_type, compatible"))
def ref_type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, referential.compatible(T._parse_datatype_string(a), T._parse_datatype_string(b))[0]) for a, b, _ in _TYPE_PAIRS]
    return _local(spark, rows, "source_type string, target_type string, compatible boolean")


_PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"), ("conversations", "conv_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]


@query("\nUNION ALL ".join(
    f"SELECT '{a}.{b}' AS from_field, '{c}.{d}' AS to_field, CASE WHEN s0 > t1 OR s1 < t0 THEN 'disjoint' WHEN t0 <= s0 AND s1 <= t1 THEN 'contained' ELSE 'overlapping' END AS range_relation, CAST(i AS BIGINT) AS included_rows, round(i / n, 9) AS inclusion_ratio, CASE WHEN td < tn THEN 'target_not_unique' WHEN i / n < 0.95 THEN 'below_threshold' END AS rejected"
    f" FROM (SELECT min({b}) AS s0, max({b}) AS s1, count(*) AS n FROM {a}), (SELECT min({d}) AS t0, max({d}) AS t1, count(*) AS tn, count(DISTINCT {d}) AS td FROM {c}), (SELECT count(*) AS i FROM {a} WHERE {b} IN (SELECT {d} FROM {c}))"
    for a, b, c, d in _PAIRS))
def hyp_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range relation from metrics, inclusion from data, and why a pair is rejected."""
    frames = {t: table(spark, sf_dir, t) for t in {x for p in _PAIRS for x in (p[0], p[2])}}
    fields = {t: {f for a, b, c, d in _PAIRS for s, f in ((a, b), (c, d)) if s == t} for t in frames}
    metrics = union([long(df, ("min", "max", "null_count"), t, fields[t]) for t, df in frames.items()])
    targets = _local(spark, sorted({(c, d) for _, _, c, d in _PAIRS}), "table string, path string")
    relation = referential.pairs(metrics, targets).select(F.concat_ws(".", "from_table", "from_path").alias("from_field"), F.concat_ws(".", "to_table", "to_path").alias("to_field"), "range_relation")
    found = []
    for a, b, c, d in _PAIRS:
        row = referential.judged(referential.inclusion(frames[a], [F.col(b)], frames[c], [F.col(d)]))
        found.append(referential.rejection(row, 0.95).select(F.lit(f"{a}.{b}").alias("from_field"), F.lit(f"{c}.{d}").alias("to_field"), "included_rows", F.round("inclusion_ratio", 9).alias("inclusion_ratio"), "rejected"))
    return relation.join(union(found), ["from_field", "to_field"])


# semantics

_FORMAT_SQL = {
    "url": "url", "name": "'Customer#' || CAST(page_id AS VARCHAR)", "number_text": "CAST(page_id * 3 - 50 AS VARCHAR)", "flag": "CASE WHEN page_id % 2 = 0 THEN 'Yes' ELSE 'n' END", "day": "'20' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')",
    "bad_day": "'2023-02-' || lpad(CAST(page_id % 40 + 1 AS VARCHAR), 2, '0')", "mail": "'user' || CAST(page_id AS VARCHAR) || '@example.com'", "uuid": "'00000000-0000-4000-8000-' || lpad(CAST(page_id AS VARCHAR), 12, '0')", "stamp": "'2024-01-02T03:04:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || CASE WHEN page_id % 2 = 0 THEN 'Z' ELSE '' END",
    "blank_or_one": "CASE WHEN page_id % 2 = 0 THEN '  ' ELSE '1' END", "mixed": "CASE WHEN page_id % 3 = 0 THEN '12' ELSE 'twelve' END",
}
_MATCH_SQL = {
    "uuid": "regexp_matches(v, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')", "numeric_string": r"regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')", "boolean_string": "lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '0', '1')",
    "iso_date": r"regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND try_cast(v AS DATE) IS NOT NULL", "iso_timestamp": r"regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?([.,]\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)?$') AND try_cast(v AS TIMESTAMP) IS NOT NULL",
    "url": r"regexp_matches(v, '^(https?|ftp)://[^\s/?#]+[^\s]*$', 'i')", "email_candidate": r"length(v) <= 254 AND regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$')",
}
_Z = 1.959963984540054


def _format_sql() -> str:
    unpivot = "\nUNION ALL ".join(f"SELECT '{f}' AS field, {e} AS v FROM pages" for f, e in _FORMAT_SQL.items())
    hits = "\nUNION ALL ".join(f"SELECT field, '{m}' AS format, count(*) FILTER (WHERE {e}) AS k, count(*) AS n FROM e GROUP BY field" for m, e in _MATCH_SQL.items())
    half = f"{_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)"
    mid = f"(p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n)"
    return (
        f"WITH d AS ({unpivot}), e AS (SELECT * FROM d WHERE trim(v) <> ''), h AS (SELECT *, k / n AS p FROM ({hits})), s AS (SELECT field, max(n) AS n, count(*) FILTER (WHERE p >= 0.95) AS strong, max(p) AS best, max(format) FILTER (WHERE p >= 0.95) AS sole FROM h GROUP BY field)"
        f" SELECT h.field, h.format AS candidate, CAST(h.k AS BIGINT) AS matches, CAST(h.n AS BIGINT) AS eligible, round(greatest(0, {mid.replace('n)', 'h.n)').replace('n *', 'h.n *').replace(' n', ' h.n')} - {half.replace(' / n', ' / h.n').replace('4 * n * n', '4 * h.n * h.n')}), 9) AS low,"
        f" round(least(1, {mid.replace('n)', 'h.n)').replace('n *', 'h.n *').replace(' n', ' h.n')} + {half.replace(' / n', ' / h.n').replace('4 * n * n', '4 * h.n * h.n')}), 9) AS high,"
        " CASE WHEN s.n < 30 THEN 'insufficient_data' WHEN strong > 1 THEN 'ambiguous' WHEN strong = 1 THEN 'detected' WHEN best >= 0.2 THEN 'mixed' ELSE 'unknown' END AS status, CASE WHEN s.n >= 30 AND strong = 1 THEN sole END AS format FROM h JOIN s ON h.field = s.field WHERE h.k > 0"
    )


@query(_format_sql())
def sem_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors over all values of eleven columns, with Wilson bounds and the decision."""
    d = table(spark, sf_dir, "pages").selectExpr(*[f"{e.replace('AS VARCHAR', 'AS STRING')} AS {f}" for f, e in _FORMAT_SQL.items()])
    out = semantics.formats(semantics.counts(semantics.all_values(d, nodes_of(d)[1])), CONFIG["semantic"])
    flat = out.select(F.col("path").alias("field"), "eligible", "status", "format", F.explode("candidates").alias("c"))
    return flat.select("field", F.col("c.format").alias("candidate"), F.col("c.matches").alias("matches"), "eligible", F.round("c.low", 9).alias("low"), F.round("c.high", 9).alias("high"), "status", "format")


_CONCENTRATED = {"part": ("p_name", "p_brand"), "orders": ("o_orderpriority", "o_orderstatus")}


@query("\nUNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(sum(n) AS BIGINT) AS observations, CAST(count(*) AS BIGINT) AS distinct_count, round(max(n) / sum(n), 9) AS top_1_share, round(sum(n) FILTER (WHERE r <= 5) / sum(n), 9) AS top_5_share FROM (SELECT {f}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {f}) AS r FROM {t} GROUP BY {f})"
    for t, fs in _CONCENTRATED.items() for f in fs))
def sem_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for t, fs in _CONCENTRATED.items():
        d = table(spark, sf_dir, t)
        c = semantics.concentration(semantics.all_values(d, nodes_of(d, fs)[1]))
        out.append(c.select(F.col("path").alias("field"), "observations", "distinct_count", F.round("top_1_share", 9).alias("top_1_share"), F.round("top_5_share", 9).alias("top_5_share")))
    return union(out)


@query("SELECT v AS value, CAST(count(*) AS BIGINT) AS sample_count, length(v) > 6 AS truncated FROM (SELECT substr(o_orderpriority, 1, 6) AS w, o_orderpriority AS v FROM orders) GROUP BY v ORDER BY count(*) DESC, v LIMIT 5".replace("SELECT v AS value", "SELECT substr(v, 1, 6) AS value"))
def sem_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders")
    out = semantics.examples(semantics.all_values(d, nodes_of(d, ["o_orderpriority"])[1]), CONFIG["value_policy"] | {"max_example_chars": 6})
    return out.select("value", "sample_count", "truncated")


_ROLE_TABLES = ("customer", "orders", "part", "supplier", "events", "labels", "nation")
_STRINGS_AND_INTEGERS = {"customer": "c_custkey c_name c_nationkey c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size", "supplier": "s_suppkey s_name s_nationkey", "events": "event_id user_id event_type props", "labels": "doc_id quality toxic", "nation": "n_nationkey n_name n_regionkey"}


def _with_exact_distinct(spark: SparkSession, sf_dir: str, t: str, fields: Sequence[str]) -> DataFrame:
    """Long metrics in which the distinct count is exact, so that another engine can follow."""
    d = table(spark, sf_dir, t)
    base = long(d, ("null_count", "min", "max", "all_values_equal", "quantiles"), t, fields, PRECISE)
    exact = _keys(d, {f: [f] for f in fields}).select("key", "distinct_keys")
    like = base.where("metric = 'null_count'").join(exact, F.col("path") == F.col("key")).withColumn("metric", F.lit("approx_distinct_count")).withColumn("number", F.col("distinct_keys").cast("double")).withColumn("value", F.col("distinct_keys").cast("string"))
    return base.unionByName(like.select(*base.columns))


def _role_sql(t: str, f: str) -> str:
    base = f"(SELECT count({f}) AS n, count(DISTINCT {f}) AS d, (count(*) - count({f})) / count(*) AS r FROM {t})"
    return f"SELECT '{t}.{f}' AS field, 'identifier_candidate' AS role FROM {base} WHERE n >= 30 AND d / n >= 0.95 AND r <= 0.01 UNION ALL SELECT '{t}.{f}', 'categorical_candidate' FROM {base} WHERE n >= 100 AND d BETWEEN 2 AND 20"


@query("\nUNION ALL ".join(_role_sql(t, f) for t, fs in _STRINGS_AND_INTEGERS.items() for f in fs.split()))
def sem_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = union([_with_exact_distinct(spark, sf_dir, t, _STRINGS_AND_INTEGERS[t].split()) for t in _ROLE_TABLES])
    return judge.roles(judge.facts(metrics), CONFIG["thresholds"]).select(F.concat_ws(".", "table", "path").alias("field"), "role")


# JSON

_NESTED_JSON = "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '[1, 2]' WHEN event_id % 50 = 2 THEN 'null' WHEN event_id % 50 = 3 THEN 'broken{' WHEN event_id % 50 = 4 THEN '17' WHEN event_id % 2 = 0 THEN '{\"id\": ' || CAST(event_id AS VARCHAR) || ', \"tag\": \"x\", \"in\": {\"deep\": null, \"n\": 1.5}}' ELSE '{\"id\": \"' || CAST(event_id AS VARCHAR) || '\", \"list\": [{\"q\": 1}, {\"q\": true}]}' END"
_ROOTS = {"object": "json_type(j) = 'OBJECT'", "array": "json_type(j) = 'ARRAY'", "scalar": "json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL')", "json_null_literal": "json_type(j) = 'NULL'"}


def _json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").selectExpr(f"{_NESTED_JSON.replace('AS VARCHAR', 'AS STRING')} AS j", "props")
    return json_docs.documents(semantics.all_values(d, nodes_of(d)[1]))


_JSON_D = f"WITH d AS (SELECT 'j' AS field, {_NESTED_JSON} AS j FROM events UNION ALL SELECT 'props', props FROM events), v AS (SELECT field, CASE WHEN json_valid(j) THEN j END AS j FROM d WHERE j IS NOT NULL)"


@query(f"{_JSON_D}, k AS (SELECT field, array_to_string(list_sort(json_keys(j)), ',') AS ks FROM v WHERE json_type(j) = 'OBJECT') SELECT v.field, CAST(count(*) AS BIGINT) AS eligible, " + ", ".join(f"CAST(count(*) FILTER (WHERE {e}) AS BIGINT) AS {'n_' + n}" for n, e in _ROOTS.items()) + ", CAST(count(*) FILTER (WHERE j IS NULL) AS BIGINT) AS n_invalid, CAST(max(s.sets) AS BIGINT) AS key_sets, CAST(CASE WHEN v.field = 'j' THEN 1 ELSE 0 END AS BIGINT) AS conflicting, CAST(CASE WHEN v.field = 'j' THEN 4 ELSE 1 END AS BIGINT) AS n_keys FROM v JOIN (SELECT field, count(DISTINCT ks) AS sets FROM k GROUP BY field) s ON s.field = v.field GROUP BY v.field")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = json_docs.shape(_json_docs(spark, sf_dir))
    return s.select(F.col("path").alias("field"), "eligible", *[F.col(c).alias(f"n_{c}") for c in (*_ROOTS, "invalid")], F.col("distinct_object_key_sets").alias("key_sets"), F.col("keys_with_conflicting_types").alias("conflicting"), "n_keys")


_PATHS = {
    "$.id": (1, "json_exists(j, '$.id')", 1), "$.tag": (1, "json_exists(j, '$.tag')", 1), "$.in": (1, "json_exists(j, '$.in')", 1), "$.list": (1, "json_exists(j, '$.list')", 1), "$[*]": (1, "json_type(j) = 'ARRAY'", 2),
    "$.in.deep": (2, "json_exists(j, '$.in.deep')", 1), "$.in.n": (2, "json_exists(j, '$.in.n')", 1), "$.list[*]": (2, "json_exists(j, '$.list')", 2), "$.list[*].q": (3, "json_exists(j, '$.list')", 2), "$.k": (1, "json_exists(j, '$.k')", 1),
}


@query(f"{_JSON_D}, o AS (SELECT field, j FROM v WHERE json_type(j) IN ('OBJECT', 'ARRAY')), t AS (SELECT field, count(*) AS n FROM o GROUP BY field) " + "\nUNION ALL ".join(f"SELECT o.field, '{p}' AS json_path, CAST({d} AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS present_in, CAST({m} * count(*) AS BIGINT) AS occurrences, round(count(*) / max(t.n), 9) AS presence_ratio FROM o JOIN t ON o.field = t.field WHERE {e} GROUP BY o.field HAVING count(*) > 0" for p, (d, e, m) in _PATHS.items()))
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = json_docs.catalogue(_json_docs(spark, sf_dir))
    return c.select(F.col("path").alias("field"), "json_path", F.col("depth").cast("long").alias("depth"), "present_in", "occurrences", F.round("presence_ratio", 9).alias("presence_ratio"))


_CHECKED = [("$.id", "number"), ("$.in.deep", None), ("$.in.n", "number"), ("$.list", "array")]


@query(
    f"WITH d AS (SELECT {_NESTED_JSON} AS j FROM events), v AS (SELECT j FROM d WHERE json_valid(j)) SELECT '$' AS json_path, 'json_documents' AS metric, CAST(count(*) FILTER (WHERE json_type(j) IN ('OBJECT', 'ARRAY')) AS BIGINT) AS n FROM v UNION ALL "
    + "\nUNION ALL ".join(f"SELECT '{p}', 'path_present_count', count(*) FILTER (WHERE json_exists(j, '{p}')) FROM v UNION ALL SELECT '{p}', 'path_json_null_count', count(*) FILTER (WHERE json_type(j, '{p}') = 'NULL') FROM v" for p, _ in _CHECKED)
    + " UNION ALL SELECT '$.id', 'path_type_match_count', count(*) FILTER (WHERE json_type(j, '$.id') IN ('BIGINT', 'UBIGINT', 'DOUBLE')) FROM v UNION ALL SELECT '$.in.n', 'path_type_match_count', count(*) FILTER (WHERE json_type(j, '$.in.n') IN ('BIGINT', 'UBIGINT', 'DOUBLE')) FROM v UNION ALL SELECT '$.list', 'path_type_match_count', count(*) FILTER (WHERE json_type(j, '$.list') = 'ARRAY') FROM v"
)
def json_path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").selectExpr(f"{_NESTED_JSON.replace('AS VARCHAR', 'AS STRING')} AS j")
    node = nodes_of(d)[1][0]
    specs = json_docs.path_checks(node, [{"json_path": p, "dominant_type": t} for p, t in _CHECKED])
    cells = [F.struct(F.lit(s.detail.get("json_path", "$")).alias("json_path"), F.lit(s.metric.name).alias("metric"), F.expr(s.sql).alias("n")) for s in specs]
    return d.agg(F.array(*cells).alias("all")).select(F.inline("all"))


@query(
    f"WITH d AS (SELECT {_NESTED_JSON} AS j FROM events), v AS (SELECT j FROM d WHERE json_valid(j)) SELECT '$' AS json_path, 'json_documents' AS metric, CAST(count(*) FILTER (WHERE json_type(j) IN ('OBJECT', 'ARRAY')) AS BIGINT) AS n FROM v UNION ALL "
    + "\nUNION ALL ".join(f"SELECT '{p}', 'path_non_null_count', count(*) FILTER (WHERE json_type(j, '{p}') <> 'NULL') FROM v" for p, _ in _CHECKED)
)
def json_path_checks_without_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback for runtimes that have get_json_object alone."""
    d = table(spark, sf_dir, "events").selectExpr(f"{_NESTED_JSON.replace('AS VARCHAR', 'AS STRING')} AS j")
    specs = json_docs.path_checks(nodes_of(d)[1][0], [{"json_path": p, "dominant_type": t} for p, t in _CHECKED], "get_json_object")
    cells = [F.struct(F.lit(s.detail.get("json_path", "$")).alias("json_path"), F.lit(s.metric.name).alias("metric"), F.expr(s.sql).alias("n")) for s in specs]
    return d.agg(F.array(*cells).alias("all")).select(F.inline("all"))


# judgements

_JUDGED = {"lineitem": "l_orderkey l_linenumber l_quantity l_returnflag l_linestatus", "part": "p_partkey p_name p_size", "events": "event_id user_id event_type"}


_ODD = {"c_custkey": "c_custkey", "none": "CASE WHEN c_custkey < 0 THEN 1 END", "sparse": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey END", "seven": "7", "tail": "CASE WHEN c_custkey = 1 THEN 1000000 ELSE c_custkey % 10 END", "big": "sequence(1, CASE WHEN c_custkey = 1 THEN 1500 ELSE 1 END)"}


def _judged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [_with_exact_distinct(spark, sf_dir, t, f.split()) for t, f in _JUDGED.items()]
    odd = table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {f}" for f, e in _ODD.items()])
    odd_metrics = long(odd, ("null_count", "all_values_equal", "min", "max", "quantiles", "max_size"), "odd", config=PRECISE)
    return union([*frames, odd_metrics])


def _finding_sql() -> str:
    out = []
    for t, fs in _JUDGED.items():
        for f in fs.split():
            base = f"(SELECT count({f}) AS n, count(DISTINCT {f}) AS d FROM {t})"
            if f != "l_quantity":
                out += [f"SELECT '{t}.{f}' AS field, 'possible_categorical' AS code, 'info' AS severity FROM {base} WHERE n >= 100 AND d BETWEEN 2 AND 20", f"SELECT '{t}.{f}', 'identifier_candidate', 'info' FROM {base} WHERE n >= 30 AND d / n >= 0.95"]
            out.append(f"SELECT '{t}.{f}', 'possible_constant', 'info' FROM {base} WHERE n >= 2 AND d = 1")
            if f not in ("l_returnflag", "l_linestatus", "p_name", "event_type"):
                out.append(f"SELECT '{t}.{f}', 'extreme_numeric_tail', 'info' FROM (SELECT min({f}) AS a, max({f}) AS b, quantile_disc({f}, 0.25) AS q1, quantile_disc({f}, 0.75) AS q3 FROM {t}) WHERE q3 > q1 AND greatest((b - q3) / (q3 - q1), (q1 - a) / (q3 - q1)) > 10")
    limit = CONFIG["thresholds"]
    for f in _ODD:
        base = f"(SELECT count(*) AS r, count({f}) AS n, count(DISTINCT {f}) AS d FROM odd)"
        out += [f"SELECT 'odd.{f}', 'all_null', 'warning' FROM {base} WHERE r > 0 AND n = 0", f"SELECT 'odd.{f}', 'high_null_ratio', 'info' FROM {base} WHERE n > 0 AND (r - n) / r >= {limit['high_null_ratio']}"]
        if f == "big":
            out.append(f"SELECT 'odd.big', 'large_arrays', 'warning' FROM odd HAVING max(len(big)) >= {limit['large_array_size']}")
        else:
            out.append(f"SELECT 'odd.{f}', 'possible_constant', 'info' FROM {base} WHERE n >= {limit['constant_min_rows']} AND d = 1")
            out.append(f"SELECT 'odd.{f}', 'extreme_numeric_tail', 'info' FROM (SELECT min({f}) AS a, max({f}) AS b, quantile_disc({f}, 0.25) AS q1, quantile_disc({f}, 0.75) AS q3 FROM odd) WHERE q3 > q1 AND greatest((b - q3) / (q3 - q1), (q1 - a) / (q3 - q1)) > {limit['tail_iqr_multiplier']}")
    for f, e in {"j": _NESTED_JSON, "props": "props"}.items():
        out.append(f"SELECT 'texts.{f}', 'probable_json', 'info' FROM (SELECT {e} AS j FROM events) HAVING count(*) FILTER (WHERE json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) IN ('OBJECT', 'ARRAY')) / count(*) FILTER (WHERE trim(j) <> '') >= {limit['json_min_ratio']}")
    odd = ", ".join(f"{e} AS {f}" for f, e in _ODD.items()).replace("sequence(", "generate_series(")
    return f"WITH odd AS (SELECT {odd} FROM customer) " + "\nUNION ALL ".join(out)


@query(_finding_sql())
def judge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").selectExpr(f"{_NESTED_JSON.replace('AS VARCHAR', 'AS STRING')} AS j", "props")
    facts = judge.facts(_judged_metrics(spark, sf_dir).unionByName(long(texts, ("null_count",), "texts")))
    shapes = json_docs.shape(_json_docs(spark, sf_dir)).withColumn("table", F.lit("texts"))
    found = judge.findings(facts, judge.roles(facts, CONFIG["thresholds"]), CONFIG["thresholds"], shapes)
    return found.select(F.concat_ws(".", "table", "path").alias("field"), "code", "severity")


_ASKED: list[tuple[str, str, str | None, float | None, float | None, str]] = [
    ("rows_min", "min_row_count", None, 1, None, "CASE WHEN count(*) >= 1 THEN 'pass' ELSE 'fail' END"), ("rows_max", "max_row_count", None, None, 5, "CASE WHEN count(*) <= 5 THEN 'pass' ELSE 'fail' END"),
    ("nulls", "max_null_ratio", "cust", None, 0.05, "CASE WHEN avg(CASE WHEN cust IS NULL THEN 1.0 ELSE 0 END) <= 0.05 THEN 'pass' ELSE 'fail' END"), ("null_n", "max_null_count", "o_orderkey", None, 0, "CASE WHEN count(*) - count(o_orderkey) <= 0 THEN 'pass' ELSE 'fail' END"),
    ("empty", "max_empty_string_ratio", "o_orderstatus", None, 0.0, "CASE WHEN count(*) FILTER (WHERE o_orderstatus = '') = 0 THEN 'pass' ELSE 'fail' END"), ("empty_kind", "max_empty_string_ratio", "cust", None, 0.5, "any_value('error')"),
    ("range_ok", "value_range", "o_totalprice", -1.0, 1e9, "CASE WHEN min(o_totalprice) >= -1 AND max(o_totalprice) <= 1e9 THEN 'pass' ELSE 'fail' END"), ("range_bad", "value_range", "o_totalprice", None, 1000.0, "CASE WHEN max(o_totalprice) <= 1000 THEN 'pass' ELSE 'fail' END"),
    ("range_kind", "value_range", "o_orderstatus", 0.0, None, "any_value('error')"), ("absent", "max_null_count", "nowhere", None, 0, "any_value('error')"), ("range_none", "value_range", "none", 0.0, None, "any_value('not_evaluated')"),
]
_CHECK_D = "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS cust, CASE WHEN o_orderkey < 0 THEN 1 END AS none FROM {}"


@query(f"WITH d AS ({_CHECK_D.format('orders')}) " + "\nUNION ALL ".join(f"SELECT '{a}' AS check_id, '{b}' AS type, {e} AS status FROM d" for a, b, _, _, _, e in _ASKED))
def judge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_CHECK_D.format("{o}"), o=table(spark, sf_dir, "orders"))
    kinds = {n.display: n.kind for n in nodes_of(d)[1]}
    asked = [{"table": "t", "check_id": a, "type": b, "path": c, "low": None if lo is None else float(lo), "high": None if hi is None else float(hi), "known": c is None or c in kinds, "profiled": c is None or c in kinds, "kind": kinds.get(c or "")} for a, b, c, lo, hi, _ in _ASKED]
    facts = judge.facts(long(d, ("null_count", "min", "max", "empty_count")))
    return judge.checks(facts, asked).select("check_id", "type", "status")


def _rule_sql() -> str:
    out = []
    for t, fs in _JUDGED.items():
        for f in fs.split():
            base = f"(SELECT count({f}) AS n, count(*) AS r, count(DISTINCT {f}) AS d FROM {t})"
            out.append(f"SELECT '{t}.{f}' AS field, 'not_null' AS rule_type FROM {base} WHERE n = r AND n >= 30")
            if f != "l_quantity":
                out += [f"SELECT '{t}.{f}', 'accepted_values' FROM {base} WHERE n >= 100 AND d BETWEEN 2 AND 20", f"SELECT '{t}.{f}', 'unique' FROM {base} WHERE n >= 30 AND d / n >= 0.95 AND d = n"]
    return "\nUNION ALL ".join(out)


@query(_rule_sql())
def judge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals; an exact check of identifier candidates decides ``unique``."""
    metrics = union([_with_exact_distinct(spark, sf_dir, t, f.split()) for t, f in _JUDGED.items()])
    facts = judge.facts(metrics)
    role = judge.roles(facts, CONFIG["thresholds"])
    checked = [_keys(table(spark, sf_dir, t), {f: [f] for f in fs.split()}).select(F.lit(t).alias("table"), F.array("key").alias("columns"), "outcome") for t, fs in _JUDGED.items()]
    asked = union(checked).join(role.where("role = 'identifier_candidate'").select("table", F.array("path").alias("columns")), ["table", "columns"], "left_semi")
    out = judge.rules(facts, role, CONFIG["thresholds"], keys=asked)
    return out.select(F.concat_ws(".", "table", "path").alias("field"), "rule_type")


# sources, runs and streams

_CONSTRAINTS = "VALUES ('c', 's', 'pk_orders', 'PRIMARY KEY', 's', 'orders'), ('c', 's', 'fk_customer', 'FOREIGN KEY', 'S', 'Orders'), ('c', 's', 'uq_other', 'UNIQUE', 's', 'customer')"
_USAGE = "VALUES ('c', 's', 'pk_orders', 'o_orderkey', 1, CAST(NULL AS INT)), ('c', 's', 'fk_customer', 'o_custkey', 1, 1), ('c', 's', 'uq_other', 'c_name', 1, CAST(NULL AS INT))"
_REFERENCES = "VALUES ('c', 's', 'fk_customer', 'c', 's', 'pk_customer')"
_KEYS3 = "constraint_catalog, constraint_schema, constraint_name"
_NAMED = {"constraints": (_CONSTRAINTS, f"{_KEYS3}, constraint_type, table_schema, table_name"), "usage": (_USAGE, f"{_KEYS3}, column_name, ordinal_position, position_in_unique_constraint"), "refs": (_REFERENCES, f"{_KEYS3}, unique_constraint_catalog, unique_constraint_schema, unique_constraint_name")}


def _view(name: str) -> str:
    rows, columns = _NAMED[name]
    return f"SELECT * FROM ({rows}) AS v({columns})"


@query(
    f"WITH t AS ({_view('constraints')}), u AS ({_view('usage')}), r AS ({_view('refs')}) SELECT t.constraint_name, t.constraint_type, u.column_name, CAST(u.ordinal_position AS BIGINT) AS ordinal_position, r.unique_constraint_name FROM t JOIN u ON t.constraint_name = u.constraint_name"
    " LEFT JOIN r ON r.constraint_name = t.constraint_name WHERE lower(t.table_schema) = 's' AND lower(t.table_name) = 'orders'"
)
def src_key_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table's declared keys from three information_schema views."""
    out = constraints.key_rows(*[spark.sql(_view(n)) for n in ("constraints", "usage", "refs")], "s", "orders")
    return out.select("constraint_name", "constraint_type", "column_name", F.col("ordinal_position").cast("long").alias("ordinal_position"), "unique_constraint_name")


_RUN = {"orders": "o_totalprice > 100000", "customer": "true", "events": "true"}


@query("\nUNION ALL ".join(f"SELECT '{t}' AS table_name, 'succeeded' AS status, CAST(count(*) AS BIGINT) AS row_count, CAST({len(_COLUMNS[t].split())} AS BIGINT) AS fields_profiled, '{'filtered_table' if w != 'true' else 'full_table'}' AS scope FROM {t} WHERE {w}" for t, w in _RUN.items()))
def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole standard run, from configuration to a valid document; its tables as rows."""
    config = validated({"kind": "profilekit.config", "config_version": "1.0", "tables": list(_RUN), "table_options": {"orders": {"filters": [{"column": "o_totalprice", "operator": "gt", "value": 100000}]}}})
    doc = runner.profile(spark, config, lambda name: at_path(spark, f"{sf_dir}/{name}.parquet"), reference=REFERENCE)
    if errors := profile_errors(doc):
        raise ValueError(errors)
    count = lambda t: next(m["value"] for m in t["table_metrics"] if m["name"] == "row_count")
    return _local(spark, [(t["table_key"], t["status"], count(t), t["summary"]["fields_profiled"], t["scope"]["scope_label"]) for t in doc["tables"]], "table_name string, status string, row_count long, fields_profiled long, scope string")


_STREAMED = {"null_count": "count(*) FILTER (WHERE {} IS NULL)", "min": "min({})", "max": "max({})", "mean": "round(avg({}), 6)", "negative_count": "count(*) FILTER (WHERE {} < 0)"}


@query("WITH d AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, value, user_id FROM events) " + "\nUNION ALL ".join(f"SELECT window_start, '{f}' AS field, '{m}' AS metric, CAST({e.format(f)} AS DOUBLE) AS value FROM d GROUP BY window_start" for f in ("value", "user_id") for m, e in _STREAMED.items()) + " UNION ALL SELECT window_start, '', 'row_count', CAST(count(*) AS DOUBLE) FROM d GROUP BY window_start")
def stream_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on a batch: metrics by event-time window."""
    out = stream.windowed_metrics(table(spark, sf_dir, "events"), "ts", "1 hour", columns=("value", "user_id"), metrics=tuple(_STREAMED))
    number = F.when(F.col("metric") == "mean", F.round("number", 6)).otherwise(F.col("number"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.col("path").alias("field"), "metric", number.alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard-level long metrics of lineitem."""
    df = table(spark, sf_dir, "lineitem")
    return aggregate.measure(df, plan_measures(nodes_of(df)[1], CONFIG, REFERENCE), "lineitem")


@query()
def std_full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
