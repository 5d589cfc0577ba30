"""Runs over small tables with planted facts: nulls at every level, special floats, broken JSON, duplicates, orphans, an
empty table, a table that is not there, and secrets that must not leave."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from profilekit import cli, package, runner
from profilekit import config as C
from profilekit.contract.document import value_of
from profilekit.contract.invariants import annotation_errors, invariant_errors, profile_errors
from profilekit.contract.render import documents
from profilekit.contract.shapecheck import shape_errors
from profilekit.contract.shapes import SHAPES
from profilekit.operators import json_docs, semantics
from profilekit.plans.measure import plan_measures
from profilekit.plans.tree import schema_tree, select
from profilekit.sources import constraints as K
from profilekit.sources.tables import Source, at_path, describe_extended, environment, open_table
from profilekit.streaming import profile as stream_profile

REFERENCE = dt.datetime(2025, 2, 1, tzinfo=dt.UTC)
CUSTOMERS = """SELECT id AS customer_id, if(id % 10 = 0, NULL, concat('user', id, '@example.com')) AS email, element_at(array('a', 'b', 'c'), int(id % 3) + 1) AS segment, date'2024-12-01' + int(id) AS signup, id % 2 = 0 AS active, 'EUR' AS currency,
 CAST(id * 1.25 AS decimal(12,2)) AS worth, CASE WHEN id % 97 = 0 THEN double('NaN') WHEN id % 89 = 0 THEN double('Infinity') WHEN id % 7 = 0 THEN NULL ELSE double(id) END AS score, CAST(NULL AS string) AS middle, concat('n', id) AS `display name`, if(id % 10 = 0, int(id / 10 + 1), NULL) AS referrer FROM range(1, 501)"""
ORDERS = """SELECT concat('00000000-0000-4000-8000-', lpad(id, 12, '0')) AS order_id, int(if(id >= 995, 501 + id % 5, id % 500 + 1)) AS customer_id, timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id)) AS at, if(id = 7, 95000.00, CAST(id % 100 AS decimal(12,2))) AS amount,
 if(id % 20 = 0, NULL, named_struct('address', if(id % 10 = 0, NULL, named_struct('city', if(id % 5 = 0, NULL, 'x'), 'zip', '1')), 'method', 'm')) AS shipping, if(id = 3, transform(sequence(1, 1500), x -> named_struct('sku', 's', 'qty', x)), transform(sequence(1, int(id % 3) + 1), x -> named_struct('sku', concat('s', x), 'qty', if(x = 2, NULL, x)))) AS items,
 if(id % 4 = 0, NULL, map('k', if(id % 3 = 0, NULL, 'v'))) AS attributes, if(id % 6 = 0, array(), array('t', NULL)) AS tags FROM range(1000)"""
EVENTS = """SELECT concat('e', if(id >= 1997, id - 1997, id)) AS event_id, concat('00000000-0000-4000-8000-', lpad(id % 1000, 12, '0')) AS order_id, CASE WHEN id % 100 = 0 THEN '{"broken' WHEN id % 100 = 1 THEN 'null' WHEN id % 100 = 2 THEN '[1]' WHEN id % 100 = 3 THEN NULL ELSE concat('{"a": ', id, ', "b": {"c": "SECRETVALUE"}}') END AS payload,
 'Y' AS flag, concat('2025-01-', lpad(id % 28 + 1, 2, '0')) AS day_text, concat('https://example.com/', id) AS url, timestamp_ntz'2025-01-01 00:00:00' AS local_time FROM range(2000)"""
EMPTY = "SELECT CAST(1 AS bigint) AS return_id, 'x' AS reason, date'2025-01-01' AS created, 1.5D AS number WHERE false"
TABLES = {"customers": CUSTOMERS, "orders": ORDERS, "order_events": EVENTS, "returns": EMPTY}
CONFIG = {
    "kind": C.KIND, "config_version": "1.0", "tables": list(TABLES), "analysis_level": "deep", "output_dir": "/nowhere",
    "value_policy": {"persist_examples": True, "example_columns": [{"table": "customers", "column": "segment"}]},
    "deep": {"uniqueness": {"keys": [{"table": "order_events", "columns": ["event_id"]}, {"table": "customers", "columns": ["referrer"]}, {"table": "returns", "columns": ["return_id"]}, {"table": "orders", "columns": ["order_id"]}, {"table": "customers", "columns": ["customer_id"]}], "identifier_candidates": True}, "referential": {"configured": True}, "relationship_hypotheses": {"enabled": True}},
    "relationships": [
        {"id": "orders_customer", "from": {"table": "orders", "columns": ["customer_id"]}, "to": {"table": "customers", "columns": ["customer_id"]}, "cardinality": {"from": "zero_or_more", "to": "exactly_one"}}, {"id": "events_order", "from": {"table": "order_events", "columns": ["order_id"]}, "to": {"table": "ORDERS", "columns": ["order_id"]}},
        {"id": "types", "from": {"table": "orders", "columns": ["order_id"]}, "to": {"table": "customers", "columns": ["customer_id"]}},
    ],
    "table_options": {
        "customers": {"checks": [{"id": "nulls", "type": "max_null_ratio", "column": "email", "max": 0.2}, {"id": "range", "type": "value_range", "column": "score", "min": 0}, {"id": "empty", "type": "max_empty_string_ratio", "column": "segment", "max": 0}]},
        "orders": {"filters": [{"column": "amount", "operator": "ge", "value": "0", "value_type": "decimal"}], "checks": [{"id": "amount", "type": "value_range", "column": "amount", "max": 10000}, {"id": "rows", "type": "min_row_count", "min": 1}]}, "returns": {"checks": [{"id": "none", "type": "max_null_ratio", "column": "reason", "max": 0.1}]},
    },
}


@pytest.fixture(scope="module")
def opener(spark):
    frames = {name: spark.sql(sql) for name, sql in TABLES.items()}
    return lambda name: Source(name, [name], frames[name], is_path=True)


@pytest.fixture(scope="module")
def deep(spark, opener):
    return runner.profile(spark, C.validated(CONFIG), opener, reference=REFERENCE)


def field(profile, table, path):
    t = next(t for t in profile["tables"] if t["table_key"] == table)
    return next(f for f in t["field_profiles"] if f["display_path"] == path)


def value(profile, table, path, metric):
    return value_of(field(profile, table, path)["metrics"], metric)


def test_document_is_valid(deep):
    assert profile_errors(deep) == [] and deep["run"]["status"] == "succeeded" and json.loads(json.dumps(deep)) == deep


def test_standard_metrics(spark, deep):
    got = lambda p, m: value(deep, "customers", p, m)
    c = spark.sql(CUSTOMERS).toPandas()
    score = c["score"]
    assert got("email", "null_count") == 50 and got("middle", "null_ratio") == 1.0 and got("currency", "all_values_equal") is True
    assert got("score", "nan_count") == 5 and got("score", "positive_infinity_count") == 5 and got("score", "max") == score[score < float("inf")].max()
    assert got("worth", "max") == "625.00" and got("signup", "after_reference_count") == (c["signup"] > dt.date(2025, 2, 1)).sum() and got("active", "true_count") == 250
    assert value(deep, "orders", "shipping.address.city", "null_count_parent_present") == 100 and value(deep, "orders", "shipping.address", "null_ratio_given_parent_present") == pytest.approx(50 / 950)
    assert value(deep, "orders", "items", "max_size") == 1500 and field(deep, "order_events", "local_time")["metrics"][-1]["status"] in ("measured", "not_computed")
    for m in field(deep, "returns", "number")["metrics"]:
        assert m["status"] == "insufficient_data" or m["value"] in (0, False)


def test_member_metrics(spark, deep):
    exploded = spark.sql(f"SELECT explode(items) AS i FROM ({ORDERS})").select("i.*")
    total, nulls, low, kinds = exploded.agg(F.count(F.lit(1)), F.count_if(F.expr("qty IS NULL")), F.min("qty"), F.count_distinct("sku")).first()
    got = lambda p, m: value(deep, "orders", p, m)
    assert got("items[].qty", "element_count") == total and got("items[].qty", "null_count") == nulls and got("items[].qty", "min") == low and got("items[].sku", "distinct_count") == kinds
    assert got("tags[]", "null_count") == 833 and got("attributes{value}", "null_ratio") == pytest.approx(250 / 750)


def test_keys(deep):
    keys = {(t["table_key"], tuple(k["columns"])): k for t in deep["tables"] for k in t["uniqueness"]["keys"]}
    assert {k: v["outcome"] for k, v in keys.items() if v["origins"][0] == "configured"} == {("order_events", ("event_id",)): "duplicates", ("customers", ("referrer",)): "unique_non_null", ("returns", ("return_id",)): "empty", ("orders", ("order_id",)): "unique", ("customers", ("customer_id",)): "unique"}
    k = {m["name"]: m["value"] for m in keys["order_events", ("event_id",)]["metrics"]}
    assert (k["distinct_keys"], k["duplicate_key_groups"], k["rows_in_duplicate_groups"]) == (1997, 3, 6)


def test_references_and_hypotheses(deep):
    rels = {r["name"]: r for r in deep["relationships"]}
    assert rels["orders_customer"]["validation"] == "violated" and value_of(rels["orders_customer"]["validation_detail"]["metrics"], "orphan_rows") == 5
    assert rels["events_order"]["validation"] == "validated" and rels["types"]["validation"] == "not_validated" and "not compared by equality" in rels["types"]["validation_detail"]["reason"]
    found = {(h["from"]["table"], h["from"]["columns"][0], h["to"]["columns"][0]) for h in deep["relationship_hypotheses"]["hypotheses"]}
    assert ("customers", "referrer", "customer_id") in found and not any(h["cardinality"] for h in deep["relationship_hypotheses"]["hypotheses"])


def test_formats_json_and_examples(deep):
    fmt = lambda t, p: field(deep, t, p)["semantics"]["observed_format"]
    assert fmt("customers", "email")["format"] == "email_candidate" and fmt("order_events", "day_text")["format"] == "iso_date" and fmt("order_events", "url")["format"] == "url" and fmt("orders", "order_id")["format"] == "uuid" and fmt("order_events", "flag")["format"] == "boolean_string"
    payload = field(deep, "order_events", "payload")
    assert payload["json_profile"]["counts"] == {"object": 1920, "array": 20, "scalar": 0, "json_null_literal": 20, "invalid": 20} and value(deep, "order_events", "payload", "json_invalid_count") == 20
    paths = {p["path"]: p for p in payload["json_paths"]["paths"]}
    assert set(paths) == {"$.a", "$.b", "$.b.c", "$[*]"} and paths["$.b.c"]["full_scope"]["metrics"][0]["value"] == 1920 and paths["$[*]"]["full_scope"]["status"] == "not_computed"
    assert {e["value"] for e in field(deep, "customers", "segment")["examples"]["values"]} == {"a", "b", "c"}


def test_judgements(deep):
    codes = {(t["table_key"], f["display_path"], f["code"]) for t in deep["tables"] for f in t["findings"]}
    assert {("customers", "middle", "all_null"), ("customers", "currency", "possible_constant"), ("customers", "referrer", "high_null_ratio"), ("customers", "segment", "possible_categorical"), ("customers", "customer_id", "identifier_candidate"), ("orders", "amount", "extreme_numeric_tail"), ("orders", "items", "large_arrays"), ("order_events", "payload", "probable_json")} <= codes
    checks = {c["check_id"]: c["status"] for t in deep["tables"] for c in t["quality_checks"]}
    assert checks == {"nulls": "pass", "range": "pass", "empty": "pass", "amount": "fail", "rows": "pass", "none": "not_evaluated"}
    rules = {(r["table"], r["column"], r["rule_type"]) for t in deep["tables"] for r in t["suggested_rules"]}
    assert ("order_events", "event_id", "unique") not in rules and ("customers", "customer_id", "unique") in rules and ("order_events", "payload", "valid_json") in rules and ("order_events", "url", "matches_format") in rules


def test_nothing_but_counts_leaves(deep):
    text = json.dumps(deep) + "".join(documents(deep).values())
    assert "SECRETVALUE" not in text and "user17@example.com" not in text


def test_documents(deep):
    notes = {"kind": "profilekit.annotations", "annotations_version": "1.0", "tables": {"Customers": {"description": "Who | buys", "owner": "o", "columns": {"`display name`": {"description": "shown"}}}}, "relationships": [{"id": "extra", "from": {"table": "returns", "columns": ["return_id"]}, "to": {"table": "orders", "columns": ["order_id"]}, "cardinality": {"from": "zero_or_one", "to": "exactly_one"}}]}
    assert annotation_errors(notes) == []
    d = documents(deep, notes)
    assert set(d) == {"overview.md", "data_dictionary.md", "quality_report.md", "relationships.md", "erd.mmd", "suggested_rules.json"}
    assert "Who \\| buys _(annotation)_" in d["data_dictionary.md"] and "shown _(annotation)_" in d["data_dictionary.md"] and "**violated**: 5 orphan row(s)" in d["relationships.md"]
    assert 'orders }o..|| customers : "orders_customer"' in d["erd.mmd"] and 'returns |o..|| orders : "extra"' in d["erd.mmd"] and "events_order" not in d["erd.mmd"]
    assert "## 9. Limitations" in d["quality_report.md"] and shape_errors(json.loads(d["suggested_rules.json"]), SHAPES["suggested_rules"]) == []


def test_invariants_notice_changes(deep):
    for change in (
        lambda p: p["summary"].update(tables_total=9), lambda p: p["run"].update(status="failed"), lambda p: p["relationships"][0].update(validation="validated"), lambda p: p["tables"][0]["uniqueness"]["keys"][0].update(outcome="duplicates"),
        lambda p: p["tables"][0]["field_profiles"].append(p["tables"][0]["field_profiles"][0]), lambda p: p["relationship_hypotheses"]["hypotheses"][0].update(cardinality={}), lambda p: p["tables"][1].update(status="failed"),
    ):
        broken = json.loads(json.dumps(deep))
        change(broken)
        assert invariant_errors(broken)


def test_levels_and_failures(spark, opener):
    config = C.validated({**CONFIG, "analysis_level": "standard", "tables": ["customers", "gone", "orders"], "table_options": {"orders": {"columns": ["nope"]}, "customers": {"columns": ["email", "score"], "filters": [{"column": "segment", "operator": "eq", "value": "a"}]}}})
    p = runner.profile(spark, config, opener)
    assert profile_errors(p) == [] and [t["status"] for t in p["tables"]] == ["succeeded", "failed", "failed"] and p["run"]["status"] == "partial"
    assert p["tables"][2]["errors"][0]["condition"] == "SELECTED_COLUMN_NOT_FOUND" and value(p, "customers", "email", "non_null_count") == 150 and p["tables"][0]["scope"]["scope_label"] == "filtered_table"
    assert all(r["validation"] == "not_validated" for r in p["relationships"])
    meta = runner.profile(spark, C.validated({**CONFIG, "analysis_level": "metadata", "table_options": {}}), opener)
    assert profile_errors(meta) == [] and not any(f["metrics"] for t in meta["tables"] for f in t["field_profiles"]) and meta["tables"][0]["table_metrics"][0]["status"] == "unavailable"
    assert "6. Limitations" in documents(meta)["quality_report.md"]


def test_redaction_and_sampling_off(spark, opener):
    config = C.validated({**CONFIG, "tables": ["customers", "order_events"], "relationships": [], "table_options": {}, "deep": {}, "sampling": {"method": "none"}, "value_policy": {"aggregate_extremes": "redact", "json_key_names": "redact"}})
    p = runner.profile(spark, config, opener)
    assert profile_errors(p) == [] and p["tables"][0]["sample"]["stopped_reason"] == "disabled" and {m["status"] for m in field(p, "customers", "worth")["metrics"] if m["name"] in ("min", "max", "mean", "quantiles")} == {"redacted"}


def test_sample_bounds(spark):
    df = spark.range(100).selectExpr("repeat('x', 100) AS a", "if(id = 1, repeat('y', 500), NULL) AS b")
    nodes, _ = select(schema_tree(df.schema))
    s = semantics.sampled(df, nodes, {**C.DEFAULTS["sampling"], "max_rows": 50, "max_bytes": 1024, "max_value_chars": 200})
    assert s.count() == 50 and s.where("within").count() == 10
    v = semantics.values_of(s, nodes)
    assert v.where("truncated").count() == 1 and v.where("path = 'b' AND value IS NULL").count() == 9


def test_maplike_json_is_merged(spark):
    rows = [(f'{{"k{k}": 1, "fixed": {{"u{k % 3}": 2}}}}',) for k in range(60)]
    docs = json_docs.documents(spark.createDataFrame(rows, "value string").selectExpr("'f' AS path", "value", "false AS truncated"))
    got = {r["json_path"]: r for r in json_docs.catalogue(docs).collect()}
    assert set(got) == {"$.*", "$.fixed", "$.*.*", "$.fixed.u0", "$.fixed.u1", "$.fixed.u2"} - {"$.*.*"} or "$.*" in got
    few = json_docs.documents(spark.createDataFrame([('{"odd key!": 1}',)] * 3, "value string").selectExpr("'f' AS path", "value", "false AS truncated"))
    assert [r["json_path"] for r in json_docs.catalogue(few).collect()] == ["$.*"]


def test_failed_expression_is_isolated(spark):
    from profilekit.operators import aggregate

    df = spark.range(10)
    plan = plan_measures(select(schema_tree(df.schema))[0], C.defaults(), REFERENCE)
    plan.specs[3].sql = "no_such_function(id)"
    rows = {(r["path"], r["metric"]): r for r in aggregate.measure(df, plan, "t").collect()}
    bad = plan.specs[3].metric.name
    assert rows["id", bad]["status"] == "error" and sum(r["status"] == "error" for r in rows.values()) == 1


def test_package_and_cli(spark, opener, tmp_path):
    config = C.validated({**CONFIG, "analysis_level": "standard"})
    p, summary = package.run_package(spark, config, {"output_dir": str(tmp_path), "tables_json": '["customers"]'}, opener, log=lambda _: None)
    assert shape_errors(summary, SHAPES["job_summary"]) == [] and json.loads(package.exit_value(config, summary))["tables"]["total"] == 1
    m = json.loads((tmp_path / p["run"]["run_id"] / "manifest.json").read_text())
    assert shape_errors(m, SHAPES["manifest"]) == [] and m["status"] == "succeeded" and len(m["files"]) == 7
    at = str(tmp_path / p["run"]["run_id"] / "profile.json")
    assert cli.main(["validate", "--profile", at]) == cli.OK and cli.main(["render", "--input", at, "--output", str(tmp_path / "out")]) == cli.OK and cli.main(["render", "--input", at, "--output", str(tmp_path / "out")]) == cli.IO


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    s = at_path(spark, path)
    assert s.key == "t" and s.frame.count() == 5 and not s.pinned
    spark.range(7).createOrReplaceTempView("seven")
    v = open_table(spark, "seven")
    assert v.frame.count() == 7 and describe_extended(spark, "`seven`") == {} and environment(spark)["connection"] == "classic"
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        open_table(spark, "no_such_table")


def test_key_rows_of_information_schema(spark):
    c = spark.createDataFrame([("c", "s", "pk", "PRIMARY KEY", "S", "T"), ("c", "s", "other", "UNIQUE", "s", "u")], "constraint_catalog string, constraint_schema string, constraint_name string, constraint_type string, table_schema string, table_name string")
    u = spark.createDataFrame([("c", "s", "pk", "a", 1, None), ("c", "s", "other", "b", 1, None)], "constraint_catalog string, constraint_schema string, constraint_name string, column_name string, ordinal_position int, position_in_unique_constraint int")
    r = spark.createDataFrame([], "constraint_catalog string, constraint_schema string, constraint_name string, unique_constraint_catalog string, unique_constraint_schema string, unique_constraint_name string")
    found, _ = K.assemble([x.asDict() for x in K.key_rows(c, u, r, "s", "t").collect()], [])
    assert [(x["name"], x["constraint_type"], x["columns"]) for x in found] == [("pk", "primary_key", ["a"])]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(300).selectExpr("timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "if(id % 5 = 0, NULL, id) AS v", "concat('s', id % 7) AS s")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(src)
    late = spark.sql("SELECT timestamp'2025-01-01 02:00:00' AS ts, 1L AS v, 's' AS s")
    late.write.mode("append").parquet(src)
    q = stream_profile.start(stream_profile.windowed_metrics(spark.readStream.schema(df.schema).parquet(src), "ts", watermark="1 minute"), out, str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {(r["window_start"], r["path"], r["metric"]): r["number"] for r in spark.read.parquet(out).collect()}
    want = {(r["window_start"], r["path"], r["metric"]): r["number"] for r in stream_profile.windowed_metrics(df, "ts").collect()}
    assert len(want) > 50 and got == want
