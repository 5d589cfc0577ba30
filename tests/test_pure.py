"""Parts that need no Spark session: names, configuration, shapes, budgets, documents."""

import datetime as dt
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from profilekit import cli, encoding, notebook
from profilekit import config as C
from profilekit import identifiers as ids
from profilekit.contract import render, shapecheck
from profilekit.contract.shapes import SHAPES
from profilekit.operators import json_docs, keys, referential
from profilekit.plans import budget, registry
from profilekit.plans.measure import plan_measures
from profilekit.plans.targets import choose
from profilekit.plans.tree import schema_tree, select
from profilekit.sources import constraints as K
from profilekit.sources import sink
from profilekit.sources.tables import recorded_rows

REFERENCE = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()


def struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMA = struct(id=LONG, s=struct(a=STRING, t=struct(x=INT)), l=T.ArrayType(struct(q=INT, m=T.MapType(STRING, INT))), m=T.MapType(STRING, T.DoubleType()), **{"a.b": STRING}, n=T.TimestampNTZType(), d=T.DecimalType(10, 0))


@pytest.mark.parametrize("text, parts", [("a.b.c", ["a", "b", "c"]), ("`x y`.t1", ["x y", "t1"]), (" `a``b` ", ["a`b"]), ("9t", ["9t"])])
def test_table_names(text, parts):
    assert ids.parse_table(text) == parts
    assert ids.parse_table(ids.quote_table(parts)) == parts


@pytest.mark.parametrize("text", ["", " ", "a.", ".a", "a..b", "a b", "`a", "a.b.c.d", "``", "a`b`", "x\x00", 7])
def test_bad_table_names(text):
    with pytest.raises(ids.IdentifierError):
        ids.parse_table(text)


names = st.text(st.characters(exclude_categories=("Cs", "Cc", "Zl", "Zp")), min_size=1, max_size=8)


@given(st.lists(names, min_size=1, max_size=3), st.lists(st.sampled_from([ids.ITEM, ids.KEY, ids.VALUE]), max_size=2))
def test_paths_round_trip(fields, marks):
    path = tuple(map(ids.field, fields)) + tuple(map(ids.Segment, marks))
    assert ids.parse_path(ids.display(path)) == path


def test_paths_are_typed():
    assert ids.display(ids.reference("a.b")) == "`a.b`" and ids.display(ids.reference(["a", "b"])) == "a.b"
    assert ids.field_id(ids.reference("a.b")) != ids.field_id(ids.reference(["a", "b"]))
    assert ids.lookup_key("Cat.`S`.T") == ids.lookup_key("cat.s.t")
    for bad in ("", "a..b", "[]", "a.", "1a", "a[", "a b"):
        with pytest.raises(ids.IdentifierError):
            ids.parse_path(bad)


def test_tree_limits_and_selection():
    tree = schema_tree(SCHEMA, 2, 200)
    assert [n.display for n in tree.fields] == ["id", "s", "l", "m", "`a.b`", "n", "d"]
    assert tree.find(ids.parse_path("s.t")).omitted_reason == "max_depth"
    few = schema_tree(SCHEMA, 5, 4)
    assert few.top_omitted == 3 and [n.omitted for n in few.fields] == [0, 2, 1, 2]
    nodes, left = select(tree, ["id", "l"])
    assert [n.display for n in nodes] == ["id", "l"]
    assert {(o["display_path"], o["reason"]) for o in left} == {("s", "not_selected"), ("m", "not_selected"), ("`a.b`", "not_selected"), ("n", "not_selected"), ("d", "not_selected"), ("l[]", "inside_collection")}


def test_budget_drops_highest_tier_from_the_end():
    items = [("r", 0, 1), ("a", 1, 1), ("b", 4, 2), ("c", 3, 1), ("d", 4, 1)]
    fit = lambda n: budget.fit(items, n, lambda x: x[1], lambda x: x[2])
    assert [x[0] for x in fit(5)[1]] == ["d"] and [x[0] for x in fit(4)[1]] == ["b", "d"] and [x[0] for x in fit(0)[0]] == ["r"]
    assert budget.pack([1, 2, 2, 1], 3, lambda x: x) == [[1, 2], [2, 1]] and budget.pack([2], 3, lambda x: x, [[1]]) == [[1, 2]]


def test_deep_never_displaces_standard():
    tree = schema_tree(SCHEMA, 5)
    nodes, _ = select(tree)
    config = C.merge(C.defaults(), {"limits": {"max_expressions_per_pass": 30, "max_aggregate_passes": 2}, "deep": {"max_extra_passes": 0}})
    plain = plan_measures(nodes, config, REFERENCE)
    deep = plan_measures(nodes, config, REFERENCE, members=choose(tree, nodes, config, "t").members)
    standard = lambda p: [(s.node.display if s.node else None, s.metric.name) for s in p.specs if s.group == "standard"]
    assert standard(plain) == standard(deep) and len(plain.passes) == len(deep.passes)
    assert any(o["reason"] == "deep_budget" for o in deep.omissions)


def test_redaction_covers_members():
    tree = schema_tree(SCHEMA, 5)
    nodes, _ = select(tree)
    targets = choose(tree, nodes, C.defaults(), "t")
    plan = plan_measures(nodes, C.defaults(), REFERENCE, members=targets.members, redacted={"m", "id"})
    hidden = {(x.node.display, x.metric) for x in plan.static if x.status == "redacted"}
    assert ("m{value}", "min") in hidden and ("id", "quantiles") in hidden and not any(p == "l[].q" for p, _ in hidden)
    assert ("n", "after_reference_count") in {(x.node.display, x.metric) for x in plan.static if x.status == "not_computed"}


def test_deep_targets():
    tree = schema_tree(SCHEMA, 5)
    nodes, _ = select(tree)
    every = choose(tree, nodes, C.defaults(), "t")
    assert [n.display for n in every.members] == ["l[]", "l[].q", "l[].m", "m{key}", "m{value}"]
    assert {(o["display_path"], o["reason"]) for o in every.omissions} == {("l[].m{key}", "nested_collection"), ("l[].m{value}", "nested_collection")}
    config = C.merge(C.defaults(), {"deep": {"targets": [{"table": "T", "column": c} for c in ("m", "id", "nope", "l[].q", "`a.b`")]}})
    some = choose(tree, nodes, config, "t")
    assert [n.display for n in some.collections] == ["m"] and [n.display for n in some.json_nodes] == ["`a.b`"] and [x["display_path"] for x in some.not_eligible] == ["id", "nope", "l[].q"]
    assert ("l[]", "deep_not_selected") in {(o["display_path"], o["reason"]) for o in some.omissions}


def test_key_plans():
    tree = schema_tree(SCHEMA, 5)
    u = {"keys": [{"id": "one", "table": "t", "columns": ["id"]}, {"table": "T", "columns": ["id"], "id": "two"}, {"table": "t", "columns": [["s", "a"], "id"]}, {"table": "t", "columns": ["l"]}, {"table": "t", "columns": ["gone"]}, {"table": "t", "columns": ["id", "id"]}, {"table": "t", "columns": ["n"]}], "max_keys": 2, "max_passes": 2, "declared_keys": True}
    config = C.merge(C.defaults(), {"deep": {"uniqueness": u}})
    asked = keys.requested(config, "t", [{"constraint_type": "primary_key", "name": "pk", "columns": ["ID"]}], [], tree)
    plan = keys.plan(tree, asked, config)
    assert [(k["status"], k["origins"], k["names"]) for k in plan["keys"]][:2] == [("planned", ["configured", "declared_primary_key"], ["one", "two", "pk"]), ("planned", ["configured"], [])]
    assert [k["status"] for k in plan["keys"][2:]] == ["not_eligible", "not_eligible", "not_eligible", "not_computed"] and len(plan["passes"]) == 2 and plan["limited"][0]["reason"] == "uniqueness_budget"


def test_types_that_compare():
    ok = lambda a, b: referential.compatible(a, b)[0]
    assert ok(INT, LONG) and ok(INT, T.DecimalType(5, 2)) and ok(T.DateType(), T.DateType())
    assert not ok(INT, STRING) and not ok(T.DoubleType(), INT) and not ok(T.TimestampType(), T.TimestampNTZType()) and not ok(T.ArrayType(INT), T.ArrayType(INT))


def test_constraints_from_rows_in_any_order_and_case():
    row = {"constraint_catalog": "C", "constraint_schema": "s", "constraint_name": "fk", "constraint_type": "foreign key", "unique_constraint_catalog": "c", "unique_constraint_schema": "S", "unique_constraint_name": "PK"}
    rows = [row | {"column_name": "b", "ordinal_position": 2, "position_in_unique_constraint": 1}, row | {"column_name": "a", "ordinal_position": 1, "position_in_unique_constraint": 2, "constraint_catalog": "c"}]
    target = {"constraint_catalog": "c", "constraint_schema": "s", "constraint_name": "pk", "table_catalog": "c", "table_schema": "s", "table_name": "parent"}
    targets = [target | {"column_name": "y", "ordinal_position": 2}, target | {"column_name": "x", "ordinal_position": 1}]
    found, notes = K.assemble(rows, targets)
    assert found[0]["columns"] == ["a", "b"] and found[0]["referenced"] == {"table": "c.s.parent", "columns": ["y", "x"]} and not notes
    assert K.declared("c.s.child", found)[0]["to"]["columns"] == ["y", "x"]
    lost, notes = K.assemble(rows, [])
    assert lost[0]["referenced"] is None and "not visible" in notes[0] and K.declared("t", lost) == []


def test_config_defaults_are_valid_and_merge():
    assert C.validated({"kind": C.KIND, "config_version": "1.0"}) == C.defaults()
    merged = C.merge({"table_options": {"a": {"purpose": "x", "checks": []}}, "limits": {"max_depth": 1, "max_fields": 2}}, {"table_options": {"a": {"purpose": "y"}}, "limits": {"max_depth": 3}})
    assert merged == {"table_options": {"a": {"purpose": "y"}}, "limits": {"max_depth": 3, "max_fields": 2}}


@pytest.mark.parametrize("change, part", [
    ({"tables": ["a", "A"]}, "duplicate table"), ({"tables": [f"t{k}" for k in range(11)]}, "exceed"), ({"sampling": {"method": "random"}}, "random_fraction"), ({"semantic": {"mixed_threshold": 0.97}}, "below detect_threshold"), ({"extra": 1}, "not allowed"),
    ({"table_options": {"t": {"filters": [{"column": "a", "operator": "in", "value": 3}]}}}, "list of 1"), ({"table_options": {"t": {"filters": [{"column": "a", "operator": "eq"}]}}}, "needs a value"), ({"table_options": {"t": {"filters": [{"column": "a", "operator": "is_null", "value": 1}]}}}, "takes no value"),
    ({"table_options": {"t": {"filters": [{"column": "a", "operator": "gt", "value": "2025-13-01", "value_type": "date"}]}}}, "ISO 8601"), ({"table_options": {"t": {"filters": [{"column": "a", "operator": "between", "value": [1]}]}}}, "[low, high]"), ({"table_options": {"t": {"checks": [{"id": "x", "type": "max_null_ratio", "max": 2, "column": "c"}]}}}, "between 0 and 1"),
    ({"table_options": {"t": {"checks": [{"id": "x", "type": "min_row_count", "max": 2}]}}}, "takes 'min' only"), ({"table_options": {"t": {"checks": [{"id": "x", "type": "value_range", "column": "c", "min": 2, "max": 1}]}}}, "greater"), ({"value_policy": {"example_columns": [{"table": "t", "column": "c"}]}}, "persist_examples"),
    ({"relationships": [{"id": "r", "from": {"table": "a", "columns": ["x", "y"]}, "to": {"table": "b", "columns": ["z"]}}]}, "as many"), ({"deep": {"uniqueness": {"keys": [{"id": "k", "table": "a", "columns": ["x"]}, {"id": "k", "table": "a", "columns": ["y"]}]}}}, "duplicate key id"),
])
def test_config_problems(change, part):
    with pytest.raises(C.ConfigError) as e:
        C.validated({"kind": C.KIND, "config_version": "1.0", **change})
    assert part in str(e.value)


def test_parameters_take_precedence():
    base = C.defaults() | {"tables": ["a"]}
    out, sources = C.with_parameters(base, {"tables_json": '["b"]', "config_json": '{"limits": {"max_depth": 1}}', "output_dir": "/x"})
    assert out["tables"] == ["b"] and out["limits"]["max_depth"] == 1 and out["limits"]["max_fields"] == 200 and sources["config_json_overrides"] == ["limits"]
    for bad in ({"config_json": '{"tables": []}'}, {"config_json": "["}, {"tables_json": "{}"}, {"config_json": '{"kind": "x"}'}, {"analysis_level": "all"}):
        with pytest.raises(C.ConfigError):
            C.with_parameters(base, bad)
    assert len(C.execution_errors(C.defaults())) == 2 and C.execution_errors({"tables": ["a"], "output_dir": "s3://x"})


def test_shapes_use_known_keywords_only():
    assert {k: shapecheck.unknown_keywords(s) for k, s in SHAPES.items()} == {k: set() for k in SHAPES}
    shape = {"type": "array", "items": {"oneOf": [{"const": 1}, {"type": "string", "pattern": "^a"}]}, "uniqueItems": True}
    assert shapecheck.shape_errors([1, "ab"], shape) == [] and len(shapecheck.shape_errors([True, "b", "b"], shape)) == 4
    assert shapecheck.shape_errors(1.0, {"type": "integer"}) == [] and shapecheck.shape_errors(True, {"type": "integer"})


def test_encoding():
    assert encoding.decode("NaN", "float") == "NaN" and encoding.decode("-Infinity", "float") == "-Infinity" and encoding.decode("12", "integer") == 12 and encoding.decode("1.50", "decimal") == "1.50" and encoding.decode(None, "float") is None
    assert encoding.utc(dt.datetime(2025, 1, 2, 3, 4, 5, 6000, dt.UTC)) == "2025-01-02T03:04:05.006Z"
    assert encoding.safe_message("[X] cannot cast 'secret' from s3://bucket/x\nmore") == "[X] cannot cast <value> from <uri>"
    assert encoding.error_record("sample", ValueError("[A.B] x"))["condition"] == "A.B"


def test_statistics_text():
    assert recorded_rows({"Statistics": "1024 bytes, 17 rows"}) == 17 and recorded_rows({"Statistics": "1024 bytes"}) is None and recorded_rows({}) is None


def test_json_paths_for_the_engine():
    assert json_docs.engine_path('$.a["b c"].d') == "$.a['b c'].d" and json_docs.engine_path("$.a[*]") is None and json_docs.engine_path("$.*") is None


def test_markdown_and_diagrams_are_inert():
    assert render.text("a|b\n<i>*x*") == "a\\|b &lt;i&gt;\\*x\\*" and render.code("a`b|c") == "`` a`b\\|c ``" and render.code("``x") == "` ``x `" and render.diagram_text('a"b<c>#') == "a#34;b#60;c#62;#35;"
    taken: set[str] = set()
    assert [render.diagram_name(n, taken) for n in ("a.b", "a_b", "1x", "")] == ["a_b", "a_b_28cb39ea", "e_1x", "e_"]
    assert render.share(0.00001) == "<0.01%" and render.share(0.99999) == ">99.99%" and render.share(None) == "—" and render.count(1234) == "1,234"


def test_files_are_never_replaced_unasked(tmp_path):
    sink.write_files(str(tmp_path), {"a": "1", "b": "2"})
    with pytest.raises(sink.OutputExistsError):
        sink.write_files(str(tmp_path), {"c": "3", "a": "4"})
    assert not (tmp_path / "c").exists() and (tmp_path / "a").read_text() == "1"
    sink.write_files(str(tmp_path), {"a": "5"}, replaceable=("a",))
    with pytest.raises(ValueError):
        sink.write_files(str(tmp_path), {"../x": ""})


def test_cli_without_spark(tmp_path, capsys):
    c, n = str(tmp_path / "c.json"), str(tmp_path / "n.py")
    assert cli.main(["init", "--output", c, "--tables", "a.b", "--output-dir", "/out"]) == cli.OK and cli.main(["init", "--output", c]) == cli.IO
    assert cli.main(["validate", "--config", c]) == cli.OK and cli.main(["validate", "--config", str(tmp_path / "no")]) == cli.IO and cli.main(["validate", "--profile", c]) == cli.INVALID
    assert cli.main(["generate", "--config", c, "--output", n]) == cli.OK and cli.main(["generate", "--config", c, "--output", n]) == cli.IO
    assert cli.main(["schema", "profile"]) == cli.OK and cli.main(["nothing"]) == cli.USAGE and cli.main(["init", "--tables", "a..b", "--output", str(tmp_path / "d")]) == cli.INVALID
    capsys.readouterr()
    manifest = json.loads((tmp_path / "n.generation.json").read_text())
    assert manifest["notebook"]["file_name"] == "n.py" and manifest["generation_id"].startswith("sha256:")


def test_notebook_is_reproducible_and_self_contained(tmp_path):
    config = C.defaults()
    a, b = notebook.generate(config), notebook.generate(config)
    assert a == b and a[1]["generation_id"] != notebook.generate(config | {"purpose": "x"})[1]["generation_id"]
    import io
    import zipfile

    inside = zipfile.ZipFile(io.BytesIO(notebook.archive())).namelist()
    assert "profilekit/runner.py" in inside and not any("/llm/" in x for x in inside)


def test_registry_covers_each_kind():
    tree = schema_tree(SCHEMA, 5)
    by = {n.display: {m.name for m in registry.column_metrics(n)} for n in select(tree)[0]}
    assert {"null_count", "approx_distinct_count", "quantiles", "stddev"} <= by["id"] and by["s"] == {"null_count"} and "null_count_parent_present" in by["s.a"]
    assert {"total_element_count", "null_element_count"} <= by["l"] and {"total_entry_count", "null_value_count"} <= by["m"] and "mean" not in by["n"]
