"""A run: tables, a few at a time, then what holds between them, then the profile document.

Data are read by a bounded number of Spark actions a table: the sample, the aggregate passes, at most one pass for member
distinct counts and one for keys (by default); a check of a relationship is one action. Everything later works on the
small frames of results. A table or stage that fails is recorded and does not stop the others.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit import encoding
from profilekit import identifiers as ids
from profilekit.config import options_for, policy_paths
from profilekit.contract import document
from profilekit.functions import access
from profilekit.operators import aggregate, distinct, judge, json_docs, keys, referential, semantics
from profilekit.plans.measure import MeasurePlan, plan_measures
from profilekit.plans.targets import DeepTargets, choose, context
from profilekit.plans.tree import Node, Tree, schema_tree, select
from profilekit.sources import constraints as declared_keys
from profilekit.sources.tables import Source, again, capabilities, environment, json_method, open_table, recorded_rows

#: Tables profiled side by side.
AT_ONCE = 4
Opener = Callable[[str], Source]
Log = Callable[[str], None]


@dataclass
class Profiled:
    """A table's profile in the making, and the frames that later stages need."""

    record: dict[str, Any]
    config: Mapping[str, Any]
    source: Source | None = None
    tree: Tree | None = None
    nodes: list[Node] = field(default_factory=list)
    scoped: DataFrame | None = None
    metrics: DataFrame | None = None
    formats: list[dict[str, Any]] = field(default_factory=list)
    json_shapes: list[dict[str, Any]] = field(default_factory=list)
    checks: list[dict[str, Any]] = field(default_factory=list)


def _local(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1)


def _frozen(df: DataFrame) -> DataFrame:
    """The rows of a small result (a sample, or metrics), held by the driver: later stages read nothing again. One partition, so they shuffle nothing."""
    table = df.toArrow()
    return (df.sparkSession.createDataFrame(table, df.schema) if table.num_rows else df.sparkSession.createDataFrame([], df.schema)).coalesce(1)


class Run:
    def __init__(self, spark: SparkSession, config: Mapping[str, Any], opener: Opener | None = None, log: Log = lambda _: None, reference: dt.datetime | None = None):
        self.spark, self.config, self.log = spark, config, log
        self.open = opener or (lambda name: open_table(spark, name, config["consistency"]["pin_delta_version"]))
        self.started = encoding.now()
        self.reference = reference or self.started
        self.run_id = f"{self.started:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        self.can = capabilities(spark)
        self.level = config["analysis_level"]

    @contextmanager
    def stage(self, record: dict[str, Any], name: str, operation: dict[str, Any] | None = None) -> Iterator[None]:
        """Times a stage; an error in it is recorded and leaves the table partial."""
        began, status = time.monotonic(), "succeeded"
        if operation:
            record["operations"]["planned"].append(operation)
        try:
            yield
        except Exception as e:  # noqa: BLE001 - one failing stage must not lose the rest
            status = "failed"
            record["errors"].append(encoding.error_record(name, e))
        took = round(1000 * (time.monotonic() - began))
        record["timings_ms"][name] = record["timings_ms"].get(name, 0) + took
        if operation:
            record["operations"]["observed"].append({"operation_id": operation["operation_id"], "status": status, "duration_ms": took})

    # one table

    def table(self, name: str) -> Profiled:
        record = document.new_table(name)
        out, began = Profiled(record, self.config), time.monotonic()
        with self.stage(record, "resolve"):
            out.source = self.open(name)
        if out.source is not None:
            self._resolved(out)
        record["timings_ms"]["total"] = round(1000 * (time.monotonic() - began))
        return out

    def _resolved(self, out: Profiled) -> None:
        record, source, limits = out.record, out.source, self.config["limits"]
        assert source is not None
        record |= {"table_key": source.key, "table_id": ids.table_id(source.parts), "notes": list(source.notes), "constraints": list(source.constraints)}
        record["identifier"] |= {"parts": source.parts, "quoted": ids.quote_table(source.parts)}
        options = options_for(self.config, source.lookup)
        record["purpose"] = options.get("purpose")
        if len(source.parts) == 3 and not source.is_path and self.can["parameterized_sql"]:
            try:
                found, notes = declared_keys.query_keys(self.spark, source.parts)
                record["constraints"] += found
                record["notes"] += notes
            except Exception as e:  # noqa: BLE001 - catalogs without such views have no declared keys
                record["notes"].append(f"declared keys: {encoding.safe_message(e)}")
        out.tree = schema_tree(source.frame.schema, limits["max_depth"], limits["max_fields"])
        record["schema"], record["source"] = out.tree.record(), document.source_record(source)
        columns, filters = options.get("columns"), options.get("filters", [])
        record["scope"] |= {"filters": list(filters), "selected_columns": columns, "population": "filtered" if filters else "full"}
        record["consistency"] = document.consistency(source, self.level)
        for problem in self._missing(out.tree, columns, filters):
            record["errors"].append(problem)
        out.nodes, omissions = select(out.tree, columns)
        deep = choose(out.tree, out.nodes, self.config, source.lookup) if self.level == "deep" else None
        if deep is not None:
            replaced = {n.field_id for n in deep.members} | {o["field_id"] for o in deep.omissions}
            omissions = [o for o in omissions if o["reason"] != "inside_collection" or o["field_id"] not in replaced] + deep.omissions
        record["omissions"] += omissions
        out.checks = self._asked(out, options)
        if self.level == "metadata":
            record["table_metrics"].append(document.recorded_row_count(recorded_rows(source.metadata)))
            document.add_fields(record, out.tree, [], [], "metadata_level")
        elif record["errors"]:
            document.add_fields(record, out.tree, [], [], "resolve")
        else:
            self._measured(out, deep, columns, filters)

    def _missing(self, tree: Tree, columns: Sequence[str] | None, filters: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
        top = {n.path[0].name for n in tree.fields}
        lost = sum(c not in top for c in columns or [])
        bad = []
        if lost:
            bad.append({"stage": "resolve", "type": "ConfigurationError", "condition": "SELECTED_COLUMN_NOT_FOUND", "message": f"{lost} selected column(s) not found in the table schema"})
        if any(tree.find(ids.reference(f["column"])) is None for f in filters):
            bad.append({"stage": "resolve", "type": "ConfigurationError", "condition": "FILTER_COLUMN_NOT_FOUND", "message": "a filter references a column that is not in the table schema"})
        return bad

    def _asked(self, out: Profiled, options: Mapping[str, Any]) -> list[dict[str, Any]]:
        asked = []
        for c in options.get("checks", []):
            where = ids.reference(c["column"]) if "column" in c else None
            node = out.tree.find(where) if out.tree and where else None
            asked.append({"table": out.record["table_key"], "check_id": c["id"], "type": c["type"], "path": ids.display(where) if where else None, "low": None if c.get("min") is None else float(c["min"]), "high": None if c.get("max") is None else float(c["max"]), "known": where is None or node is not None, "profiled": where is None or node in out.nodes, "kind": node.kind if node else None, "parameters": {k: c[k] for k in ("min", "max") if k in c}, "description": c.get("description")})
        return asked

    def _measured(self, out: Profiled, deep: DeepTargets | None, columns: Sequence[str] | None, filters: Sequence[Mapping[str, Any]]) -> None:
        record, source, config = out.record, out.source, self.config
        assert source is not None and out.tree is not None
        scope = ("filtered_" if filters else "full_") + ("snapshot" if source.pinned else "table")
        record["scope"]["scope_label"] = scope
        out.scoped = access.filtered(source.frame, filters)
        frame = access.projected(out.scoped, columns)
        redact = policy_paths(config, source.lookup, "redact_columns")
        if config["value_policy"]["aggregate_extremes"] == "redact":
            redact = redact | {n.display for n in out.nodes}
        strings = [n for n in out.nodes if n.kind == "string"]
        sampling = config["sampling"]
        chosen = strings[: sampling["max_columns"]] if sampling["method"] != "none" else []
        record["sample"] = document.sample_record(sampling, chosen, len(strings) - len(chosen))
        likely: list[str] = []
        paths: dict[str, list[dict[str, Any]]] = {}
        semantic: dict[str, dict[str, Any]] = {}
        if chosen:
            with self.stage(record, "sample", {"operation_id": "op_sample", "kind": "sample_collect", "description": "bounded sample of string fields", "reads_user_data": True}):
                likely, paths, semantic = self._sampled(out, frame, chosen, deep, redact)
        checks = [c for n in chosen for c in json_docs.path_checks(n, paths.get(n.display, []), json_method(self.can) if config["deep"]["json_full_scope_validation"] else None)]
        plan = plan_measures(out.nodes, config, self.reference, deep.members if deep else [], likely, redact, checks, self.can["try_parse_json"])
        operations: list[dict[str, Any]] = []
        for k, p in enumerate(plan.passes):
            kind = "aggregate" if k < plan.standard_passes else "deep_aggregate"
            record["operations"]["planned"].append({"operation_id": f"op_{kind}_{k + 1}", "kind": f"{kind}_pass", "description": f"{len(p)} metric(s) in one aggregation", "reads_user_data": True})
        with self.stage(record, "aggregate"):
            row = aggregate.run_passes(frame, plan, operations)
            out.metrics = _frozen(aggregate.long_frame(row, plan, record["table_key"], scope))
            self._json_results(row, plan, paths)
        record["operations"]["observed"] += operations
        record["errors"] += [{"stage": "aggregate", "type": "PassFailed", "condition": None, "message": o["error"]} for o in operations if o["status"] == "failed"]
        record["omissions"] += plan.omissions
        more = self._distinct(out, frame, deep, scope) if deep else {}
        if deep:
            record["deep"] = document.deep_record(config, deep, plan, paths)
        rows = [r.asDict() for r in out.metrics.collect()] if out.metrics is not None else []
        document.add_fields(record, out.tree, out.nodes, deep.members if deep else [], None, rows, more, {n.field_id: context(n) for n in deep.members} if deep else {}, semantic, paths, self.level)

    def _sampled(self, out: Profiled, frame: DataFrame, chosen: list[Node], deep: DeepTargets | None, redact: set[str]) -> tuple[list[str], dict[str, list[dict[str, Any]]], dict[str, dict[str, Any]]]:
        config, record = self.config, out.record
        sample = _frozen(semantics.sampled(frame, chosen, config["sampling"]))  # at most max_rows rows
        held = sample.agg(F.count_if("within").alias("rows"), F.coalesce(F.sum(F.when(F.col("within"), F.col("bytes"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("read")).first()
        values = semantics.values_of(sample, chosen)
        counted = [r.asDict(recursive=True) for r in semantics.formats(semantics.counts(values), config["semantic"]).collect()]
        stopped = "byte_budget" if held["rows"] < held["read"] else "row_limit" if held["read"] >= config["sampling"]["max_rows"] else "exhausted"
        record["sample"] |= {"rows_collected": held["rows"], "bytes_retained": held["bytes"], "values_truncated": sum(c["truncated"] for c in counted), "stopped_reason": stopped}
        by_path = {c["path"]: c for c in counted}
        out.formats = [{"table": record["table_key"], "path": c["path"], "status": c["status"], "format": c["format"], "eligible": c["eligible"]} for c in counted]
        alike = {r["path"]: r.asDict() for r in semantics.concentration(values).collect()}
        semantic = {n.display: {"format": document.observed_format(by_path[n.display], config) if n.display in by_path else None, "concentration": alike.get(n.display), "json": None, "examples": None} for n in chosen}
        shown = policy_paths(config, out.source.lookup, "example_columns") - redact if config["value_policy"]["persist_examples"] and out.source else set()
        if shown:
            for r in semantics.examples(values.where(F.col("path").isin(list(shown))), config["value_policy"]).orderBy("path", "nth").collect():
                entry = semantic[r["path"]]
                entry["examples"] = (entry["examples"] or []) + [{"value": r["value"], "sample_count": r["sample_count"], "truncated": r["truncated"]}]
        like = [p for p, c in by_path.items() if c["json_like"] or c["format"] in ("json_object", "json_array")]
        wanted = set(like) | ({n.display for n in deep.json_nodes} if deep else set())
        if not wanted or not self.can["variant_functions"]:
            return [], {}, semantic
        docs = json_docs.documents(values.where(F.col("path").isin(sorted(wanted))))
        named = config["value_policy"]["json_key_names"] == "include"
        shapes = {r["path"]: r.asDict(recursive=True) for r in json_docs.shape(docs).collect()}
        types: dict[str, list[dict[str, Any]]] = {}
        for r in json_docs.key_types(docs).orderBy(F.desc("present_in"), "key").collect():
            types.setdefault(r["path"], []).append(r.asDict(recursive=True))
        likely = []
        for p, s in shapes.items():
            if p in like:
                semantic[p]["json"] = document.json_shape(s, types.get(p, []), named and p not in redact, config["sampling"]["method"], by_path[p])
                out.json_shapes.append({"table": record["table_key"], **s})
                if s["eligible"] and (s["object"] + s["array"]) / s["eligible"] >= config["thresholds"]["json_min_ratio"]:
                    likely.append(p)
        paths: dict[str, list[dict[str, Any]]] = {}
        if deep and config["deep"]["json_paths"]:
            into = [n.display for n in deep.json_nodes] if deep.explicit else likely
            listed = json_docs.listed_paths(json_docs.catalogue(docs.where(F.col("path").isin(into)), config["deep"]["max_json_depth"], config["deep"]["max_json_object_keys"]), 1 << 30)
            for r in listed.orderBy("path", "nth").collect() if into else []:
                paths.setdefault(r["path"], []).append(r.asDict() | {"shown": named and r["path"] not in redact and r["nth"] <= config["deep"]["max_json_paths"]})
            for p in into:
                paths.setdefault(p, [])
        return likely, {p: [x for x in some if x["shown"]] if named else [] for p, some in paths.items()}, semantic

    def _json_results(self, row: DataFrame, plan: MeasurePlan, paths: dict[str, list[dict[str, Any]]]) -> None:
        """Full-scope counts of JSON paths, from the wide row."""
        specs = [s for s in plan.specs if s.group == "json" and s.alias not in plan.failed]
        got = row.select(*[s.alias for s in specs]).first() if specs else None
        totals = {s.node.display: got[s.alias] for s in specs if s.metric.name == "json_documents" and s.node} if got else {}
        for s in specs:
            if s.node is None:
                continue
            for p in paths.get(s.node.display, []):
                p["documents_in_scope"] = totals.get(s.node.display)
                if p["json_path"] == s.detail.get("json_path"):
                    p.setdefault("full_scope", []).append({"metric": s.metric.name, "value": int(got[s.alias]), "method": s.metric.method, "detail": s.detail})

    def _distinct(self, out: Profiled, frame: DataFrame, deep: DeepTargets, scope: str) -> dict[str, dict[str, Any]]:
        settings, leaves = self.config["deep"], distinct.countable(deep.members)
        mode, sampling = settings["element_distinct"], self.config["sampling"]
        if mode == "off" or not leaves or (mode == "sample" and sampling["method"] == "none"):
            reason = "disabled by configuration" if mode == "off" or leaves else "no atomic element fields to count"
            return {n.display: {"status": "not_computed", "reason": reason} for n in leaves}
        if mode == "full_scope" and out.metrics is not None:
            total = out.metrics.where("metric in ('total_element_count', 'total_entry_count')").agg(F.sum("number")).first()[0] or 0
            if total > settings["max_elements"]:
                return {n.display: {"status": "not_computed", "reason": f"{int(total)} members exceed deep.max_elements = {settings['max_elements']}"} for n in leaves}
        found: dict[str, dict[str, Any]] = {}
        with self.stage(out.record, "deep", {"operation_id": "op_element_explode", "kind": "element_explode_pass", "description": f"distinct counts of {len(leaves)} member field(s)", "reads_user_data": True}):
            bound = {**sampling, "max_rows": settings["max_explode_rows"]} if mode == "sample" else None
            for r in distinct.member_distinct(frame, leaves, settings["max_elements"], bound).collect():
                found[r["path"]] = {"status": "measured", "value": r["distinct_count"], "denominator": r["non_null_members"], "scope": "sample" if mode == "sample" else scope}
        return found or {n.display: {"status": "error", "reason": "the explode pass failed"} for n in leaves}

    # between tables

    def _uniqueness(self, tables: Sequence[Profiled], roles: Sequence[Mapping[str, Any]]) -> None:
        for t in tables:
            if t.scoped is None or t.tree is None or t.source is None:
                continue
            candidates = [ids.parse_path(r["path"]) for r in roles if r["role"] == "identifier_candidate" and r["table"] == t.record["table_key"]]
            asked = keys.requested(self.config, t.source.lookup, t.record["constraints"], candidates, t.tree)
            plan = keys.plan(t.tree, asked, self.config)
            got: dict[str, dict[str, Any]] = {}
            for members in plan["passes"]:
                op = members[0]["operation_id"]
                with self.stage(t.record, "uniqueness", {"operation_id": op, "kind": "uniqueness_pass", "description": f"exact uniqueness of {len(members)} key(s)", "reads_user_data": True}):
                    for r in keys.uniqueness(t.scoped, {k["key_id"]: k["paths"] for k in members}).collect():
                        got[r["key"]] = r.asDict()
            t.record["uniqueness"] = document.uniqueness(plan, got, self.config, t.record["scope"]["scope_label"], bool(asked))

    def _end(self, tables: Sequence[Profiled], end: Mapping[str, Any], declared: bool) -> tuple[Profiled | None, list[Node | None]]:
        t = next((x for x in tables if ids.lookup_key(x.record["table_key"]) == ids.lookup_key(end["table"])), None)
        if t is None or t.tree is None:
            return t, []
        paths = keys.declared_paths(end["columns"], t.tree) if declared else [ids.parse_path(c) for c in end["columns"]]
        return t, [t.tree.find(p) for p in paths]

    def _why_not(self, rel: Mapping[str, Any], a: Profiled | None, left: list[Node | None], b: Profiled | None, right: list[Node | None]) -> str | None:
        settings = self.config["deep"]["referential"]
        if self.level != "deep":
            return "referential validation runs only at the deep level"
        for origin, name in (("declared_constraint", "declared"), ("configuration", "configured")):
            if rel["origin"] == origin and not settings[name]:
                return f"not requested (deep.referential.{name} = false)"
        if rel["origin"] not in ("declared_constraint", "configuration"):
            return "only declared and configured relationships are validated"
        for side, nodes, end in ((a, left, "from"), (b, right, "to")):
            if side is None:
                return f"the {end} table is not part of this run"
            if side.scoped is None:
                return f"the {end} table could not be profiled"
            if any(n is None or n.in_collection for n in nodes):
                return f"a {end} column does not exist or lies inside a collection"
        bad = next((why for x, y in zip(left, right, strict=True) if x and y for ok, why in [referential.compatible(x.data_type, y.data_type)] if not ok), None)
        if bad:
            return bad
        return "sampling is disabled (sampling.method = none)" if settings["mode"] == "sample" and self.config["sampling"]["method"] == "none" else None

    def _inclusion(self, a: Profiled, left: Sequence[Node], b: Profiled, right: Sequence[Node], mode: str, max_rows: int) -> DataFrame:
        """Source with its filters, target in full at its recorded version."""
        assert a.scoped is not None and b.source is not None
        sample = {**self.config["sampling"], "max_rows": max_rows} if mode == "sample" else None
        counts = referential.inclusion(a.scoped, [access.column_at(n.path) for n in left], again(b.source, self.spark), [access.column_at(n.path) for n in right], sample)
        return referential.judged(counts, mode)

    def _relationships(self, tables: Sequence[Profiled]) -> tuple[list[dict[str, Any]], dict[str, Any] | None]:
        rels = declared_keys.merged(*[declared_keys.declared(t.record["table_key"], t.record["constraints"]) for t in tables], declared_keys.provided(self.config["relationships"], "configuration"))
        settings, done, limited = self.config["deep"]["referential"], 0, []
        for rel in rels:
            declared = rel["origin"] == "declared_constraint"
            a, left = self._end(tables, rel["from"], declared)
            b, right = self._end(tables, rel["to"], declared)
            reason = self._why_not(rel, a, left, b, right)
            if reason is None and done >= settings["max_relationships"]:
                reason = f"beyond deep.referential.max_relationships = {settings['max_relationships']}"
                limited.append({"item": rel["relationship_id"], "reason": "referential_budget", "detail": reason})
            if reason is not None or a is None or b is None:
                rel["validation_detail"] = document.validation_detail(None, reason or "")
                continue
            done += 1
            op, row = f"op_referential_{done}", None
            with self.stage(a.record, "referential", {"operation_id": op, "kind": "referential_check", "description": "inclusion check of one relationship", "reads_user_data": True}):
                row = self._inclusion(a, [n for n in left if n], b, [n for n in right if n], settings["mode"], settings["max_sample_rows"]).first()
            pairs = [(x, y) for x, y in zip(left, right, strict=True) if x and y]
            rel["validation_detail"] = document.validation_detail(row.asDict() if row else None, "the check failed", settings, a.record, b.record, pairs, op)
            rel["validation"] = rel["validation_detail"]["status"]
        return rels, document.referential_summary(rels, self.config, done, limited) if self.level == "deep" else None

    def _hypotheses(self, tables: Sequence[Profiled], rels: Sequence[Mapping[str, Any]], metrics: DataFrame | None) -> dict[str, Any] | None:
        settings = self.config["deep"]["relationship_hypotheses"]
        if self.level != "deep":
            return None
        if not settings["enabled"] or metrics is None:
            return document.hypotheses(self.config, reason="disabled by configuration (deep.relationship_hypotheses.enabled = false)")
        if settings["inclusion_scope"] == "sample" and self.config["sampling"]["method"] == "none":
            return document.hypotheses(self.config, reason="sampling is disabled (sampling.method = none)")
        by_key = {t.record["table_key"]: t for t in tables}
        unique = [{"table": t.record["table_key"], "path": k["columns"][0]} for t in tables for k in (t.record["uniqueness"] or {"keys": []})["keys"] if k["status"] == "measured" and k["outcome"] in ("unique", "unique_non_null") and len(k["columns"]) == 1]
        targets = [u for u in unique if (n := by_key[u["table"]].tree.find(ids.parse_path(u["path"]))) and referential.hypothetical(n)]
        known = [{"from_table": r["from"]["table"], "from_path": r["from"]["columns"][0], "to_table": r["to"]["table"], "to_path": r["to"]["columns"][0]} for r in rels if len(r["from"]["columns"]) == 1]
        ends = "from_table string, from_path string, to_table string, to_path string"
        fractional = [{"table": t.record["table_key"], "path": n.display} for t in tables for n in t.nodes if n.kind == "decimal" and n.scale != 0]
        usable = metrics.join(_local(self.spark, fractional, "table string, path string"), ["table", "path"], "left_anti")
        every = [r.asDict() for r in referential.pairs(usable, _local(self.spark, targets, "table string, path string"), _local(self.spark, known, ends)).collect()] if targets else []
        order = {k: i for i, k in enumerate(by_key)}
        open_pairs = sorted((p for p in every if not p["excluded"]), key=lambda p: (p["range_relation"] != "contained", order[p["to_table"]], p["to_path"], order[p["from_table"]], p["place"]))
        found, rejected, evaluated = [], {}, 0
        for p in open_pairs[: settings["max_pairs"]]:
            a, b = by_key[p["from_table"]], by_key[p["to_table"]]
            left, right = a.tree.find(ids.parse_path(p["from_path"])), b.tree.find(ids.parse_path(p["to_path"]))
            evaluated += 1
            op, row = f"op_hypothesis_{evaluated}", None
            with self.stage(a.record, "hypotheses", {"operation_id": op, "kind": "relationship_hypothesis_check", "description": "inclusion check of one pair of columns", "reads_user_data": True}):
                row = referential.rejection(self._inclusion(a, [left], b, [right], settings["inclusion_scope"], settings["max_sample_rows"]), settings["min_inclusion_ratio"]).first()
            why = "check_failed" if row is None else row["rejected"]
            if why:
                rejected[why] = rejected.get(why, 0) + 1
            else:
                found.append(document.hypothesis(len(found) + 1, p, row.asDict(), settings, a.record, b.record, left, right, op))
        return document.hypotheses(self.config, len(targets), every, open_pairs, evaluated, rejected, found)

    def _judge(self, tables: Sequence[Profiled], metrics: DataFrame, facts: DataFrame, roles: DataFrame) -> None:
        t = self.config["thresholds"]
        shapes = [s for x in tables for s in x.json_shapes]
        js = _local(self.spark, shapes, "table string, path string, eligible long, object long, array long, scalar long, json_null_literal long, invalid long") if shapes else None
        formats = [f for x in tables for f in x.formats]
        nullable = [{"table": x.record["table_key"], "path": n.display, "nullable": n.nullable} for x in tables for n in x.nodes]
        unique = [{"table": x.record["table_key"], "columns": k["columns"], "outcome": k["outcome"]} for x in tables for k in (x.record["uniqueness"] or {"keys": []})["keys"] if k["status"] == "measured"]
        found = judge.findings(facts, roles, t, js).orderBy("place", "nth").collect()
        rules = judge.rules(facts, roles, t, _local(self.spark, formats, judge.NO_FORMATS) if formats else None, _local(self.spark, unique, "table string, columns array<string>, outcome string"), _local(self.spark, nullable, "table string, path string, nullable boolean")).collect()
        asked = [c for x in tables for c in x.checks if x.metrics is not None]
        checks = judge.checks(facts, asked).orderBy("position").collect() if asked else []
        document.add_judgements(tables, found, rules, checks, asked, roles.collect(), {x.record["table_key"]: x.checks for x in tables})

    def profile(self, generation: Mapping[str, Any] | None = None, parameter_sources: Mapping[str, Any] | None = None) -> dict[str, Any]:
        names = self.config["tables"]

        def one(k: int) -> Profiled:
            self.log(f"({k + 1}/{len(names)}) profiling {names[k]}")
            return self.table(names[k])

        # a table's stages wait for planning more than for data: some tables go side by side
        with ThreadPoolExecutor(max(1, min(AT_ONCE, len(names)))) as pool:
            tables = list(pool.map(one, range(len(names))))
        frames = [t.metrics for t in tables if t.metrics is not None]
        metrics = _frozen(reduce(DataFrame.unionByName, frames)) if frames else None
        facts = roles = None
        if metrics is not None:
            scales = [{"table": t.record["table_key"], "path": n.display, "scale": n.scale} for t in tables for n in t.nodes if n.scale is not None]
            formats = [f for t in tables for f in t.formats]
            facts = _frozen(judge.facts(metrics))
            roles = _frozen(judge.roles(facts, self.config["thresholds"], _local(self.spark, formats, judge.NO_FORMATS) if formats else None, _local(self.spark, scales, "table string, path string, scale int") if scales else None))
        if self.level == "deep":
            self._uniqueness(tables, [r.asDict() for r in roles.collect()] if roles is not None else [])
        rels, referential_record = self._relationships(tables)
        hypotheses = self._hypotheses(tables, rels, metrics)
        if facts is not None and roles is not None and metrics is not None:
            self._judge(tables, metrics, facts, roles)
        else:
            document.add_judgements(tables, [], [], [], [], [], {t.record["table_key"]: t.checks for t in tables})
        finished = encoding.now()
        return document.profile(self, finished, [t.record for t in tables], rels, referential_record, hypotheses, generation or {}, parameter_sources or {}, environment(self.spark), self.can)


def profile(spark: SparkSession, config: Mapping[str, Any], opener: Opener | None = None, **more: Any) -> dict[str, Any]:
    """The profile document of a validated configuration; ``opener`` says how a table's name is read (catalog by default)."""
    return Run(spark, config, opener, **more).profile()


def metrics_frame(spark: SparkSession, source: Source, config: Mapping[str, Any], reference: dt.datetime | None = None) -> DataFrame:
    """The standard-level long metrics of one table, lazily."""
    nodes, _ = select(schema_tree(source.frame.schema, config["limits"]["max_depth"], config["limits"]["max_fields"]))
    return aggregate.measure(source.frame, plan_measures(nodes, config, reference or encoding.now()), source.key, "full_snapshot" if source.pinned else "full_table")


__all__ = ["Profiled", "Run", "metrics_frame", "profile"]
