"""A run from parameters to a written result package."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from profilekit import encoding
from profilekit.config import ConfigError, execution_errors, parameter_defaults, with_parameters
from profilekit.contract.invariants import profile_errors
from profilekit.contract.render import documents
from profilekit.runner import Log, Opener, Run
from profilekit.sources import sink

PARAMETERS = ("tables_json", "analysis_level", "output_dir", "config_json")


def widgets(dbutils: Any, config: Mapping[str, Any]) -> dict[str, str]:
    """Parameters of a hosted notebook: text fields with the configuration's defaults; fields that exist keep their values."""
    for name, default in parameter_defaults(config).items():
        try:
            dbutils.widgets.get(name)
        except Exception:  # noqa: BLE001 - the host's error for a field that does not exist
            dbutils.widgets.text(name, default)
    return {name: dbutils.widgets.get(name) for name in PARAMETERS}


def describe_plan(config: Mapping[str, Any]) -> list[str]:
    """What a run will do, before it reads anything."""
    level, deep, limits = config["analysis_level"], config["deep"], config["limits"]
    out = [f"level {level}, {len(config['tables'])} table(s)"]
    if level != "metadata":
        out += [f"sample: {config['sampling']['method']}, at most {config['sampling']['max_rows']} rows and {config['sampling']['max_bytes']} bytes a table", f"aggregation: at most {limits['max_aggregate_passes']} pass(es) of {limits['max_expressions_per_pass']} expressions a table"]
    if level == "deep":
        out += [
            f"deep: at most {deep['max_extra_passes']} more pass(es) a table; member distinct counts: {deep['element_distinct']}", f"keys: at most {deep['uniqueness']['max_keys']} in {deep['uniqueness']['max_passes']} pass(es) a table",
            f"relationships: at most {deep['referential']['max_relationships']} check(s)", f"hypotheses: {'at most %d pair(s)' % deep['relationship_hypotheses']['max_pairs'] if deep['relationship_hypotheses']['enabled'] else 'off'}",
        ]
    return [*out, "physical scans, bytes read and cost are not predicted"]


def summary_text(profile: Mapping[str, Any]) -> str:
    run, s = profile["run"], profile["summary"]
    lines = [f"Run {run['run_id']}: {run['status']} ({s['tables_succeeded']} succeeded, {s['tables_partial']} partial, {s['tables_failed']} failed)"]
    lines += [f"  {t['table_key']}: {t['status']}, {len(t['findings'])} finding(s), {sum(c['status'] == 'fail' for c in t['quality_checks'])} failed check(s)" for t in profile["tables"]]
    return "\n".join(lines)


def run_package(spark: SparkSession, config: Mapping[str, Any], given: Mapping[str, str] | None = None, opener: Opener | None = None, generation: Mapping[str, Any] | None = None, log: Log = print) -> tuple[dict[str, Any], dict[str, Any]]:
    """(profile, job summary). The destination is tried, with a "running" manifest, before any table is read."""
    effective, sources = with_parameters(config, given or {})
    if problems := execution_errors(effective):
        raise ConfigError("the run cannot start", problems)
    run = Run(spark, effective, opener, log)
    generation_id = (generation or {}).get("generation_id")
    run_dir = os.path.join(effective["output_dir"], run.run_id)
    first = {"run_id": run.run_id, "started_at": encoding.utc(run.started)}
    sink.write_files(run_dir, {"manifest.json": encoding.pretty(sink.manifest(first, "running", {}, None, generation_id))})
    for line in describe_plan(effective):
        log(line)
    profile = run.profile(generation, sources)
    errors = profile_errors(profile)
    files = sink.as_files(profile, documents(profile))
    sink.write_files(run_dir, files)
    sink.write_files(run_dir, {"manifest.json": encoding.pretty(sink.manifest(profile["run"], profile["run"]["status"], files, errors, generation_id))}, replaceable=("manifest.json",))
    log(summary_text(profile))
    return profile, sink.job_summary(profile, run_dir, errors)


def exit_value(config: Mapping[str, Any], summary: Mapping[str, Any]) -> str | None:
    """What a hosted notebook returns to the job that ran it."""
    return json.dumps(summary, sort_keys=True) if config["jobs"]["exit_summary"] else None
