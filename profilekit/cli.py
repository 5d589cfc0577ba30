"""Command line: init, validate, generate, render, schema (all without Spark) and profile.

Exit codes: 0 done, 1 internal error, 2 wrong usage, 3 invalid input, 4 input or output cannot be used, 5 the profile's run is
partial, 6 it failed, 7 configured checks failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from profilekit import __version__, encoding
from profilekit.config import LEVELS, ConfigError, defaults, validated
from profilekit.contract.invariants import annotation_errors, profile_errors
from profilekit.contract.render import documents
from profilekit.contract.shapes import SHAPES
from profilekit.sources.sink import OutputExistsError, write_files

OK, INTERNAL, USAGE, INVALID, IO, PARTIAL, FAILED, CHECKS = range(8)


class CliError(Exception):
    def __init__(self, code: int, message: str, details: Sequence[str] = ()):
        super().__init__(message)
        self.code, self.details = code, list(details)


def _read(path: str) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise CliError(IO, f"cannot read {path!r}: {e.strerror}") from e
    except json.JSONDecodeError as e:
        raise CliError(INVALID, f"{path!r} is not JSON: {e.msg} (line {e.lineno}, column {e.colno})") from e


def _write(path: str, text: str, overwrite: bool) -> None:
    where = Path(path)
    try:
        write_files(str(where.parent), {where.name: text}, overwrite)
    except OutputExistsError as e:
        raise CliError(IO, f"{e} (--overwrite)") from e
    except OSError as e:
        raise CliError(IO, f"cannot write {path!r}: {e.strerror}") from e


def _config(path: str) -> dict[str, Any]:
    try:
        return validated(_read(path))
    except ConfigError as e:
        raise CliError(INVALID, f"configuration {path!r} is invalid", e.errors) from e


def _valid(path: str, errors: Any) -> Any:
    doc = _read(path)
    if bad := errors(doc):
        raise CliError(INVALID, f"{path!r} is invalid", bad)
    return doc


def init(a: argparse.Namespace) -> int:
    config = defaults() | {"tables": list(a.tables), "analysis_level": a.level, "output_dir": a.output_dir}
    try:
        validated(config)
    except ConfigError as e:
        raise CliError(INVALID, "that configuration is invalid", e.errors) from e
    _write(a.output, encoding.pretty(config), a.overwrite)
    print(f"Wrote {a.output}. Put no secrets into it.")
    return OK


def validate(a: argparse.Namespace) -> int:
    if a.config:
        c = _config(a.config)
        print(f"{a.config!r} is valid: {len(c['tables'])} table(s), level {c['analysis_level']}.")
        return OK
    if a.annotations:
        doc = _valid(a.annotations, annotation_errors)
        print(f"{a.annotations!r} is valid: {len(doc.get('tables', {}))} table(s).")
        return OK
    p = _valid(a.profile, profile_errors)
    run, checks = p["run"], p["summary"]["checks"]
    print(f"{a.profile!r} is valid. Run {run['run_id']} of {run['started_at']}: {run['status']}; checks: " + ", ".join(f"{n} {s.replace('_', ' ')}" for s, n in checks.items()) + ".")
    if run["status"] != "succeeded":
        return FAILED if run["status"] == "failed" else PARTIAL
    return CHECKS if a.fail_on_check_failures and checks["fail"] else OK


def generate(a: argparse.Namespace) -> int:
    from profilekit.notebook import generate as make

    source, manifest = make(_config(a.config))
    manifest["notebook"]["file_name"] = Path(a.output).name
    beside = a.manifest or str(Path(a.output).with_suffix("")) + ".generation.json"
    for path in (a.output, beside):
        if Path(path).exists() and not a.overwrite:
            raise CliError(IO, f"{path!r} already exists (--overwrite)")
    _write(a.output, source, True)
    _write(beside, encoding.pretty(manifest), True)
    print(f"Wrote {a.output} ({manifest['notebook']['cells']} cells) and {beside}; generation {manifest['generation_id']}.")
    return OK


def render(a: argparse.Namespace) -> int:
    p = _valid(a.input, profile_errors)
    notes = _valid(a.annotations, annotation_errors) if a.annotations else None
    made = documents(p, notes)
    try:
        write_files(a.output, made, a.overwrite)
    except OutputExistsError as e:
        raise CliError(IO, f"{e} (--overwrite)") from e
    except OSError as e:
        raise CliError(IO, f"cannot write to {a.output!r}: {e.strerror}") from e
    print(f"Rendered {len(made)} file(s) into {a.output} from run {p['run']['run_id']}; nothing was measured again.")
    return OK


def schema(a: argparse.Namespace) -> int:
    text = encoding.pretty(SHAPES[a.name])
    if a.output:
        _write(a.output, text, a.overwrite)
    else:
        sys.stdout.write(text)
    return OK


def profile(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from profilekit.package import run_package
    from profilekit.sources.tables import at_path

    spark = SparkSession.builder.getOrCreate()
    paths = dict(x.split("=", 1) for x in a.path)
    opener = (lambda name: at_path(spark, paths[name], a.format, name)) if paths else None
    given = {"tables_json": json.dumps(sorted(paths))} if paths else {}
    given |= {"output_dir": a.output_dir} if a.output_dir else {}
    try:
        result, summary = run_package(spark, _config(a.config), given, opener)
    except ConfigError as e:
        raise CliError(INVALID, "the run cannot start", e.errors) from e
    print(f"Results: {summary['run_dir']}")
    return {"succeeded": OK, "partial": PARTIAL, "failed": FAILED}[result["run"]["status"]]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="profilekit", description="Profiles tables with Spark.")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Any, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.set_defaults(run=run)
        c.add_argument("--overwrite", action="store_true")
        return c

    c = command("init", init, "write a configuration with all defaults")
    c.add_argument("--output", default="profilekit.json")
    c.add_argument("--tables", nargs="*", default=[])
    c.add_argument("--level", choices=LEVELS, default="standard")
    c.add_argument("--output-dir", default="")
    c = command("validate", validate, "check a configuration, a profile or annotations")
    which = c.add_mutually_exclusive_group(required=True)
    for name in ("config", "profile", "annotations"):
        which.add_argument(f"--{name}")
    c.add_argument("--fail-on-check-failures", action="store_true")
    c = command("generate", generate, "write a self-contained notebook")
    c.add_argument("--config", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--manifest")
    c = command("render", render, "write documents from a profile")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--annotations")
    c = command("schema", schema, "show a document's JSON Schema")
    c.add_argument("name", choices=sorted(SHAPES))
    c.add_argument("--output")
    c = command("profile", profile, "profile catalog tables, or files given as name=path")
    c.add_argument("--config", required=True)
    c.add_argument("--path", action="append", default=[], metavar="NAME=PATH")
    c.add_argument("--format", default="parquet")
    c.add_argument("--output-dir")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        return args.run(args)
    except CliError as e:
        print("\n".join([f"error: {e}", *(f"  - {d}" for d in e.details)]), file=sys.stderr)
        return e.code
    except Exception as e:  # noqa: BLE001 - a stable exit code for anything unforeseen
        print(f"internal error: {type(e).__name__}: {encoding.safe_message(e)}", file=sys.stderr)
        return INTERNAL
