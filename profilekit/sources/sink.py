"""The only sink: files of a result package in one directory, which never replace others unasked."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Collection, Mapping
from pathlib import Path
from typing import Any

from profilekit import __version__, encoding
from profilekit.contract.document import SCHEMA_VERSION

DOCUMENTS = ("overview.md", "data_dictionary.md", "quality_report.md", "relationships.md", "erd.mmd", "suggested_rules.json")


class OutputExistsError(FileExistsError):
    pass


def write_files(directory: str, files: Mapping[str, str], overwrite: bool = False, replaceable: Collection[str] = ()) -> list[str]:
    """All files or, if one exists already, none."""
    for name in files:
        if os.sep in name or name.startswith(".."):
            raise ValueError(f"invalid file name {name!r}")
    top = Path(directory)
    if not overwrite and (there := [n for n in files if n not in replaceable and (top / n).exists()]):
        raise OutputExistsError(f"{top / there[0]} already exists; choose another directory or allow overwriting")
    top.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (top / name).write_text(content, encoding="utf-8", newline="\n")
    return [str(top / n) for n in files]


def manifest(run: Mapping[str, Any], status: str, files: Mapping[str, str], errors: list[str] | None, generation_id: str | None) -> dict[str, Any]:
    """Before a run (status ``running``, no files) and after it."""
    listed = [{"path": n, "sha256": "sha256:" + hashlib.sha256(files[n].encode()).hexdigest(), "bytes": len(files[n].encode())} for n in sorted(files)]
    return {
        "kind": "profilekit.run_manifest", "manifest_version": "1.0", "run_id": run["run_id"], "status": status, "tool_version": __version__, "profile_schema_version": SCHEMA_VERSION, "started_at": run["started_at"], "finished_at": run.get("finished_at"), "generation_id": generation_id,
        "files": listed, "profile_validation": {"checked": errors is not None, "valid": None if errors is None else not errors, "errors": list(errors or [])[:50]},
        "notes": ["The run is going on or was cut off before its results were written."] if status == "running" else ["profile.json is the source of all other files; `render` makes them again."],
    }


def job_summary(profile: Mapping[str, Any], run_dir: str, errors: list[str] | None) -> dict[str, Any]:
    """Counts whose size does not grow with the number of tables."""
    run, s = profile["run"], profile["summary"]
    return {
        "kind": "profilekit.job_summary", "summary_version": "1.0", "tool_version": __version__, "run_id": run["run_id"], "status": run["status"], "analysis_level": run["analysis_level"], "run_dir": run_dir, "profile_valid": not errors,
        "tables": {k: s[f"tables_{k}"] for k in ("total", "succeeded", "partial", "failed")}, "checks": dict(s["checks"]), "relationships": dict(s["relationships"]), "relationship_hypotheses": s["relationship_hypotheses"],
    }


def as_files(profile: Mapping[str, Any], documents: Mapping[str, str]) -> dict[str, str]:
    return {"profile.json": encoding.pretty(profile), **documents}
