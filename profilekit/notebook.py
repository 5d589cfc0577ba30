"""A self-contained notebook (source format): the package as an archive, the configuration, and cells that run them.

The archive holds this package without its tests and without subpackages that profiling does not import, byte for
byte reproducible, so the same configuration and version give the same file and the same generation id.
"""

from __future__ import annotations

import base64
import io
import json
import textwrap
import zipfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from profilekit import __version__, encoding

_CELL = "\n\n# COMMAND ----------\n\n"
_ROOT = Path(__file__).resolve().parent
LEFT_OUT = ("llm", "__pycache__")


def archive(root: Path = _ROOT) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            inner = path.relative_to(root)
            if not set(inner.parts) & set(LEFT_OUT):
                z.writestr(zipfile.ZipInfo(str(Path(root.name) / inner), (2020, 1, 1, 0, 0, 0)), path.read_bytes(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _markdown(text: str) -> str:
    return "\n".join("# MAGIC " + line for line in ["%md", *text.splitlines()])


def generate(config: Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    """(notebook, generation manifest)."""
    package = archive()
    digest = encoding.fingerprint(base64.b64encode(package).decode())
    generation_id = encoding.fingerprint({"config": config, "package": digest, "version": __version__})
    record = {"generation_id": generation_id, "tool_version": __version__, "package_digest": digest}
    literal = "\n".join(textwrap.wrap(base64.b64encode(package).decode(), 160))
    cells = [
        _markdown(f"# Data profile\n\nGenerated by profilekit {__version__}; generation {generation_id}. It reads tables with DESCRIBE and SELECT only and writes one result directory."),
        f'import base64, os, sys, tempfile\n\nPACKAGE = """\n{literal}\n"""\nplace = os.path.join(tempfile.mkdtemp(), "profilekit.zip")\nwith open(place, "wb") as f:\n    f.write(base64.b64decode(PACKAGE))\nsys.path.insert(0, place)',
        f"import json\n\nCONFIG = json.loads({json.dumps(json.dumps(config, sort_keys=True))})\nGENERATION = json.loads({json.dumps(json.dumps(record, sort_keys=True))})",
        'from profilekit.package import exit_value, run_package, widgets\n\nhost = globals().get("dbutils")\ngiven = widgets(host, CONFIG) if host is not None else {k: v for k, v in globals().get("PARAMETERS", {}).items()}',
        "profile, summary = run_package(spark, CONFIG, given, generation=GENERATION)",
        'value = exit_value(profile["run"]["effective_config"], summary)\nprint(value)\nif value is not None and host is not None:\n    host.notebook.exit(value)',
    ]
    source = "# Databricks notebook source\n" + _CELL.join(cells) + "\n"
    for cell in cells:
        if not cell.startswith("# MAGIC"):
            compile(cell, "<cell>", "exec")
    manifest = {"kind": "profilekit.generation", "manifest_version": "1.0", **record, "config_fingerprint": encoding.fingerprint(config), "notebook": {"file_name": None, "cells": len(cells), "bytes": len(source.encode()), "sha256": encoding.fingerprint(source)}}
    return source, manifest
