"""JSON conventions: decimals and non-finite floats as strings, dates and times in ISO 8601."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
from typing import Any


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def pretty(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def fingerprint(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def short_hash(value: Any, length: int = 12) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:length]


def utc(moment: dt.datetime) -> str:
    if moment.tzinfo is None:
        raise ValueError("an instant needs a time zone")
    return moment.astimezone(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def decode(text: str | None, value_type: str | None) -> Any:
    """The JSON value of a metric from its text in the long frame."""
    if text is None or value_type is None:
        return None
    if value_type == "integer":
        return int(text)
    if value_type in ("float", "ratio"):
        number = float(text)
        return number if math.isfinite(number) else "NaN" if math.isnan(number) else "Infinity" if number > 0 else "-Infinity"
    if value_type == "boolean":
        return text == "true"
    if value_type == "quantiles":
        return json.loads(text)
    return text


_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
_URI = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://\S+")
_CONDITION = re.compile(r"\s*\[([A-Z][A-Z0-9_.]*)\]")


def safe_message(error: BaseException | str, limit: int = 500) -> str:
    """The first line of an engine's message without quoted values and addresses, which may hold data."""
    lines = str(error).strip().splitlines()
    return _URI.sub("<uri>", _QUOTED.sub("<value>", lines[0] if lines else ""))[:limit]


def error_record(stage: str, error: BaseException) -> dict[str, Any]:
    condition = _CONDITION.match(str(error))
    return {"stage": stage, "type": type(error).__name__, "condition": condition[1] if condition else None, "message": safe_message(error)}
