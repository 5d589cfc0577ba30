"""Where frames come from: catalog tables and views, snapshots of Delta tables, and files at a path.

Only DESCRIBE and SELECT are ever sent. A path has no catalog entry: its schema is the frame's, and its metadata are
``unavailable``. The Delta parts are written to Delta's documented interface; this environment has no Delta to test them on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit import identifiers as ids
from profilekit.encoding import safe_message

FORMATS = ("parquet", "orc", "json", "csv", "avro", "text", "delta")
_STATISTICS = re.compile(r"(\d+)\s+bytes(?:,\s*(\d+)\s+rows)?")


@dataclass
class Source:
    """A readable table; ``frame`` is the same snapshot each time where one could be pinned."""

    name: str
    parts: list[str]
    frame: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    detail: dict[str, Any] = field(default_factory=dict)
    version: int | None = None
    version_time: str | None = None
    constraints: list[dict[str, Any]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    is_path: bool = False

    @property
    def key(self) -> str:
        return ids.table_key(self.parts)

    @property
    def lookup(self) -> str:
        return ids.lookup_key(self.parts)

    @property
    def pinned(self) -> bool:
        return self.version is not None


def at_path(spark: SparkSession, path: str, fmt: str = "parquet", name: str | None = None, **options: str) -> Source:
    """Files at ``path``; ``name`` is how documents call them."""
    frame = spark.read.format(fmt).options(**options).load(path)
    name = name or re.sub(r"\.\w+$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return Source(name, [name], frame, {"Type": None, "Provider": fmt}, notes=["Read from a path: there is no catalog metadata."], is_path=True)


def describe_extended(spark: SparkSession, quoted: str) -> dict[str, str]:
    """The entries below the detail marker; empty for views without one."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted}").select("col_name", "data_type").collect()
    names = [r["col_name"] for r in rows]
    start = next((k for k, n in enumerate(names) if n in ("# Detailed Table Information", "# Detailed View Information")), len(rows))
    return {r["col_name"]: r["data_type"] for r in rows[start + 1 :] if r["col_name"] and not r["col_name"].startswith("#")}


def describe_detail(spark: SparkSession, quoted: str) -> dict[str, Any]:
    row = spark.sql(f"DESCRIBE DETAIL {quoted}")
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(c) if row.schema[c].dataType.typeName() == "timestamp" else F.col(ids.quote(c)) for c in row.columns]
    return row.select(*times).first().asDict(recursive=True)


def check_constraints(detail: dict[str, Any]) -> list[dict[str, Any]]:
    prefix = "delta.constraints."
    found = sorted((k, v) for k, v in (detail.get("properties") or {}).items() if k.startswith(prefix))
    return [{"name": k.removeprefix(prefix), "constraint_type": "check", "columns": [], "expression": v, "referenced": None, "enforcement": "enforced", "source": "table_properties"} for k, v in found]


def latest_version(spark: SparkSession, quoted: str) -> tuple[int, str]:
    row = spark.sql(f"DESCRIBE HISTORY {quoted} LIMIT 1").select("version", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at")).first()
    return int(row["version"]), row["at"]


def recorded_rows(metadata: dict[str, Any]) -> int | None:
    found = _STATISTICS.search(metadata.get("Statistics") or "")
    return int(found[2]) if found and found[2] else None


def open_table(spark: SparkSession, text: str, pin: bool = True) -> Source:
    """A catalog table or view by name. Metadata that cannot be read become notes, not failures."""
    parts = ids.parse_table(text)
    quoted, source = ids.quote_table(parts), None
    notes: list[str] = []

    def attempt(what: str, read: Any, default: Any) -> Any:
        try:
            return read()
        except PySparkException as e:
            notes.append(f"{what}: {safe_message(e)}")
            return default

    frame = spark.table(quoted)
    metadata = attempt("describe", lambda: describe_extended(spark, quoted), {})
    source = Source(text, parts, frame, metadata, notes=notes)
    if (metadata.get("Provider") or "").lower() == "delta":
        source.detail = attempt("detail", lambda: describe_detail(spark, quoted), {})
        source.constraints += check_constraints(source.detail)
        if pin:
            source.version, source.version_time = attempt("history", lambda: latest_version(spark, quoted), (None, None))
        if source.version is not None:
            source.frame = spark.sql(f"SELECT * FROM {quoted} VERSION AS OF {source.version}")
    return source


def again(source: Source, spark: SparkSession) -> DataFrame:
    """The same rows for a later check: the recorded version, or the source's current state."""
    if source.is_path or not source.pinned:
        return source.frame
    return spark.sql(f"SELECT * FROM {ids.quote_table(source.parts)} VERSION AS OF {source.version}")


def environment(spark: SparkSession) -> dict[str, Any]:
    import platform

    from profilekit import __version__

    def conf(name: str) -> str | None:
        return attempt(lambda: spark.conf.get(name))

    def attempt(read: Any) -> Any:
        try:
            return read()
        except Exception:  # noqa: BLE001 - a setting that this runtime hides
            return None

    return {
        "spark_version": spark.version, "python_version": platform.python_version(), "tool_version": __version__, "session_time_zone": conf("spark.sql.session.timeZone"),
        "ansi_enabled": conf("spark.sql.ansi.enabled"), "connection": "connect" if "connect" in type(spark).__module__ else "classic",
    }


def capabilities(spark: SparkSession) -> dict[str, bool]:
    """Functions that plans may use, by what they are for."""
    exists = spark.catalog.functionExists
    variant = ("try_parse_json", "try_variant_get", "is_variant_null", "schema_of_variant")
    return {
        "try_parse_json": exists("try_parse_json"), "variant_functions": all(map(exists, variant)), "get_json_object": exists("get_json_object"),
        "higher_order_functions": exists("transform") and exists("filter"), "parameterized_sql": spark.sql("SELECT :x AS x", args={"x": 1}).columns == ["x"],
    }


def json_method(can: dict[str, bool]) -> str | None:
    return "variant" if can["variant_functions"] else "get_json_object" if can["get_json_object"] else None
