"""Format detectors and confidence intervals, all inside Catalyst."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns of the formats that values are tested for.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEANS = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(:\d{2})?)([.,]\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)?$"
URL = r"^(?i)(https?|ftp)://[^\s/?#]+[^\s]*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
FORMATS = ("json_object", "json_array", "uuid", "numeric_string", "boolean_string", "iso_date", "iso_timestamp", "url", "email_candidate")
#: All white space that Unicode knows, as trimming in most languages does.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def blank(c: Column) -> Column:
    return c.rlike(f"^{_BLANK}*$")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def json_root(c: Column) -> Column:
    """The kind of a text's JSON root: object, array, string, number, boolean, null; NULL where it is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(stripped(c)))
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "VOID", "null")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.isNotNull(), "number")
    )


def is_timestamp(c: Column) -> Column:
    """Pattern first, then whether calendar, clock and offset exist."""
    day, clock, offset = (F.regexp_extract(c, TIMESTAMP, k) for k in (1, 2, 5))
    full = F.concat(day, F.lit(" "), F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    digits = F.regexp_replace(offset, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    good = (digits == "") | ((hours < 24) & (F.coalesce(minutes, F.lit(0)) < 60))
    return c.rlike(TIMESTAMP) & F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull() & good


def has_offset(c: Column) -> Column:
    return is_timestamp(c) & (F.regexp_extract(c, TIMESTAMP, 5) != "")


def detectors(c: Column) -> dict[str, Column]:
    """Whether a value is of each format; JSON is tried only where a text starts like it."""
    root = F.when(stripped(c).rlike(r"^[{\[]"), json_root(c))
    return {
        "json_object": F.coalesce(root == "object", F.lit(False)),
        "json_array": F.coalesce(root == "array", F.lit(False)),
        "uuid": c.rlike(UUID),
        "numeric_string": c.rlike(NUMERIC),
        "boolean_string": F.lower(c).isin(*BOOLEANS),
        "iso_date": c.rlike(DATE) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(),
        "iso_timestamp": is_timestamp(c),
        "url": c.rlike(URL),
        "email_candidate": (F.length(c) <= 254) & c.rlike(EMAIL),
    }


def wilson(successes: str, trials: str, level: float) -> tuple[str, str]:
    """Wilson's score interval of a share, as SQL over two columns; NULL without trials."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n = f"CAST({trials} AS DOUBLE)"
    p = f"({successes} / {n})"
    below = f"(1 + {z * z!r}D / {n})"
    middle = f"({p} + {z * z / 2!r}D / {n}) / {below}"
    half = f"{z!r}D * sqrt({p} * (1 - {p}) / {n} + {z * z / 4!r}D / ({n} * {n})) / {below}"
    return tuple(f"CASE WHEN {trials} > 0 THEN {edge} END" for edge in (f"greatest(0D, {middle} - {half})", f"least(1D, {middle} + {half})"))
