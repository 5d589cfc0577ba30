"""Whether the keys of one table are found in another; and pairs of columns for which that may be so.

Both sides are grouped by key before they meet, so neither a frequent foreign key nor a repeated target key is
moved row by row; the join runs on the partitioning of the groups. Only counts leave.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.operators.keys import any_null
from profilekit.plans.tree import Node, kind_of

COUNTS = ("source_rows", "source_rows_with_null_key", "source_rows_with_complete_key", "orphan_rows", "target_rows", "target_rows_with_null_key", "target_distinct_keys", "target_duplicate_key_groups")
#: Kinds that hypotheses are made of; decimals without a fraction only.
HYPOTHESIS_KINDS = ("integer", "decimal", "string", "date")
_NEVER = ("struct", "array", "map", "variant", "interval", "null", "other")


def compatible(a: T.DataType, b: T.DataType) -> tuple[bool, str]:
    """Whether two columns are compared by equality, and by which rule; there is no implicit conversion."""
    left, right = kind_of(a), kind_of(b)
    if left in _NEVER or right in _NEVER:
        return False, f"{left} and {right} values are not compared as keys"
    if left == right:
        return True, f"same type kind ({left})"
    if {left, right} == {"integer", "decimal"}:
        return True, "exact numbers (integer and decimal)"
    return False, f"{left} and {right} are not compared by equality (no implicit conversion)"


def _common(a: T.DataType, b: T.DataType) -> str | None:
    """A type that both are cast to before they are grouped, so that the join needs no further exchange."""
    left, right = kind_of(a), kind_of(b)
    if a == b:
        return None
    if left == right == "integer":
        return "bigint"
    if left == right == "float":
        return "double"
    if left in ("integer", "decimal") and right in ("integer", "decimal"):
        scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
        return f"decimal(38,{scale})"
    return None


def inclusion(source: DataFrame, source_key: Sequence[Column], target: DataFrame, target_key: Sequence[Column], sample: Mapping[str, Any] | None = None) -> DataFrame:
    """One row with ``COUNTS``. ``sample`` bounds the source rows, never the target.

    Source rows with a null part are never orphans; target rows with one never match.
    """
    k = range(len(source_key))
    left, right = source.select(*[c.alias(f"k{i}") for i, c in enumerate(source_key)]), target.select(*[c.alias(f"k{i}") for i, c in enumerate(target_key)])
    if sample is not None:
        left = left.sample(withReplacement=False, fraction=float(sample["random_fraction"]), seed=sample["seed"]) if sample.get("method") == "random" else left
        left = left.limit(sample["max_rows"])
    for i in k:
        if kind := _common(left.schema[i].dataType, right.schema[i].dataType):
            left, right = left.withColumn(f"k{i}", F.col(f"k{i}").cast(kind)), right.withColumn(f"k{i}", F.col(f"k{i}").cast(kind))
    names = [f"k{i}" for i in k]
    null = any_null([F.col(n) for n in names])
    s = left.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("z", null)
    t = right.groupBy(*names).agg(F.count(F.lit(1)).alias("tn")).withColumn("tz", null)
    met = s.join(t.where("not tz").select(*names, "tn"), names, "left")

    def total(what: Column, name: str) -> Column:
        return F.coalesce(F.sum(what), F.lit(0)).cast("long").alias(name)

    n, tn, z, tz = F.col("n"), F.col("tn"), F.col("z"), F.col("tz")
    ours = met.agg(total(n, "source_rows"), total(F.when(z, n), "source_rows_with_null_key"), total(F.when(~z, n), "source_rows_with_complete_key"), total(F.when(~z & tn.isNull(), n), "orphan_rows"))
    theirs = t.agg(total(tn, "target_rows"), total(F.when(tz, tn), "target_rows_with_null_key"), F.count_if(~tz).alias("target_distinct_keys"), F.count_if(~tz & (tn > 1)).alias("target_duplicate_key_groups"))
    return ours.crossJoin(theirs)  # one row each


def judged(counts: DataFrame, mode: str = "full_scope") -> DataFrame:
    """``counts`` with orphan_ratio, inclusion, status and whether the target key is unique.

    A full check validates or violates; a sample can only violate.
    """
    complete, orphans, distinct = F.col("source_rows_with_complete_key"), F.col("orphan_rows"), F.col("target_distinct_keys")
    status = F.when(complete == 0, "not_validated").when(orphans > 0, "violated").when(F.lit(mode == "sample"), "not_validated").otherwise("validated")
    return counts.select(
        "*", (orphans / F.nullif(complete, F.lit(0))).alias("orphan_ratio"), (complete - orphans).alias("included_rows"), ((complete - orphans) / F.nullif(complete, F.lit(0))).alias("inclusion_ratio"),
        F.when(distinct > 0, F.col("target_duplicate_key_groups") == 0).alias("target_key_unique"), status.alias("status"),
    )


# hypotheses


def hypothetical(node: Node) -> bool:
    return node.kind in HYPOTHESIS_KINDS and (node.kind != "decimal" or node.scale == 0)


def pairs(metrics: DataFrame, targets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidate (source, target) columns from measured metrics alone; names are no evidence.

    ``metrics``: long frames of all tables. ``targets``: (table, path) of keys measured exactly unique. ``known``:
    (from_table, from_path, to_table, to_path) that are relationships already. Gives from_*, to_*, kind, relation of the
    ranges (values; lengths for strings) and excluded ('known', 'disjoint' or NULL). Rows are as many as columns times keys.
    """
    low, high = F.max(F.when(F.col("metric").isin("min", "min_length"), F.struct("number", "value"))), F.max(F.when(F.col("metric").isin("max", "max_length"), F.struct("number", "value")))
    usable = metrics.where(F.col("path").isNotNull() & (F.col("status") == "measured") & ~F.col("path").rlike(r"\[\]|\{(key|value)\}") & F.col("kind").isin(*HYPOTHESIS_KINDS))
    facts = usable.groupBy("table", "path", "kind").agg(low.alias("low"), high.alias("high"), F.max(F.when(F.col("metric") == "non_null_count", F.col("number"))).alias("filled"), F.min("position").alias("place"))
    facts = facts.withColumn("class", F.when(F.col("kind").isin("integer", "decimal"), "number").otherwise(F.col("kind")))
    right = facts.join(targets.select("table", "path"), ["table", "path"], "left_semi")
    a, b = facts.alias("a"), right.alias("b")
    same = (F.col("a.table") == F.col("b.table")) & (F.col("a.path") == F.col("b.path"))
    met = a.join(b, (F.col("a.class") == F.col("b.class")) & ~same).where(F.coalesce(F.col("a.filled"), F.lit(1)) > 0)
    by = F.when(F.col("a.class") == "date", F.lit("value")).otherwise(F.lit("number"))

    def edge(side: str, end: str) -> Column:
        return F.when(by == "value", F.unix_date(F.col(f"{side}.{end}.value").try_cast("date")).cast("double")).otherwise(F.col(f"{side}.{end}.number"))

    unknown = edge("a", "low").isNull() | edge("a", "high").isNull() | edge("b", "low").isNull() | edge("b", "high").isNull()
    relation = (
        F.when(unknown, "not_compared")
        .when((edge("a", "high") < edge("b", "low")) | (edge("a", "low") > edge("b", "high")), "disjoint")
        .when((edge("b", "low") <= edge("a", "low")) & (edge("a", "high") <= edge("b", "high")), "contained")
        .otherwise("overlapping")
    )
    out = met.select(
        F.col("a.table").alias("from_table"), F.col("a.path").alias("from_path"), F.col("b.table").alias("to_table"), F.col("b.path").alias("to_path"),
        F.col("a.kind").alias("kind"), F.when(F.col("a.class") == "string", "lengths").otherwise("values").alias("range_basis"), relation.alias("range_relation"), F.col("a.place").alias("place"),
    )
    ends = ["from_table", "from_path", "to_table", "to_path"]
    seen = known.select(*ends, F.lit(True).alias("is_known")) if known is not None else None
    out = out.join(seen, ends, "left") if seen is not None else out.withColumn("is_known", F.lit(None).cast("boolean"))
    excluded = F.when(F.col("is_known"), "known").when(F.col("range_relation") == "disjoint", "disjoint")
    return out.withColumn("excluded", excluded).drop("is_known")


def rejection(judged_row: DataFrame, least: float) -> DataFrame:
    """Why a checked pair is no hypothesis: no source values, then a target that is not unique, then too few found."""
    reason = F.when(F.col("source_rows_with_complete_key") == 0, "no_source_values").when(~F.coalesce("target_key_unique", F.lit(False)), "target_not_unique").when(F.col("inclusion_ratio") < least, "below_threshold")
    return judged_row.withColumn("rejected", reason)
