"""What the values of string fields look like: observed formats, concentration, examples.

All of it works on a frame of values (path, value, truncated), which holds a bounded sample of a table or a whole table
alike; counts are combined on the map side. Nothing but counts leaves, except examples of allow-listed fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.functions import detect
from profilekit.functions.access import column_at
from profilekit.plans.tree import Node


def sampled(df: DataFrame, nodes: Sequence[Node], sampling: Mapping[str, Any]) -> DataFrame:
    """At most ``max_rows`` rows with one struct (value, truncated) a field, and the bytes of what is kept.

    Values longer than ``max_value_chars`` are cut and marked. Rows count until ``max_bytes`` would be exceeded; the
    running total is over at most ``max_rows`` rows.
    """
    limit = sampling["max_value_chars"]
    source = df.sample(withReplacement=False, fraction=float(sampling["random_fraction"]), seed=sampling["seed"]) if sampling["method"] == "random" else df
    cells = [F.struct(F.substring(column_at(n.path), 1, limit).alias("value"), (F.length(column_at(n.path)) > limit).alias("truncated")).alias(f"s{k}") for k, n in enumerate(nodes)]
    kept = [F.when(F.col(f"s{k}.value").isNotNull() & ~F.col(f"s{k}.truncated"), F.octet_length(f"s{k}.value")).otherwise(0) for k in range(len(nodes))]
    rows = source.select(*cells).limit(sampling["max_rows"]).withColumn("bytes", sum(kept, F.lit(0)).cast("long")).withColumn("place", F.monotonically_increasing_id())
    so_far = F.sum("bytes").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", so_far <= sampling["max_bytes"]).drop("place")


def values_of(sample: DataFrame, nodes: Sequence[Node]) -> DataFrame:
    """(path, value, truncated) of a sample's retained rows."""
    cells = [F.struct(F.lit(n.display).alias("path"), F.col(f"s{k}.value").alias("value"), F.coalesce(F.col(f"s{k}.truncated"), F.lit(False)).alias("truncated")) for k, n in enumerate(nodes)]
    return sample.where("within").select(F.inline(F.array(*cells)))


def all_values(df: DataFrame, nodes: Sequence[Node]) -> DataFrame:
    """(path, value, truncated) of whole tables."""
    cells = [F.struct(F.lit(n.display).alias("path"), column_at(n.path).alias("value"), F.lit(False).alias("truncated")) for n in nodes]
    return df.select(F.inline(F.array(*cells)))


def whole(values: DataFrame) -> DataFrame:
    """Complete non-null values."""
    return values.where(F.col("value").isNotNull() & ~F.col("truncated"))


def counts(values: DataFrame) -> DataFrame:
    """One row a path: what is excluded, what is eligible, and how many values each detector matches."""
    v = F.col("value")
    complete = v.isNotNull() & ~F.col("truncated")
    eligible = complete & ~detect.blank(v)

    def n(condition: Column, name: str) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    found = [n(eligible & c, f"m_{name}") for name, c in detect.detectors(v).items()]
    return values.groupBy("path").agg(
        n(v.isNull(), "sql_null"), n(v.isNotNull() & F.col("truncated"), "truncated"), n(complete & detect.blank(v), "blank"), n(eligible, "eligible"), *found,
        n(eligible & detect.has_offset(v), "with_offset"), n(eligible & detect.stripped(v).rlike(r"^[{\[]"), "json_start"), n(complete, "complete"),
    )


def formats(counted: DataFrame, semantic: Mapping[str, Any]) -> DataFrame:
    """``counts`` with candidates (most matches first), status, format and reason.

    Blank values do not count. Several strong candidates are ambiguous, none but a partial one is mixed.
    """
    eligible = F.col("eligible")

    def candidate(k: int, name: str) -> str:
        low, high = detect.wilson(f"m_{name}", "eligible", semantic["confidence_level"])
        offset = "with_offset" if name == "iso_timestamp" else "CAST(NULL AS BIGINT)"
        return f"named_struct('o', -m_{name}, 'k', {k}, 'format', '{name}', 'matches', m_{name}, 'match_ratio', try_divide(m_{name}, eligible), 'low', {low}, 'high', {high}, 'with_offset', {offset})"

    every = ", ".join(candidate(k, name) for k, name in enumerate(detect.FORMATS))
    listed = F.transform(F.array_sort(F.filter(F.expr(f"array({every})"), lambda x: x["matches"] > 0)), lambda x: x.dropFields("o", "k"))
    out = counted.withColumn("candidates", listed).withColumn("strong", F.filter("candidates", lambda x: x["match_ratio"] >= semantic["detect_threshold"]))
    strong, best = F.size("strong"), F.get("candidates", F.lit(0))["match_ratio"]
    status = (
        F.when(eligible < semantic["min_observations"], "insufficient_data")
        .when(strong > 1, "ambiguous")
        .when(strong == 1, "detected")
        .when(best >= semantic["mixed_threshold"], "mixed")
        .otherwise("unknown")
    )
    reason = (
        F.when(F.col("status") == "insufficient_data", F.format_string(f"%d eligible observation(s); at least {semantic['min_observations']} required", eligible))
        .when(F.col("status") == "ambiguous", F.concat(F.lit("several formats match: "), F.concat_ws(", ", F.transform("strong", lambda x: x["format"]))))
        .when(F.col("status") == "mixed", "values match formats only partially")
    )
    return (
        out.withColumn("status", status)
        .withColumn("format", F.when(F.col("status") == "detected", F.get("strong", F.lit(0))["format"]))
        .withColumn("reason", reason)
        .withColumn("json_like", F.coalesce(F.col("json_start") / F.nullif(eligible, F.lit(0)) >= 0.5, F.lit(False)))
        .drop("strong", *[f"m_{f}" for f in detect.FORMATS])
    )


def concentration(values: DataFrame, top: int = 5) -> DataFrame:
    """path, observations, distinct values, share of the commonest and of the five commonest.

    The window keeps ``top`` rows a path, which Spark applies in each task before it shuffles.
    """
    by_value = whole(values).groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    total = by_value.groupBy("path").agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("distinct_count"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "value"))
    best = by_value.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("path").agg(F.max("n").alias("first"), F.sum("n").alias("some"))
    shares = [(F.col("first") / F.col("observations")).alias("top_1_share"), (F.col("some") / F.col("observations")).alias("top_5_share")]
    return total.join(best, "path").select("path", "observations", "distinct_count", *shares)


def examples(values: DataFrame, policy: Mapping[str, Any]) -> DataFrame:
    """path, value, sample_count, truncated: the most frequent values, ties by value. For allow-listed paths alone."""
    by_value = whole(values).groupBy("path", "value").agg(F.count(F.lit(1)).alias("sample_count"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("sample_count"), "value"))
    limit = policy["max_example_chars"]
    chosen = by_value.withColumn("nth", nth).where(F.col("nth") <= policy["max_examples_per_column"])
    return chosen.select("path", "nth", F.substring("value", 1, limit).alias("value"), "sample_count", (F.length("value") > limit).alias("truncated"))
