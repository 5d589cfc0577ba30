"""Exact distinct counts of the members of collections: one explode, two aggregations.

All members of a row become tagged structs with a typed slot a leaf and are exploded once; grouping by tag and slots
finds distinct values with a map-side combine, without an Expand for each leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.plans.registry import member_site
from profilekit.plans.tree import ORDERABLE, Node


def countable(nodes: Sequence[Node]) -> list[Node]:
    return [n for n in nodes if n.kind in ORDERABLE]


def member_distinct(df: DataFrame, leaves: Sequence[Node], max_elements: int | None = None, sample: Mapping[str, Any] | None = None) -> DataFrame:
    """path, members, non_null_members, distinct_count for each leaf; ``sample`` bounds rows, ``max_elements`` members."""
    if sample is not None:
        df = df.sample(withReplacement=False, fraction=float(sample["random_fraction"]), seed=sample["seed"]) if sample.get("method") == "random" else df
        df = df.limit(sample["max_rows"])
    slots = [f"s{k} {n.data_type.simpleString()}" for k, n in enumerate(leaves)]
    parts = []
    for k, n in enumerate(leaves):
        fields = ", ".join(f"'s{i}', " + ("x" if i == k else f"CAST(NULL AS {m.data_type.simpleString()})") for i, m in enumerate(leaves))
        parts.append(f"transform(COALESCE({member_site(n)['a']}, array()), x -> named_struct('leaf', {k}, {fields}))")
    one = f"CAST({{}} AS array<struct<leaf:int,{','.join(s.replace(' ', ':', 1) for s in slots)}>>)"
    flat = df.select(F.explode(F.concat(*[F.expr(one.format(p)) for p in parts])).alias("m")).select("m.*")
    if max_elements is not None:
        flat = flat.limit(max_elements)
    names = [f"s{k}" for k in range(len(leaves))]
    filled = F.coalesce(*[F.col(n).isNotNull() for n in names]) if len(names) == 1 else sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) > 0
    groups = flat.groupBy("leaf", *names).agg(F.count(F.lit(1)).alias("n")).withColumn("filled", filled)
    found = groups.groupBy("leaf").agg(F.sum("n").alias("members"), F.coalesce(F.sum(F.when(F.col("filled"), F.col("n"))), F.lit(0)).alias("non_null_members"), F.count_if("filled").alias("distinct_count"))
    listed = df.sparkSession.range(len(leaves)).select(F.col("id").cast("int").alias("leaf"), F.element_at(F.array(*[F.lit(n.display) for n in leaves]), (F.col("id") + 1).cast("int")).alias("path"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "non_null_members", "distinct_count")]
    return listed.join(F.broadcast(found), "leaf", "left").select("path", *zero)  # a row a leaf
