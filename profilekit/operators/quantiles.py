"""Values at exact ranks, without sorting a table and without a task that holds its values.

A rank is narrowed to the bucket of values that holds it: first a 256th of a power of two, then a 65,536th of the last
bucket, until a bucket has one value or few enough rows to group by value. A step is one scan that counts buckets on the map
side; only buckets with a wanted rank are looked at again, and only these leave for the driver. At most 65,536 groups of a bucket
meet, whatever the size of the table: the second step leaves less than a 2^24th of a value's size, the third a 2^40th.
Types that hold more than doubles (long, decimal) are told apart in the last step.

The steps are jobs, run when the frame is made: each needs the last one's result as literals. Rows must be the same in each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above this accuracy a task's summary by ``percentile_approx`` may have tens of MB, and one task merges all of them.
SUMMARISED = 100_000
PARTS = 65_536
#: Ranks from 0, of ``p`` among ``total`` values: the least with a share of ``p`` at or below it; the neighbours of ``p * (total - 1)``.
RANKS = {"least": "greatest(ceil(p * total), 1L) - 1", "floor": "floor(p * (total - 1))", "ceil": "ceil(p * (total - 1))"}


def _by_size(x: Column) -> Column:
    """Buckets in the order of values, 256 for each power of two."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    within = F.floor((size / F.pow(F.lit(2.0), power) - 1) * 256)
    return F.when(F.isnan(x), 1e9).when(x == 0, 0.0).otherwise(F.signum(x) * F.when(size == float("inf"), 1e8).otherwise((power + 1100) * 256 + within))


def _local(df: DataFrame, rows: Sequence[Mapping[str, Any]], ddl: Mapping[str, str]) -> DataFrame:
    """A small frame out of literals, to be broadcast."""
    cells = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in ddl.items()]) for r in rows]
    return F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*cells))))


def at_ranks(df: DataFrame, columns: Mapping[str, str], probabilities: Sequence[float], kinds: Sequence[str] = ("least",)) -> dict[str, dict[tuple[float, str], tuple[Any, int]]]:
    """By name of ``columns`` (SQL of numbers), probability and kind of rank: the value there and how many values there are; empty without values."""
    names = list(columns)
    types = dict(df.selectExpr(*[f"{columns[n]} AS c{k}" for k, n in enumerate(names)]).dtypes)
    slots = {t: f"s{k}" for k, t in enumerate(dict.fromkeys(types.values()))}
    ends = [F.min(s).alias(f"lo_{s}") for s in slots.values()] + [F.max(s).alias(f"hi_{s}") for s in slots.values()]
    found: dict[str, dict[tuple[float, str], tuple[Any, int]]] = {n: {} for n in names}

    def members(some: Sequence[int], bucket: Mapping[int, Column]) -> DataFrame:
        """b, x and the value in its type's slot, a row a value."""
        cells = []
        for k in some:
            v = F.expr(columns[names[k]])
            own = {s: (v if types[f"c{k}"] == t else F.lit(None).cast(t)).alias(s) for t, s in slots.items()}
            cells.append(F.struct(bucket[k].cast("int").alias("b"), v.cast("double").alias("x"), *own.values()))
        return df.select(F.inline(F.array(*cells))).where(F.col("b").isNotNull() & F.col("x").isNotNull())

    def step(groups: DataFrame, order: Sequence[str], wanted: Sequence[Mapping[str, Any]], rank: str) -> list[dict[str, Any]]:
        """Of the groups of each bucket, those with a wanted rank."""
        within = Window.partitionBy("b")  # over groups, not rows
        ranked = groups.withColumn("total", F.sum("n").over(within)).withColumn("below", F.sum("n").over(within.orderBy(*order)) - F.col("n"))
        ddl = {"b": "int", "w": "int", "p": "double", "kind": "string", "r": "bigint"}
        near = ranked.join(_local(df, wanted, ddl), "b").withColumn("r", F.expr(rank)).where((F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("n")))
        return [r.asDict() for r in near.select("w", (F.col("r") - F.col("below")).alias("r"), "n", "total", *[f"{e}_{s}" for s in slots.values() for e in ("lo", "hi")]).collect()]

    wanted = [{"b": k, "f": k, "p": float(p), "kind": kind, "r": None} for k in range(len(names)) for p in probabilities for kind in kinds]
    for i, w in enumerate(wanted):
        w["w"] = i
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in RANKS.items()) + " END"
    groups = members(range(len(names)), {k: F.lit(k) for k in range(len(names))}).groupBy("b", _by_size(F.col("x")).alias("part")).agg(F.count(F.lit(1)).alias("n"), *ends)
    got = step(groups, ["part"], wanted, rank) if wanted else []
    totals = {r["w"]: r["total"] for r in got}
    while got:
        open_: list[dict[str, Any]] = []
        for r in got:
            w = wanted[r["w"]]
            slot = slots[types[f"c{w['f']}"]]
            lo, hi = r[f"lo_{slot}"], r[f"hi_{slot}"]
            if lo == hi or lo != lo:  # one value; NaN is one
                found[names[w["f"]]][w["p"], w["kind"]] = (lo, totals[r["w"]])
            else:
                open_.append(w | {"r": r["r"], "n": r["n"], "lo": float(lo), "hi": float(hi)})
        if not open_:
            break
        places = {at: b for b, at in enumerate(dict.fromkeys((w["f"], w["lo"], w["hi"]) for w in open_))}
        for w in open_:
            w["b"] = places[w["f"], w["lo"], w["hi"]]
        bucket: dict[int, Column] = {}
        for (k, lo, hi), b in places.items():
            inside = F.expr(columns[names[k]]).cast("double").between(lo, hi)
            bucket[k] = bucket[k].when(inside, b) if k in bucket else F.when(inside, b)
        few = {w["b"]: w["n"] <= PARTS or w["lo"] == w["hi"] for w in open_}
        b, x = F.col("b") + 1, F.col("x")
        of = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i)
        low, width = of([float(lo) for _, lo, _ in places], b), of([hi - lo or 1.0 for _, lo, hi in places], b)
        by_value = of([few[i] for i in range(len(places))], b)
        part = F.when(by_value, F.lit(0)).otherwise(F.least(F.floor((x - low) / width * PARTS), F.lit(PARTS - 1)))
        exact = {f"e_{s}": F.when(by_value, F.col(s)).alias(f"e_{s}") for s in slots.values()}
        groups = members(sorted(bucket), bucket).groupBy("b", part.alias("part"), *exact.values()).agg(F.count(F.lit(1)).alias("n"), *ends)
        got = step(groups, ["part", *exact], open_, "r")
    return found


def least_values(df: DataFrame, columns: Mapping[str, str], probabilities: Sequence[float]) -> dict[str, Column]:
    """What ``percentile_approx`` gives without an error, as literals: an array in the column's type, or null without values."""
    types = dict(df.selectExpr(*[f"{c} AS c{k}" for k, c in enumerate(columns.values())]).dtypes)
    found = at_ranks(df, columns, probabilities)
    out = {}
    for k, (name, at) in enumerate(found.items()):
        whole = f"array<{types[f'c{k}']}>"
        out[name] = F.array(*[F.lit(at[float(p), "least"][0]) for p in probabilities]).cast(whole) if at else F.lit(None).cast(whole)
    return out


def interpolated(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """What ``percentile`` gives: values between the neighbours of ``p * (n - 1)``."""
    found = at_ranks(df, {c: c for c in columns}, probabilities, ("floor", "ceil"))
    out: dict[str, list[float | None]] = {}
    for c, at in found.items():
        out[c] = []
        for p in map(float, probabilities):
            if not at:
                out[c].append(None)
                continue
            (low, n), (high, _) = at[p, "floor"], at[p, "ceil"]
            place = p * (n - 1)
            share = place - int(place)
            out[c].append(float(low) if low == high or not share else (1 - share) * float(low) + share * float(high))
    return out
