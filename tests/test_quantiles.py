"""Values at exact ranks against Spark's own aggregates, and that no task gets what grows with the table."""

import os

import pytest
from pyspark.sql import functions as F

from profilekit import queries
from profilekit.operators import quantiles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
P = (0.001, 0.05, 0.25, 0.5, 0.77, 0.95)
ODD = """SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN -exp((id % 1000) / 3) ELSE exp((id % 777) / 9.0D) * (1 + id / 1e9) END AS wide, CAST(id / 7 AS decimal(20,6)) AS dec, CAST(id % 7 AS int) AS few,
 1e15D + id * 0.125D AS near, CAST(id % 1009 AS float) / 3 AS real, CAST(NULL AS int) AS none, CASE id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -double('Infinity') ELSE 0 END AS odd FROM range(3000)"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_equal_percentiles(spark, monkeypatch):
    d = spark.sql(ODD).cache()
    want = d.agg(*[F.percentile(c, F.array(*map(F.lit, P))).alias(c) for c in d.columns]).first().asDict()
    least = d.agg(*[F.percentile_approx(c, F.array(*map(F.lit, P)), 1000000).alias(c) for c in d.columns if c != "odd"])
    for parts in (65536, 4):  # many rows a bucket as well
        monkeypatch.setattr(quantiles, "PARTS", parts)
        got = quantiles.interpolated(d, d.columns, P)
        assert {c: v for c, v in got.items() if c not in ("none", "odd")} == {c: pytest.approx(v, rel=1e-12) for c, v in want.items() if c not in ("none", "odd")}
        assert set(got["none"]) == {None} and want["none"] is None and list(map(repr, got["odd"])) == list(map(repr, want["odd"]))
        mine = spark.range(1).select(*[c.alias(n) for n, c in quantiles.least_values(d, {c: c for c in least.columns}, P).items()])
        assert mine.dtypes == least.dtypes and mine.first() == least.first()


def test_precise_quantiles_are_exact_above_doubles_and_merged_in_no_task(spark):
    d = spark.sql("SELECT 9007199254740993 + 2 * id AS big, repeat('x', int(id)) AS text FROM range(200)")
    frame = queries.long(d, ("quantiles", "length_quantiles"), config=queries.PRECISE)
    assert "percentile" not in plan(frame)
    points = {r["field"]: [] for r in queries._points(frame, "quantiles").union(queries._points(frame, "length_quantiles")).collect()}
    assert set(points) == {"big", "text"}
    raw = {r["path"]: r for r in frame.where("metric in ('quantiles', 'length_quantiles')").collect()}
    assert '"probability":0.5,"value":9007199254741191}' in raw["big"]["value"] and '"probability":0.5,"value":99}' in raw["text"]["value"]
    assert {r["accuracy"] for r in raw.values()} == {"exact"} and "values at exact ranks of lengths" == raw["text"]["method"]
    assert "percentile_approx" in plan(queries.long(d, ("quantiles",)))  # the default accuracy has small summaries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["judge_findings", "judge_rules"])
def test_judgements_merge_no_summaries(spark, name):
    assert "percentile" not in plan(queries.queries()[name](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_exact_quantiles_have_no_task_with_all_values(spark):
    assert "percentile" not in plan(queries.std_quantiles_exact(spark, SF))
