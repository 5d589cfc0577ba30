"""Every query with SQL, against an independent engine on the same files."""

import os

import pytest

from profilekit import queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    frame = queries.queries()[name](spark, SF)
    got = engine.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in got.description]
    assert sorted(frame.columns) == sorted(theirs)
    assert {str(d[1]) for d in got.description} <= {"BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN"} and {t for _, t in frame.dtypes} <= {"bigint", "double", "string", "boolean"}
    assert rows(frame.columns, map(tuple, frame.collect())) == rows(theirs, got.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in set(queries.queries()) - set(queries.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() > 0
