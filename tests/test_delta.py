"""Versioned tables through a session that answers their statements; this environment has no such tables itself."""

import datetime as dt

import pytest

from profilekit.sources import tables


class Versioned:
    """A session of one table with two versions, and the statements it was asked."""

    def __init__(self, spark, provider="delta", refused=()):
        self.spark, self.provider, self.refused, self.asked = spark, provider, refused, []

    def rows(self, version):
        return self.spark.createDataFrame([(k,) for k in range(version)], "id long")

    def table(self, name):
        self.asked.append(name)
        return self.rows(9)

    def sql(self, statement, **_):
        self.asked.append(statement)
        if any(x in statement for x in self.refused):
            return self.spark.sql("SELECT * FROM a_table_that_is_not_there")
        at = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
        if statement.startswith("DESCRIBE TABLE EXTENDED"):
            found = [("id", "bigint", None), ("", "", None), ("# Detailed Table Information", "", None), ("Provider", self.provider, None), ("Type", "MANAGED", None), ("Statistics", "100 bytes, 9 rows", None)]
            return self.spark.createDataFrame(found, "col_name string, data_type string, comment string")
        if statement.startswith("DESCRIBE DETAIL"):
            return self.spark.createDataFrame([("delta", "x1", at, {"delta.constraints.positive": "id > 0", "other": "y"}, 3, 100)], "format string, id string, createdAt timestamp, properties map<string,string>, numFiles long, sizeInBytes long")
        if statement.startswith("DESCRIBE HISTORY"):
            return self.spark.createDataFrame([(7, at)], "version long, timestamp timestamp")
        return self.rows(int(statement.rsplit(" ", 1)[1]))


def test_a_version_is_pinned_and_read_again(spark):
    session = Versioned(spark)
    source = tables.open_table(session, "c.s.t")
    assert source.pinned and (source.version, source.version_time[:19]) == (7, "2024-05-06T07:08:09")
    assert source.frame.count() == 7 and tables.again(source, session).count() == 7
    assert "SELECT * FROM `c`.`s`.`t` VERSION AS OF 7" in session.asked
    assert [(c["name"], c["expression"]) for c in source.constraints] == [("positive", "id > 0")]
    assert source.detail["numFiles"] == 3 and source.detail["createdAt"].startswith("2024-05-06T07:08:09")
    assert tables.recorded_rows(source.metadata) == 9


@pytest.mark.parametrize("provider, pin, refused, rows", [("delta", False, (), 9), ("parquet", True, (), 9), ("delta", True, ("HISTORY",), 9), ("delta", True, ("DETAIL",), 7)])
def test_what_cannot_be_pinned_is_read_as_it_is(spark, provider, pin, refused, rows):
    session = Versioned(spark, provider, refused)
    source = tables.open_table(session, "s.t", pin=pin)
    assert source.frame.count() == rows == tables.again(source, session).count() and len(source.notes) == len(refused)
    assert any("DESCRIBE DETAIL" in x for x in session.asked) == (provider == "delta")
