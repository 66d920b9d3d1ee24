"""The registered queries that have SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, bag
from sheaf.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    rows = [tuple(row) for row in frame.collect()]
    result = db.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert bag(columns, result.fetchall()) == bag(frame.columns, rows)


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
