"""Every query against its SQL on the smallest tables, and the shape of key plans."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, bag
from sheaf.plans import catalog
from sheaf.sources.tables import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = [tuple(row) for row in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert bag(columns, result.fetchall()) == bag(frame.columns, rows)


def test_document_steps_do_not_shuffle(spark):
    """Pages, chunks and vectors have no exchange but the one that deals out a one-split table,
    whole texts included; a table with splits enough has none."""
    for name in ("split_pages", "processed_text", "chunk_stride", "chunk_recursive", "embed_hashed", "postings"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert all("RoundRobinPartitioning" in line for line in exchanges), (name, exchanges)


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(catalog.QUERIES["bad_status"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
    rows = read_table(spark, f"{SF}/documents.parquet").filter("lang = 'en'").select("doc_id")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan_of(rows)


def test_entry_answers(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 8
