"""Every registered query against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks import queries as registered
from checks.inputs import TABLES

FOLDER = os.environ.get("LOREKEEP_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registered.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    answer = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(answer.columns)
    place = [answer.columns.index(column) for column in columns]
    key = lambda row: tuple((value is None, str(value)) for value in row)
    got = sorted((tuple(row[column] for column in columns) for row in df.collect()), key=key)
    want = sorted((tuple(row[at] for at in place) for row in answer.fetchall()), key=key)
    assert got == want


def test_no_query_pairs_rows_without_a_key(spark):
    queries = entry.queries()
    for name in registered.QUERIES:
        query = queries[name]
        if name in ("history_stream", "history_stream_idle", "ingest_stream", "ingest_documents", "ingest_twice", "ingest_report"):
            continue
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        # A window over everything may only number the partitions of the id assignment.
        assert name == "chunk_ids" or "windowspecdefinition(_part" not in plan, name


def test_entry(spark):
    assert entry.entry(spark).count() == 30
