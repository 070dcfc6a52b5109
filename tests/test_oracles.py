"""Every registered query with SQL must equal that SQL, row for row, on the shared data."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as contract
from cartlake.oracles import ORACLES
from cartlake.registry import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for view in VIEWS:
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert _canonical(got.columns, got.collect()) == _canonical(columns, want.fetchall())


def test_queries_leave_the_session_as_it_is(spark):
    before = dict(spark.conf.getAll)
    for name in ("account_alerts_stream", "container_log"):
        contract.queries()[name](spark, FOLDER).count()
    assert dict(spark.conf.getAll) == before


def test_entry_is_the_flagship_query(spark):
    result = contract.entry(spark)
    assert result.columns == ["country", "product_name", "total_sales", "total_quantity", "avg_rating",
                              "customer_count", "male_percent", "female_percent"]
    assert result.count() >= 10
