"""Every query runs at the smallest scale; those with a SQL twin are compared row by row."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import _rows
from workload.derived import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, SF)
    got = _rows(frame.columns, frame.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = database.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == _rows(columns, result.fetchall())
