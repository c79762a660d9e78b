"""Every registered query that has SQL gives the same rows as the SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

PLANS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def test_registry():
    assert set(SQL) <= set(PLANS) and len(SQL) >= 80


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf, name):
    df = PLANS[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(SQL[name])
    assert compare(rows, df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) == "ok"
    assert rows


@pytest.mark.parametrize("name", ["j02_knn_lsh", "u22_confidence_bagging", "d13_random_projections", "s08_list_monitors"])
def test_rows_only(spark, sf, name):
    assert PLANS[name](spark, sf).count() > 0
