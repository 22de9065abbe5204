"""Every registered query runs on the smallest tables; those with SQL twins agree with them."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if value is None or pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "__float__"):
        return f"{float(value):.6g}"
    return str(list(value)) if hasattr(value, "tolist") else str(value)


def rows(frame):
    return sorted(tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert SQL.keys() <= QUERIES.keys()
