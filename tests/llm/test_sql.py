"""Queries against their SQL on the test tables."""

import os

import duckdb
import pytest

from tensorloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {cols} FROM ({queries.ORACLE_SQL[name]}) q").fetchall(), key=str)
