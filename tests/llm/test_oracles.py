"""The operators' queries against their SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from parley.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = engine.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, want))
