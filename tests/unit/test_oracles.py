"""Every query of the catalogue against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from parley.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return made


def plain(row):
    return tuple("~" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    assert rows or name in ("dup_ids", "top_confusion_pairs")
    want = engine.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(plain, rows)) == sorted(map(plain, want))
