"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(_plain(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
