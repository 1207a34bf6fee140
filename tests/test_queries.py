"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    text = lambda rows: sorted((tuple("" if v is None else str(v) for v in r) for r in rows))
    cur = con.execute(SQL[name])
    order = [[x[0] for x in cur.description].index(c) for c in columns]
    assert text(df.select(*columns).collect()) == text([[r[i] for i in order] for r in cur.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
