"""Every query with a SQL twin, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from treeloom import catalog, kernel_queries, queries  # noqa: F401  (both fill the catalog)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _key(x):
    return (0, "") if x is None else (1, f"{x:.9g}" if isinstance(x, float) else repr(x))


def compare(spark, db, build, sql):
    df = build(spark, SF)
    cur = db.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    got = sorted(tuple(map(_key, r)) for r in df.collect())
    assert got == sorted(tuple(_key(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    compare(spark, db, catalog.queries()[name], catalog.oracle_sql()[name])
