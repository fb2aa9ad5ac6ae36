"""Every query with SQL against DuckDB, row by row; the others run."""

import decimal

import duckdb
import pytest

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in e.catalogue.QUERIES)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = e.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in e.oracle_sql():
        c = duck.execute(e.oracle_sql()[name])
        names = [x[0] for x in c.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(x)]) for x in cols) for r in c.fetchall()), key=repr)


def test_entry(spark):
    assert e.entry(spark).count() > 0
