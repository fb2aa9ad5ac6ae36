"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from harrier.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    c = con.execute(ORACLES[name])
    names = [x[0] for x in c.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(c.fetchall(), key=repr)
