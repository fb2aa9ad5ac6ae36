import datetime as dt

import duckdb
import pytest

from harrier.llm import url_filters as m

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
CAPTURES = [
    (1, "https://a.b.example.com/x/y?q=1#f", DAY(10), "other"),
    (2, "https://a.b.example.com/x/y", DAY(5), None),
    (3, "https://a.b.example.com/x/y", DAY(20), None),
    (4, "http://user@EXAMPLE.com:80/", DAY(10), None),
    (5, None, DAY(10), None),
    (6, "not a url", DAY(10), None),
    (7, "https://b.example.com/z", None, None),
    (None, "https://b.example.com/z", DAY(10), None),
    (9, "", DAY(10), None),
    (1, "https://a.b.example.com/x/y?q=1#f", DAY(10), "again"),
    (10, "http://localhost/x", DAY(10), None),
]
ENTRIES = [
    ("d:example.com", DAY(0), "add", "allow"),
    ("d:b.example.com", DAY(6), "add", "block"),
    ("d:b.example.com", DAY(20), "remove", None),
    ("d:b.example.com", DAY(20), "add", "block"),
    ("p:a.b.example.com/x", DAY(10), "add", "allow"),
    ("p:a.b.example.com/x", DAY(11), "remove", "allow"),
    ("d:localhost", DAY(3), "add", "block"),
    (None, DAY(3), "add", "block"),
    ("d:example.com", None, "add", "block"),
    ("d:example.com", DAY(1), "rename", "block"),
]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_as_of(spark, broadcast):
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp, pattern string")
    entries = spark.createDataFrame(ENTRIES, "pattern string, listed_at timestamp, action string, verdict string")
    got = {(r.page_id, r.host): (r.verdict, r.pattern, r.n_active) for r in m.judge_captures(captures, entries, broadcast_rows=broadcast).collect()}
    assert got == {
        (1, "a.b.example.com"): ("allow", "p:a.b.example.com/x", 3),
        (2, "a.b.example.com"): ("allow", "d:example.com", 1),
        (3, "a.b.example.com"): ("allow", "d:example.com", 1),
        (4, "example.com"): ("allow", "d:example.com", 1),
        (5, ""): ("none", None, 0),
        (6, ""): ("none", None, 0),
        (7, "b.example.com"): ("none", None, 0),
        (None, "b.example.com"): ("block", "d:b.example.com", 2),
        (9, ""): ("none", None, 0),
        (10, "localhost"): ("block", "d:localhost", 1),
    }
    assert m.judge_captures(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in m.judge_captures(captures, entries.limit(0)).collect()} == {"none"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.sql(f"SELECT page_id, url, fetched_at, host, verdict, pattern, listed_at, n_active FROM ({m.ORACLE})").fetchall()
    got = [tuple(r) for r in m.op1_url_filters(spark, d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[4] for r in got} == {"block", "allow", "none"}


def test_addresses_and_deep_paths(spark):
    """An address covers itself alone; a path of any depth is met by listed prefixes, and ten thousand steps cost nothing."""
    deep = "/".join(["s"] * 10_000)
    captures = spark.createDataFrame([(1, "http://10.0.0.1/x", DAY(1)), (2, "http://[::1]:80/x", DAY(1)), (3, f"http://h.example.com/a/b/{deep}", DAY(1))], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("d:0.1", DAY(0), "add", "block"), ("d:10.0.0.1", DAY(0), "add", "allow"), ("d:[::1]", DAY(0), "add", "block"), ("p:h.example.com/a/b", DAY(0), "add", "block")], "pattern string, listed_at timestamp, action string, verdict string")
    got = {r.page_id: (r.host, r.verdict, r.n_active) for r in m.judge_captures(captures, entries).collect()}
    assert got == {1: ("10.0.0.1", "allow", 1), 2: ("[::1]", "block", 1), 3: ("h.example.com", "block", 1)}
