import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from harrier.llm import prefix_trie as m
from harrier.llm.prefix_trie import NODES, op13_prefix_trie, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, exchange):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    if not exchange:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows, exchange=True):
    members, ends, seqs = defaultdict(list), defaultdict(list), rebuilt(rows, exchange)
    for c, turns in sorted(seqs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = own + sum(saved[x] for x in children[p])
    out = []
    for p, cs in members.items():
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == NODES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, n):
    """Conversations that begin alike, copies, gaps among ids, null and repeated turns, ids without a base."""
    rnd = random.Random(seed)
    texts = ["", "a", "a b", "b  c\td", "ä ö\x0b", "x" * 500, None]
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 9, 17])):
            rows.append((c, None if rnd.random() < 0.03 else t, rnd.choice(["user", "user", "tool", None]), texts[0 if t < 3 and rnd.random() < 0.7 else rnd.randrange(7)]))
    rows += [r for r in rows if rnd.random() < 0.03]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,exchange", [(1, True), (2, False)])
def test_random(spark, monkeypatch, seed, exchange):
    monkeypatch.setattr(m, "PIECE", 3)
    monkeypatch.setattr(m, "SPAN", 4)
    rows = random_rows(seed, 120)
    assert got(prefix_trie(spark, spark.createDataFrame(rows, SCHEMA), exchange)) == brute(rows, exchange)


def test_hot_turn_and_one_long_conversation(spark, monkeypatch):
    """A third of all rows is one conversation, a third begins alike or is a copy."""
    monkeypatch.setattr(m, "SPAN", 16)
    rows = [(7, t, "user", f"w{t % 3} x") for t in range(300)]
    rows += [(1000 + c, t, "user", "the same") for c in range(100) for t in range(2 + (c % 10 == 0))]
    rows += [(5000 + 40 * c, t, "user", f"{c} {t}") for c in range(60) for t in range(4)]
    assert got(prefix_trie(spark, spark.createDataFrame(rows, SCHEMA), True)) == brute(rows)


def test_awkward(spark):
    """Nulls in any column, an empty and a very long text, ties, repeated rows, and columns whose names are used inside."""
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "a", "z"), (2, 5, "user", "word " * 300_000), (22, 5, "user", "word " * 300_000), (-3, 1, "user", "y"), (-20, 0, "user", "y")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", d int, name string, n int")
    assert got(prefix_trie(spark, df)) == brute(rows, False)
    once = {r[0] for r in got(prefix_trie(spark, df, exchange=True))}
    assert once <= {-20, -3, 1, 2, 22}


def test_empty(spark):
    assert prefix_trie(spark, spark.createDataFrame([], SCHEMA), True).count() == 0
    assert got(prefix_trie(spark, spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_turnless(spark):
    """Conversations whose turns are all exchanged for those of a base that is not there: members of the root alone."""
    rows = [(c, 0, "user", "hello") for c in range(21, 40)]
    assert got(prefix_trie(spark, spark.createDataFrame(rows, SCHEMA), True)) == brute(rows)


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert got(op13_prefix_trie(spark, sf)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(con.sql(m.ORACLE).fetchall(), key=repr) == want
