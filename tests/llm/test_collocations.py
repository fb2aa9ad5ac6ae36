import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from harrier.llm import collocations as m
from harrier.llm.collocations import collocations, op11_collocations

LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, top=2000, least=30, share=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, 5):
                f[lang].update(tuple(w[i : i + s]) for i in range(len(w) - s + 1))
    out = []
    for lang, c in f.items():
        longer, found = Counter(), []
        frequent = {g: a for g, a in c.items() if a >= least}
        for g, a in frequent.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    longer[g[i : i + s]] = max(longer[g[i : i + s]], a)
        for g, a in frequent.items():
            if len(g) > 1 and not (longer[g] and 100 * longer[g] >= share * a):
                score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b", "B", "c\x01", "c", "é", "日本", "x\xa0y", "-", "d", "\x1fz"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ?"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randint(0, 60)))
    rows = [(i, text(), rnd.choice(["en", "de", None, "und", ""])) for i in range(n)]
    fixed = "one two three four. one two three. the same the same the same"
    return rows + [(1000 + i, fixed, "en") for i in range(40)]


@pytest.mark.parametrize("seed,batch", [(1, 6 << 20), (2, 200)])
def test_random(spark, monkeypatch, seed, batch):
    """Many small batches and partitions: words, batches and runs that end anywhere."""
    monkeypatch.setattr(m, "BATCH_BYTES", batch)
    monkeypatch.setattr(m, "RANGE", batch)
    rows = random_rows(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations(spark, df, least=3)) == brute(rows, least=3)
    assert got(collocations(spark, df, top=3, least=5, share=50)) == brute(rows, 3, 5, 50)


def halves(keys):
    return np.array([(a << 32 | b, c << 32 | d) for a, b, c, d in keys], np.uint64).reshape(-1, 2)


def test_runs_over_range_ends(monkeypatch):
    """Sorted keys cut into ranges and blocks anywhere: whole runs and parts together are the counts."""
    monkeypatch.setattr(m, "MERGED", 9)
    rnd = random.Random(4)
    for _ in range(200):
        ids = [(rnd.randint(1, 3), rnd.randint(1, 2), rnd.randint(0, 2), rnd.randint(0, 2)) for _ in range(rnd.randint(0, 60))]
        keys = [(a, b, c, c and d) for a, b, c, d in ids]
        counts = [rnd.randint(1, 4) for _ in keys]
        want = Counter()
        for k, c in zip(keys, counts):
            for s in (2, 3, 4):
                if k[s - 1]:
                    want[np.array(k[:s] + (0,) * (4 - s), ">u4").tobytes(), s] += c
        bounds = m.bounds_of(sorted(rnd.choice(halves(keys)[:, 0].tolist()) for _ in range(rnd.randint(0, 6))) if keys else [], 3)
        rows = []
        for lo in range(0, len(keys), 7):  # blocks are sorted in themselves
            pairs, n = m._summed(halves(keys[lo : lo + 7]), np.array(counts[lo : lo + 7]))
            rows.append((pairs.tobytes(), n.astype("<u4").tobytes(), len(n), []))
        blocks = [pa.RecordBatch.from_pylist([dict(zip(("keys", "counts", "n", "shown"), r)) for r in rows])] if rows else []
        sliced = sorted((x for rb in m._sliced(bounds)(iter(blocks)) for x in rb.to_pylist()), key=lambda x: x["range"])
        assert sum(len(x["keys"]) for x in sliced) == sum(len(r[0]) for r in rows)
        step, total = rnd.randint(1, 5), Counter()
        parts = [pa.RecordBatch.from_pylist(sliced[i : i + step]) for i in range(0, len(sliced), step)]
        for rb in m._runs(3)(iter(parts)):
            for gram, size, n, whole in zip(*(c.to_pylist() for c in rb.columns)):
                total[gram, size] += n
                assert not whole or n == want[gram, size] >= 3
        assert {x: n for x, n in total.items() if n >= 3} == {x: n for x, n in want.items() if n >= 3}


def test_radix_order():
    rnd = np.random.default_rng(3)
    for top in (2, 70_000, 1 << 40, 1 << 63):
        pairs = rnd.integers(0, top, (500, 2)).astype(np.uint64)
        assert (pairs[m._radix_order(pairs)] == pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]).all()
    assert len(m._radix_order(np.empty((0, 2), np.uint64))) == 0


def test_bounds_split_a_hot_beginning():
    bounds = m.bounds_of([5, 7, 7, 7, 9], 299)
    assert bounds.tolist() == [[5, 0], [7, 0], [7, 100 << 32], [7, 200 << 32], [9, 0]]
    pairs = np.array([[4, 1], [5, 0], [7, 0], [7, 150 << 32], [7, 200 << 32], [8, 3], [9, 0]], np.uint64)
    assert m._below(pairs, bounds).tolist() == [1, 2, 3, 4, 6]


def test_one_language_each(spark, monkeypatch):
    """As many languages as documents; what a task holds is bounded all the same."""
    monkeypatch.setattr(m, "BATCH_BYTES", 300)
    rows = [(i, "a b " * 20, f"l{i}") for i in range(60)]
    assert got(collocations(spark, spark.createDataFrame(rows, SCHEMA), least=10)) == brute(rows, least=10)


def test_exact_beyond_64_bits(spark):
    """The score of 10^15 occurrences: the product is past 64 bits."""
    words = spark.createDataFrame([(10**15, 10**15 + 7, 10**15 + 11)], "a long, l long, r long")
    score = words.selectExpr("cast(2000000 AS decimal(8, 0)) * cast(a AS decimal(19, 0)) DIV cast(l + r AS decimal(19, 0)) AS s").first().s
    assert score == 2000000 * 10**15 // (2 * 10**15 + 18)


def test_long_piece_and_text(spark):
    rows = [(1, "word " * 400_000, "en"), (2, "x" * 3_000_000, "en"), (3, "p q. " * 300_000, "en")]
    assert got(collocations(spark, spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_awkward(awkward, nothing, spark):
    rows = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    df = awkward.withColumn("gram", awkward.text).withColumn("n", awkward.doc_id)
    assert got(collocations(spark, df, least=2)) == brute(rows, least=2)
    assert got(collocations(spark, nothing)) == []
    assert got(collocations(spark, spark.createDataFrame([(1, None, None), (2, "", "en"), (3, ".,;", "en")], SCHEMA))) == []


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql("SELECT doc_id, text, lang FROM documents").fetchall()
    found = got(op11_collocations(spark, sf))
    assert found == brute(want)
    assert found == sorted(con.sql(m.ORACLE).fetchall(), key=repr)


def test_words_of_a_batch():
    data = m.zstandard.ZstdCompressor().compress(b"a b. c\na b")
    p = m.Pieces({"data": data, "size": 10})
    assert [p.different[i].as_py() for i in p.local.tolist()] == ["a", "b", "c", "a", "b"]
    pairs, counts = p.keys(np.array([5, 6, 7], np.uint64))
    assert pairs.tolist() == [[5 << 32 | 6, 0]] and counts.tolist() == [2]
