import hashlib
import re

from harrier.llm.substring_dedup import dedup_substrings, levels_to, op4_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    least, words = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        words.append((i, w))
        if i is not None:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1) if i is not None else ():
            if least[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_levels():
    assert levels_to(13) == [7, 13] and levels_to(50) == [7, 13, 25, 50] and levels_to(3) == [2, 3] and levels_to(1) == [1, 1]


def test_awkward(awkward, spark):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for n in (13, 3, 1, 30):
        assert got(dedup_substrings(spark, awkward, n)) == brute(rows, n)


def test_empty(nothing, spark):
    assert dedup_substrings(spark, nothing).count() == 0


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_substring_dedup(spark, sf)) == brute(rows)
    df = dedup_substrings(spark, spark.read.parquet(f"{sf}/documents.parquet")).cache()
    texts = {i: WORD.findall(t) for i, t in rows}
    for r in df.collect():
        w = texts[r.doc_id]
        for s in reversed(r.spans):
            del w[s.first : s.first + s.words]
        assert hashlib.sha256(" ".join(w).encode()).hexdigest() == r.kept_sha256
