import hashlib
import random

import numpy as np

from harrier.llm import winnowing as m


def brute(text, k, w):
    """The rule written out: rightmost least hash of each window."""
    points = m.code_points(text)
    h = m.gram_hashes(points, k).tolist()
    kept = set()
    for s in range(max(1, len(h) - w + 1)) if h else ():
        window = h[s : s + w]
        kept.add(s + max(i for i, x in enumerate(window) if x == min(window)))
    return sorted(kept)


def test_rule_and_guarantee(monkeypatch):
    rnd = random.Random(3)
    for n in (0, 1, 3, 7, 8, 9, 20, 23, 24, 60, 400, 900):
        text = "".join(rnd.choice("abé日") for _ in range(n))
        for chunk in (1 << 18, 64):
            monkeypatch.setattr(m, "CHUNK", chunk)
            h, p = m.winnow(text, 5, 7)
            assert p.tolist() == brute(text, 5, 7)
            assert h.tolist() == m.gram_hashes(m.code_points(text), 5)[p].tolist()
    monkeypatch.setattr(m, "CHUNK", 1 << 18)
    for _ in range(200):
        shared = "".join(rnd.choice("abcdefgh") for _ in range(m.GRAM + m.WINDOW - 1))
        a, b = ("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90))) + shared + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90))) for _ in "ab")
        assert len(np.intersect1d(m.winnow(a)[0], m.winnow(b)[0]))


def test_every_length(monkeypatch):
    """Texts of more than one piece, every remainder; and one of the true size of a piece."""
    rnd = random.Random(4)
    monkeypatch.setattr(m, "CHUNK", 64)
    for n in range(50, 340):
        text = "".join(rnd.choice("abé日") for _ in range(n))
        assert m.winnow(text, 8, 16)[1].tolist() == brute(text, 8, 16)
    monkeypatch.setattr(m, "CHUNK", 1 << 18)
    for more in (0, 7, 12, 24):
        text = "".join(rnd.choice("abé日") for _ in range((1 << 18) + more))
        assert m.winnow(text)[1].tolist() == brute(text, m.GRAM, m.WINDOW)


def test_gram_hashes_are_of_the_gram_alone():
    a, b = m.gram_hashes(m.code_points("xxabcdefgh"), 8), m.gram_hashes(m.code_points("abcdefghyy"), 8)
    assert a[2] == b[0] and len(set(a.tolist())) == 3


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        f = [m.winnow(x) for x in (t, e, nxt)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), m.digest(*f[0]), m.digest(*f[1]), m.likeness(f[0][0], f[1][0]), m.likeness(f[0][0], f[2][0]), len(f[0][0])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward(awkward, spark):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(m.compare_neighbours(spark, awkward)) == want(rows)
    one = awkward.where("doc_id = 9")
    assert got(m.compare_neighbours(spark, one)) == want([(r.doc_id, r.text) for r in one.collect()])
    kept = {r.doc_id: r for r in m.fingerprint_documents(awkward.where("doc_id in (1, 3, 11)")).collect()}
    assert kept[1].hashes == kept[11].hashes and kept[1].positions == kept[11].positions and kept[3].hashes == []


def test_empty(nothing, spark):
    assert m.compare_neighbours(spark, nothing).count() == 0


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = got(m.op9_winnowing(spark, sf))
    assert df == want(rows)
    assert np.mean([r[5] > r[6] for r in df if r[1] > 60]) > 0.95
