"""No pair within the edit rate is missed, wherever the edits stand."""

import random

import numpy as np

from harrier.llm import decontamination as m


def brute(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(rnd, t, k):
    c = list(t)
    for _ in range(k):
        i, what = rnd.randrange(len(c)), rnd.randrange(3)
        c[i : i + (what != 1)] = [] if what == 2 else [rnd.choice("abcdefgh ")]
    return "".join(c)


def found(spark, rows, items):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in m.contaminated(docs, bench).collect()}


def test_one_wrong_character_in_every_third_word(spark):
    rnd = random.Random(1)
    items = [words(rnd, n) for n in (6, 15, 30, 60)]
    rows = []
    for t in items:
        w = t.split()
        w[::3] = ["Z" + x[1:] for x in w[::3]]
        rows.append(f"{words(rnd, 90)} {' '.join(w)} {words(rnd, 90)}")
    assert {(i, i) for i in range(len(items))} <= set(found(spark, rows, items))


def test_all_pairs_at_the_largest_distance(spark):
    rnd = random.Random(2)
    items = [words(rnd, rnd.randint(1, 25)) for _ in range(60)] + ["a b", "xyz", "w"]
    rows = [f"{words(rnd, rnd.randint(0, 20))} {edited(rnd, t, int(m.EDIT_RATE * len(t)))} {words(rnd, rnd.randint(0, 20))}" for t in items for _ in range(2)]
    want = {(d, i): e for d, r in enumerate(rows) for i, t in enumerate(items) if (e := brute(m.normal(t), m.normal(r))) <= int(m.EDIT_RATE * len(m.normal(t)))}
    got = found(spark, rows, items)
    assert len(want) > 100 and want == {k: r.distance for k, r in got.items()}
    for (d, i), r in got.items():  # the reported place holds it
        tail = " ".join(m.normal(rows[d]).split()[r.first_word :])
        assert brute(m.normal(items[i]), tail) <= r.distance + 7


def test_small_batches_give_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    items = [words(rnd, rnd.randint(3, 30)) for _ in range(12)]
    texts = [f"{words(rnd, rnd.randint(0, 200))} {edited(rnd, t, int(0.15 * len(t)))} {words(rnd, rnd.randint(0, 200))}" for t in items]
    texts = [m.normal(t) for t in texts]
    whole = m.Index(list(range(12)), [m.normal(t) for t in items], 0.15).search(texts)
    for name, small in (("BATCH_CHARS", 97), ("COUNTERS", 50), ("HITS", 20)):
        monkeypatch.setattr(m, name, small)
        assert whole == m.Index(list(range(12)), [m.normal(t) for t in items], 0.15).search(texts)
    assert len(whole) >= 12


def test_place_of_the_best_match():
    rnd = random.Random(5)
    for _ in range(60):
        p, t = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(lo, 60))) for lo in (1, 0))
        e, s = m.best_place(p, t)
        assert e == brute(p, t) == min(brute_from(p, t[s:]), len(p))


def brute_from(p, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return int(np.min(row))
