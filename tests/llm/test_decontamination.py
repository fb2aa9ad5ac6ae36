import random

import cgk
import numpy as np

from harrier.llm import decontamination as m


def brute(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def edited(rnd, t, k):
    c = list(t)
    for _ in range(k):
        i, what = rnd.randrange(len(c)), rnd.randrange(3)
        c[i : i + (what != 1)] = [] if what == 2 else [rnd.choice("abcdefgh ")]
    return "".join(c)


def test_distance():
    rnd = random.Random(1)
    for _ in range(60):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert m.edit_distance_within(p, t) == brute(p, t)


def test_embedding_is_of_equal_texts_equal_and_near_texts_near():
    a, b = "the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumped over the lazy dog " * 3
    k = cgk.keys_of([a, a, b, a[::-1]], 128, 200)
    assert (k[0] == k[1]).all() and (k[0] == k[2]).mean() > 3 * (k[0] == k[3]).mean()


def test_embeddings_would_need_many_repetitions():
    """Why the search is not by embeddings: at the largest distance, a window and its item agree in few of the keys, so each
    window of a text would have to be walked through some thirty times for a recall of 0.9."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [" ".join(word() for _ in range(rnd.randint(20, 70))) for _ in range(40)]
    p = np.array([(k[0] == k[1]).mean() for t in items for k in [cgk.keys_of([t, edited(rnd, t, int(m.EDIT_RATE * len(t)))], len(t), 300)]])
    need = next(n for n in range(1, 3000) if (1 - (1 - p) ** n).mean() >= 0.9)
    assert 15 < need < 100


def test_edited_items_are_found_and_clean_documents_are_not(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(40)]
    rows, want = [], set()
    for k, t in enumerate(items):
        for e in (0.0, 0.04, 0.1):
            x = edited(rnd, t, int(e * len(t)))
            text = " ".join(word() for _ in range(rnd.randint(0, 300))) + " " + rnd.choice([x, x.upper(), x.replace(" ", "\n ")]) + " " + " ".join(word() for _ in range(rnd.randint(0, 300)))
            want.add((len(rows), k))
            rows.append(text)
    clean = len(rows)
    rows += [" ".join(word() for _ in range(200)) for _ in range(100)]
    rows += [" ".join(t.split()[: len(t.split()) // 2]) for t in items]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = m.contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert not [p for p in pairs if p[0] >= clean]
    assert len(pairs & want) / len(want) > 0.96 and not pairs - want
    for r in got:
        assert brute(m.normal(items[r.item_id]), m.normal(rows[r.doc_id])) <= r.distance <= 0.15 * r.item_chars


def test_awkward(awkward, nothing, spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "a b c d e f g h i j k l"), (5, "word"), (4, "a b c d e f g h i j k l")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in m.contaminated(awkward, bench).collect()}
    assert {(6, 1), (7, 1), (1, 4), (11, 4), (None, 4), (10, 4), (2, 4), (9, 5)} <= got
    assert m.contaminated(nothing, bench).count() == 0 and m.contaminated(awkward, bench.where("item_id is null")).count() == 0


def test_blocks(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(i, f"one two three w{i}") for i in range(5)] + [(9, "one two three")], "item_id long, text string")
    whole = {tuple(r) for r in m.contaminated(awkward, bench).collect()}
    monkeypatch.setattr(m, "BLOCK_CHARS", 30)
    assert {r[:2] for r in whole} == {tuple(r)[:2] for r in m.contaminated(awkward, bench).collect()}


def test_table_has_the_exact_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for b in bench for d in docs if m.normal(b.text) in m.normal(d.text)}
    got = {(r.doc_id, r.item_id): r.distance for r in m.op5_decontamination(spark, sf).collect()}
    assert want and want == {k for k, e in got.items() if e == 0}
