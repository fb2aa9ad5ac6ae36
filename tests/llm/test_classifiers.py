import numpy as np
import pytest

from harrier.llm import quality, subwords, toxicity
from harrier.llm.shared import Scratch


def test_sums_are_the_sums_of_the_features():
    table = np.random.default_rng(0).normal(size=1 << subwords.BITS).astype(np.float32)
    for texts in (["The cat, the  cat sat", "", "x", "Straße é\n日本"], ["", " "], ["a b", "b$b @ c*d* e"]):
        for letters in (False, True):
            w = subwords.Words(texts, letters)
            total, count = w.sums(table, True)
            ids, words = w.features(True)
            assert np.allclose(total, np.bincount(words, table[ids], len(total))) and (count == np.bincount(words, minlength=len(count))).all()


def test_word_grams_do_not_depend_on_neighbours():
    a, b = subwords.Words(["idiot"], True), subwords.Words(["what an idiot, he"], True)
    table = np.random.default_rng(0).normal(size=1 << subwords.BITS).astype(np.float32)
    assert np.isclose(a.sums(table, False)[0][0], b.sums(table, False)[0][2])


def test_pieces_change_nothing(monkeypatch):
    texts = ["one two three four five six seven eight " * 50, "short", ""]
    model = subwords.Model(np.random.default_rng(1).normal(size=1 << subwords.BITS).astype(np.float32), 0.5)
    whole = toxicity.document_logits(texts, model)
    monkeypatch.setattr(subwords, "CHUNK", 64)
    got = toxicity.document_logits(texts, model)
    assert np.allclose(got[0], whole[0]) and (got[1] == whole[1]).all()


def test_document_logits_by_brute_force():
    """The greatest mean of the features of any PASSAGE consecutive words; all of them in a shorter text."""
    texts = ["one two three four five six seven eight nine ten", "short", "", "a b c d e", "Über-größe  naïve\nwörter 日本 x1 y2 z3"]
    model = subwords.Model(np.random.default_rng(3).normal(size=1 << subwords.BITS).astype(np.float32), 0.5)
    got, words = toxicity.document_logits(texts, model)
    for t, z, n in zip(texts, got, words):
        own = toxicity._words(t)
        assert n == len(own)
        feats = [subwords.Words([w], True).features(False)[0] for w in own]
        best = [np.concatenate(feats[i : i + toxicity.PASSAGE]) for i in range(max(1, len(own) - toxicity.PASSAGE + 1))] if own else []
        assert np.isclose(z, max((model.table[f].mean() + 0.5 for f in best), default=-30.0), atol=1e-5)


def test_fit_separates_and_draws_whole_bags():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"] if k % 2 else ["delta", "epsilon", "alpha"], 30)) for k in range(200)]
    bags = quality._Bags(texts)
    flat, often, n = bags(np.array([3, 0]))
    for k, (i, lo) in enumerate(((3, 0), (0, n[0]))):
        f, c = np.unique(subwords.Words([texts[i]], False).features(True)[0], return_counts=True)
        assert flat[lo : lo + n[k]].tolist() == f.tolist() and often[lo : lo + n[k]].tolist() == c.tolist()
    model = subwords.fit(bags, np.arange(200) % 2.0, np.ones(200), np.arange(200), batch=16)
    z = quality.document_logits(texts, model)[0]
    assert (z[1::2] > 0).all() and (z[::2] < 0).all()


def test_bounded_rows(spark):
    """By the hash, up to the rows and the characters that are allowed; what would be too long is passed over."""
    rows = [(1, "aaaa", 0, 0.1), (2, "b" * 50, 0, 0.2), (3, "cc", 0, 0.3), (4, "dd", 0, 0.4), (5, None, 1, 0.5), (5, "z", 1, 0.5), (6, "", 1, 0.6), (7, "y", 1, 0.7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, h double")
    assert subwords.bounded_rows(df, 2, 10, Scratch(spark, "t")) == [(1, "aaaa", 0), (3, "cc", 0), (5, "", 1), (6, "", 1)]


@pytest.mark.parametrize("m, name, folds, held", [(quality, "quality", 5, 0), (toxicity, "toxicity", 4, 2)])
def test_held_out_rows(m, name, folds, held, spark):
    import zlib

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = getattr(m, f"classify_{name}")(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    y = {r.doc_id: r[1] for r in labels.select("doc_id", "quality" if name == "quality" else "toxic").collect()}
    held_rows = [r for r in got if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held_rows]) > 0.9


@pytest.mark.parametrize("m, name, folds, held", [(quality, "quality", 5, 0), (toxicity, "toxicity", 4, 2)])
def test_precision_and_recall(m, name, folds, held, spark):
    import zlib

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    y = {r.doc_id: r[1] for r in labels.select("doc_id", "quality" if name == "quality" else "toxic").collect()}
    got = [(r.predicted, y[r.doc_id]) for r in getattr(m, f"classify_{name}")(docs, labels).collect() if r.held_out and r.doc_id in y]
    hits = sum(p and t for p, t in got)
    assert hits >= 0.9 * sum(p for p, _ in got) and hits >= 0.88 * sum(t for _, t in got)


def test_one_insult_in_a_long_text(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model, scale = toxicity.train_toxicity(docs, labels)
    fine = " ".join(r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(40).collect()).split()[:5000]
    rows = [(0, " ".join(fine))] + [(k, " ".join(fine[:2500] + [w] + fine[2500:])) for k, w in enumerate(("idiot", "worthless", "disgusting"), 1)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model, scale).collect()}
    assert got[0] < 0.3 and all(got[k] >= 0.3 for k in (1, 2, 3))


@pytest.mark.parametrize("m, name", [(quality, "quality"), (toxicity, "toxicity")])
def test_awkward(m, name, awkward, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, None), (None, 1, 1), (9, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    classify = getattr(m, f"classify_{name}")
    for labels in (none, some):
        got = classify(awkward, labels).collect()
        assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
        same = {r.score for r in got if r.doc_id in (6, 7)}
        assert len(same) == 1
        assert classify(nothing, labels).count() == 0


def test_misspellings_share_ngrams(spark):
    d = "/root/testdata/sf0.1"
    model, scale = toxicity.train_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), sample=1000)
    rows = [(i, f"the ander on thion {w} er thes") for i, w in enumerate(["worthles", "worthlesss", "pathetik", "disgustting", "ander", "tion"])]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model, scale).collect()}
    assert min(got[i] for i in range(4)) > max(got[4], got[5])
