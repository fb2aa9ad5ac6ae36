"""Texts far longer than a batch or chunk, whole, in every operator that works in pieces."""

import random

import public_tokenizers
import pytest

from harrier.llm import language_id, quality, toxicity
from harrier.llm.decontamination import contaminated
from harrier.llm.jaccard_join import jaccard_components
from harrier.llm.mixing import mix_sources
from harrier.llm.shared import Scratch
from harrier.llm.substring_dedup import dedup_substrings
from harrier.llm.subwords import Model
from harrier.llm.token_files import read_tokens, write_tokens
from test_token_files import brute as tokens

ITEM = "an item of the benchmark that stands at the very end of a long text and nowhere else in it"


@pytest.fixture(scope="module")
def texts():
    """(1) 300,000 words, over two million characters; (2) the same with some words changed and an item behind it."""
    rnd = random.Random(11)
    one = [rnd.choice("abcdefgh") * rnd.randint(1, 4) + str(rnd.randrange(100_000)) for _ in range(300_000)]
    two = list(one)
    for i in range(0, len(two), 3000):
        two[i] = "changed"
    return [(1, " ".join(one)), (2, " ".join(two) + " " + ITEM), (3, "short and different from all of that")]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").repartition(2)


def test_jaccard(table, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table.sparkSession, table).collect()}
    n = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for w in (t.split() for _, t in texts)]
    assert got == {1: (n[0], 1), 2: (n[1], 1), 3: (n[2], 3)}


def test_substrings(table, texts):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(table.sparkSession, table).collect()}
    assert got[1] == (300_000, 0) and got[3][1] == 0 and got[2] == (len(texts[1][1].split()), 300_000 - 100)


def test_decontamination(table, spark):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.first_word, r.distance) for r in contaminated(table, items).collect()] == [(2, 7, 300_000, 0)]


def test_tokens(table, texts, spark):
    path = Scratch(spark, "t").path
    write_tokens(spark, table, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((tuple(r)[:4] for r in read_tokens(spark, path).collect()), key=lambda r: r[1]) == tokens(texts)


def test_mixing(table, texts, spark):
    assert sorted((r.doc_id, r.n_tokens) for r in mix_sources(spark, table).collect()) == [(i, len(t.split())) for i, t in texts]


def test_scores(table, texts):
    """A long text's score is that of its parts together: with a model of one value everywhere, that value."""
    import numpy as np

    model = Model(np.full(1 << 18, 0.25, np.float32), 0.5)
    for m in (quality, toxicity):
        z, words = m.document_logits([t for _, t in texts], model)
        assert np.allclose(z, 0.75, atol=1e-4) and words.tolist() == [len(t.split()) for _, t in texts]


def test_language_by_brute_force(texts):
    """Per language: how many of a text's n-grams its filter has, less the false positives that are to be expected."""
    import numpy as np

    rnd = random.Random(2)
    words = {n: [("".join(rnd.choice(a) for _ in range(rnd.randint(2, 8)))) for _ in range(300)] for n, a in (("aa", "abcde"), ("bb", "defgh"), ("cc", "xyzé"))}
    sample = [(" ".join(rnd.choice(words[n]) for _ in range(60)), n) for n in words for _ in range(30)]
    f = language_id.build_filters(*map(list, zip(*sample)))
    asked = [" ".join(rnd.choice(words[n]) for _ in range(20)) for n in words] + ["", "12 34 !?", " ".join(rnd.choice(words["bb"]) for _ in range(150_000)), "ß"]
    got, score = language_id.identify(asked, f)
    for k, t in enumerate(asked):
        padded = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        grams = [padded[i : i + n] for n in language_id.GRAMS for i in range(len(padded) - n + 1) if padded[i + 1 : i + n - 1].isalpha()]
        hits = np.zeros(3)
        for g, times in {g: grams.count(g) for g in set(grams)}.items() if len(grams) < 5000 else {}:
            points = np.array([ord(c) for c in g], np.uint32)
            (h,) = [x for at, x in language_id.gram_hashes(points, np.array([c != " " for c in g])) if len(x) and len(points) == len(g)][-1:] or [np.empty(0, np.uint64)]
            mask = int(f.lookup(h[:1])[0, 0]) if len(h) else 0
            hits += times * np.array([mask >> i & 1 for i in range(3)])
        if len(grams) < 5000:
            right = np.maximum(0, (hits - len(grams) * f.rates) / (1 - f.rates))
            want = language_id.UNKNOWN if not any(c.isalpha() for c in t) else f.languages[right.argmax()] if right.sum() else f.usual
            assert got[k] == want and np.isclose(score[k], right.max() / right.sum() if right.sum() else 0.0)
    assert got[:3] == ["aa", "bb", "cc"] and got[5] == "bb"
