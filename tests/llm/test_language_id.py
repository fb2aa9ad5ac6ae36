import zlib

import numpy as np

from harrier.llm import language_id as m


def test_filters_have_every_ngram_and_few_others():
    rng = np.random.default_rng(2)
    word = lambda a: "".join(rng.choice(list(a), rng.integers(2, 9)))
    texts = [" ".join(word(a) for _ in range(60)) for a in ("abcdef", "defghi", "xyzw") for _ in range(40)]
    langs = [n for n in ("aa", "bb", "cc") for _ in range(40)]
    f = m.build_filters(texts, langs)
    seen = {n: {} for n in f.languages}
    for t, n in zip(texts, langs):
        p, own, _ = m._letters([t])
        for g in set(np.concatenate([h for _, h in m.gram_hashes(p, own)]).tolist()):
            seen[n][g] = seen[n].get(g, 0) + 1
    top = {g: max(s.get(g, 0) for s in seen.values()) for s in seen.values() for g in s}
    for i, n in enumerate(f.languages):
        inside = np.array([g for g, k in seen[n].items() if k >= 3 and k >= 0.1 * top[g]], np.uint64)
        assert (f.lookup(inside)[:, 0] >> i & 1).all()
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    for i in range(3):
        assert abs(np.mean(f.lookup(other)[:, 0] >> i & 1) - f.rates[i]) < 0.02


def test_awkward(awkward, nothing, spark):
    got = m.classify_language(awkward).collect()
    assert len(got) == awkward.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5)) and 0 <= r.score <= 1 for r in got)
    assert m.classify_language(nothing).count() == 0
    assert {r.lang_pred for r in m.classify_language(awkward.withColumn("lang", m.F.lit(None))).collect()} == {"und"}


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = m.op10_language_id(spark, d).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
