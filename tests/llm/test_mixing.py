import math
from collections import Counter, defaultdict

from harrier.llm import mixing as m


def test_bisection():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    x = m.bisect_exponent(shares, target_entropy=1.0)
    assert abs(m.entropy(m.temper(shares, x)) - 1.0) < 1e-9
    x = m.bisect_exponent(shares, most_repeats=2.0)
    r = m.repeats(shares, m.temper(shares, x), None)
    assert abs(max(r.values()) - 2.0) < 1e-6 and abs(min(r.values()) - 1.0) < 1e-9
    assert m.bisect_exponent(shares, target_entropy=5.0) == 0.0 and m.bisect_exponent(shares, most_repeats=100.0) == 0.0
    assert m.bisect_exponent(shares, target_entropy=0.1) == 1.0


def check(rows, read, r, block_tokens):
    """Every source is read to its budget, in whole epochs but the last, each a permutation."""
    tokens = {k: max(1, len((t or "").split())) for k, (_, t, _) in enumerate(rows)}
    total = Counter()
    for k, (_, _, s) in enumerate(rows):
        total[s] += tokens[k]
    seen, spent = defaultdict(Counter), Counter()
    for x in read:
        seen[x.source, x.epoch][x.doc_id] += 1
        spent[x.source] += x.n_tokens
    copies = Counter((s, i) for i, _, s in rows)
    for s in total:
        quota = r[s] * total[s]
        assert quota - 1e-6 <= spent[s] < quota + max(tokens.values()) + 1
        epochs = math.ceil(round(r[s], 9))
        for e in range(epochs - 1):
            assert seen[s, e] == Counter({i: n for (q, i), n in copies.items() if q == s})
        assert all(n <= copies[s, i] for i, n in seen[s, epochs - 1].items())
        own = sorted((x for x in read if x.source == s), key=lambda x: x.start_token)
        assert [x.start_token for x in own] == [sum(y.n_tokens for y in own[:k]) for k in range(len(own))] if len(own) < 200 else True
        assert [x.epoch for x in own] == sorted(x.epoch for x in own)


def test_awkward(awkward, nothing, spark):
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    read = m.mix_sources(spark, awkward).collect()
    assert Counter(r.doc_id for r in read) == Counter(r[0] for r in rows) and all(r.epoch == 0 for r in read)
    assert m.mix_sources(spark, nothing).count() == 0


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    total = Counter()
    for _, t, s in rows:
        total[s] += max(1, len(t.split()))
    shares = {s: t / sum(total.values()) for s, t in total.items()}
    x = m.bisect_exponent(shares, most_repeats=2.0)
    r = m.repeats(shares, m.temper(shares, x), None)
    for size in (1 << 18, 500):
        read = m.mix_sources(spark, df, block_tokens=size).collect()
        check(rows, read, r, size)
    read = m.mix_sources(spark, df, most_repeats=None, target_entropy=2.0, budget=0.5).collect()
    w = m.temper(shares, m.bisect_exponent(shares, target_entropy=2.0))
    check(rows, read, m.repeats(shares, w, 0.5), 1 << 18)
    again = m.mix_sources(spark, df, most_repeats=None, target_entropy=2.0, budget=0.5).collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, again))


def test_against_brute_force(spark, monkeypatch):
    """Every entry's block, epoch, position and first token, recomputed; spans and wide shares change nothing."""
    import hashlib

    num = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    rows = [(i, " ".join(["w"] * (i * 7 % 40)) + f" x{i}", "abc"[min(2, i % 7)]) for i in range(120)] + [(7, "same", "b"), (7, "same", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = 60
    docs, total = [], Counter()
    for i, t, s in rows:
        docs.append((i, s, len(t.split()), hashlib.md5(t.encode()).hexdigest()))
        total[s] += len(t.split())
    shares = {s: t / sum(total.values()) for s, t in total.items()}
    times = m.repeats(shares, m.temper(shares, m.bisect_exponent(shares, most_repeats=2.0)), None)
    want = []
    for s in total:
        of, quota, blocks = "s" + s, int(round(times[s] * total[s], 3) + 0.999), max(1, round(total[s] / size))
        spent = turn = 0
        for e in range(math.ceil(round(times[s], 9))):
            own = defaultdict(list)
            for d in docs:
                if d[1] == s:
                    own[num(17, of, d[3], d[0]) % blocks].append(d)
            for b in sorted(own, key=lambda b: (num(17, "block", of, e, b), b)):
                turn, at = turn + 1, spent
                for d in sorted(own[b], key=lambda d: (num(17, "doc", of, e, d[3], d[0]), d[0], d[3])):
                    if spent < quota and at < quota:
                        want.append((d[0], s, d[2], e, b, turn * 2**32 + num(17, "doc", of, e, d[3], d[0]), at))
                    at += d[2]
                spent = at
    got = lambda: sorted(tuple(r) for r in m.mix_sources(spark, df, block_tokens=size).collect())
    assert got() == sorted(want)
    monkeypatch.setattr(m, "BLOCKS_TOGETHER", 3)
    monkeypatch.setattr(m, "SOURCES", 1)
    assert got() == sorted(want)
