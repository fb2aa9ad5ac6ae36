"""Near-exact titles against brute force over all pairs."""

import datetime as dt
import random

from harrier.functions import text as X
from harrier.operators import surveillance as S


def ratio(a, b):
    return 200.0 * X._common_subsequence(a, b) / (len(a) + len(b))


def rows():
    rnd = random.Random(7)
    base = [" ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(2, 30))) for _ in range(20)]
    out = []
    for t in base:
        n = max(1, len(t) // 25)
        for x in (t, t, "Z" * n + t, t[n:], "#" * n + t[n:], t + "y" * (2 * n), t[: len(t) // 2] + "q" * n + t[len(t) // 2 + n :], t[: len(t) // 2] + t[len(t) // 2 + 4 * n :]):
            at = None if rnd.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.choice([0, 3, 40, 48, 49, 90]))
            out.append((len(out), x, at))
    return out + [(len(out), None, dt.datetime(2024, 1, 1)), (len(out) + 1, "", dt.datetime(2024, 1, 1))]


def brute(data):
    near = lambda p, q: p is not None and q is not None and abs(p - q) <= dt.timedelta(hours=48)
    return {(i, j) for i, a, p in data for j, b, q in data if i < j and a and b and near(p, q) and 92 <= ratio(a, b) < 100}


def test_near_exact_pairs(spark):
    data = rows()
    want = brute(data)
    got = [tuple(r) for r in S.near_exact_pairs(spark.createDataFrame(data, "signal_id long, title string, published_at timestamp")).collect()]
    titles = {i: t for i, t, _ in data}
    assert sum(titles[i][:4] != titles[j][:4] for i, j in want) > 20
    assert len(got) == len(set(got)) and set(got) == want


def test_query_against_brute_force(spark):
    import __spark_entry__ as e
    from harrier.plans import domain as D

    d = "/root/testdata/sf0.001"
    data = [tuple(r) for r in D.signals(spark, d).select("signal_id", "title", "published_at").collect()]
    assert {tuple(r) for r in e.queries()["near_exact_titles"](spark, d).collect()} == brute(data)
