"""All three rules of a duplicate: hash, near-exact title, title and body."""

import datetime as dt

from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import surveillance as S


def test_near_exact_titles_are_duplicates(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    t = "Cholera outbreak spreads through the northern districts of Kano"
    rows = [
        (1, t, "first body", at(0), at(0)), (2, "X" + t + "s", "quite another text", at(10), at(10)),  # near-exact: a copy of 1
        (3, t, "a third text of its own", at(12), at(12)),  # the same headline, another body: no copy of 1, but of 2
        (4, "Y" + t, "late", at(60), at(60)), (5, "Y" + t, "unknown", at(1), None), (6, "Z" + t, "seen late", at(90), at(5)), (7, t, "first body", at(900), at(900)),
    ]
    s = spark.createDataFrame(rows, "signal_id long, title string, raw_text string, first_seen_at timestamp, published_at timestamp")
    s = s.withColumn("content_hash", X.content_hash(F.col("title"), F.col("raw_text"))).withColumn("tokens", X.title_tokens(F.col("title")))
    pairs = {(1, 2), (2, 3), (1, 7)}
    published = {i: p for i, *_, p in rows}
    seen = {i: p for i, _, _, p, _ in rows}
    titles = {i: x for i, x, *_ in rows}
    ratio = lambda a, b: 200.0 * X._common_subsequence(a, b) / (len(a) + len(b))
    hour = dt.timedelta(hours=1)
    want = {(1, 7)} | {(i, j) for i in titles for j in titles if i < j and published[i] and published[j] and abs(published[i] - published[j]) <= 48 * hour and abs(seen[i] - seen[j]) <= 72 * hour and 92 <= ratio(titles[i], titles[j]) < 100}
    assert pairs <= want and (1, 6) not in want and (1, 4) not in want
    p = S.duplicate_pairs(s)
    assert {tuple(r) for r in p.collect()} == want | {(j, i) for i, j in want}
    primary = {r.signal_id: r.primary_id for r in S.resolve_duplicates(spark, s, p).collect()}
    assert primary[2] == primary[3] == primary[7] == 1 and primary[5] == 5
