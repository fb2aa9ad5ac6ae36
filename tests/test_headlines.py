"""Alike headlines of a stream against all pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.streaming import headlines as H

SCHEMA = "signal_id long, title string, first_seen_at timestamp"
DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def rows(seed, n=90):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rnd.sample(vocabulary, rnd.randint(1, 24)) for _ in range(12)]
    out = []
    for i in range(n):
        t = list(rnd.choice(base))
        if rnd.random() < 0.5:
            t[rnd.randrange(len(t)) :][:1] = []
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(vocabulary)) if rnd.random() < 0.5 else t.pop()
        rnd.shuffle(t)
        out.append((i, " ".join(t) if rnd.random() < 0.95 else rnd.choice(["", "!?", None]), DAY0 + dt.timedelta(hours=rnd.choice([rnd.uniform(0, 400), 72 * rnd.randint(0, 5)]))))
    return out


def brute(spark, data, hours, least):
    sets = {r.signal_id: set(r.k or []) for r in spark.createDataFrame(data, SCHEMA).select("signal_id", X.title_tokens(F.col("title")).alias("k")).collect()}
    near = lambda p, q: abs(p - q) <= dt.timedelta(hours=hours)
    return {(i, j) for i, _, p in data for j, _, q in data if i < j and near(p, q) and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}


def streamed(spark, tmp_path, batches, late, least=0.9):
    for i, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/f{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = H.alike_headlines(stream, least=least, late=late).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [tuple(r) for r in spark.read.schema(H.PAIRS).parquet(f"file://{tmp_path}/out").collect()]


def test_any_order(spark, tmp_path):
    data = rows(1)
    random.Random(2).shuffle(data)
    got = streamed(spark, tmp_path, [data[i::3] for i in range(3)], "100 days", 0.8)
    want = brute(spark, data, 72, 0.8)
    assert len(want) > 60 and len(got) == len(set(got)) and set(got) == want


def test_late_rows_within_the_watermark(spark, tmp_path):
    data = rows(3)
    rnd = random.Random(4)
    arrival = sorted(data, key=lambda r: r[2] + dt.timedelta(hours=rnd.uniform(0, 40)))
    got = streamed(spark, tmp_path, [arrival[i : i + 23] for i in range(0, len(arrival), 23)], "41 hours")
    assert len(got) == len(set(got)) and set(got) == brute(spark, data, 72, 0.9)


def test_prefix_never_loses_a_pair():
    rnd = random.Random(5)
    for _ in range(3000):
        least = rnd.choice([0.5, 0.8, 0.9])
        a = sorted(rnd.sample(range(40), rnd.randint(1, 20)))
        b = sorted({*(x for x in a if rnd.random() < 0.93), *rnd.sample(range(40), rnd.randint(0, 2))})
        if b and H.alike(a, b, least):
            assert set(a[: H.prefix(len(a), least)]) & set(b[: H.prefix(len(b), least)])
