"""Chains of late rows against the batch's."""

import datetime as dt
import random

from pyspark.sql import functions as F

from harrier.operators import surveillance as S
from harrier.streaming import chains as C

SCHEMA = "signal_id long, rule_group string, country string, first_seen_at timestamp, is_official boolean, credibility string"
DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def rows(seed, n=160):
    rnd = random.Random(seed)
    at = lambda: DAY0 + dt.timedelta(hours=rnd.choice([rnd.uniform(0, 40 * 24), 24 * rnd.randrange(40)]))
    return [(i, rnd.choice(["r0", "r1", None]), rnd.choice(["A", None]), at(), rnd.random() < 0.2, rnd.choice(["high", "unknown", "official", None])) for i in range(n)]


def batch_chains(spark, data):
    s = S.story_chains(spark.createDataFrame(data, SCHEMA))
    g = s.groupBy("rule_group", "country", "chain").agg(F.unix_micros(F.min("first_seen_at")).alias("a"), F.unix_micros(F.max("first_seen_at")).alias("b"), F.count("*").alias("n"), F.max(F.when(F.col("is_representative"), F.col("signal_id"))).alias("r"))
    return sorted((tuple(x) for x in g.select("rule_group", "country", "a", "b", "n", "r").collect()), key=repr)


def streamed(spark, tmp_path, batches, late):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for i, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{source}/f{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    q = C.chain_changes(stream, late=late).writeStream.foreachBatch(C.append_changes(out)).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{out}/batch=*")


def chains_of(changes):
    got = C.latest_chains(changes).select("rule_group", "country", "start_us", "end_us", "n_signals", "representative_id", "change").collect()
    return sorted((tuple(x)[:6] for x in got), key=repr), {x.change for x in got}


def test_joining_by_hand():
    row = lambda t: [t, t, 1, [1, 0, t, t]]
    chains, gone = [], 0
    for t in (0, 100, 50, 49, 200, 125):
        chains, near, _ = C.joined(chains, row(t), 51)
        gone += max(0, len(near) - 1)
    assert chains == [[0, 125, 5, [1, 0, 0, 0]], [200, 200, 1, [1, 0, 200, 200]]] and gone == 1


def test_any_order_of_late_rows(spark, tmp_path):
    data = rows(1)
    random.Random(2).shuffle(data)
    changes = streamed(spark, tmp_path, [data[i::5] for i in range(5)], "100 days")
    got, states = chains_of(changes)
    assert got == batch_chains(spark, data) and states == {"open"}
    assert changes.where("change = 'gone'").count() > 5


def test_chains_close_behind_the_watermark(spark, tmp_path):
    """Rows in order, each up to two days late: what the watermark has left is closed, and the chains are the batch's."""
    data = sorted(rows(3), key=lambda r: r[3])
    rnd = random.Random(4)
    arrival = sorted(data, key=lambda r: r[3] + dt.timedelta(hours=rnd.uniform(0, 44)))
    step = len(data) // 6 + 1
    changes = streamed(spark, tmp_path, [arrival[i : i + step] for i in range(0, len(data), step)], "2 days")
    got, states = chains_of(changes)
    assert got == batch_chains(spark, data) and states == {"open", "closed"}
    open_ = [x for x in C.latest_chains(changes).collect() if x.change == "open"]
    newest = max(r[3] for r in data)
    assert all(x.end_us / 1e6 > (newest - dt.timedelta(days=6)).timestamp() for x in open_)
