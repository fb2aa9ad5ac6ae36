"""Streams give what the batch gives."""

import datetime as dt

from pyspark.sql import functions as F

from harrier.streaming import sightings as M

EVENTS = "/root/testdata/sf0.001/events.parquet"


def landed(spark, tmp_path):
    df = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def test_windowed_counts(spark, tmp_path):
    df, path = landed(spark, tmp_path)
    got = M.drain(M.windowed_counts(M.read_stream(spark, path, df.schema), "ts", "event_type"), "counts", str(tmp_path / "cp"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.windowed_counts(df, "ts", "event_type").collect()))


def test_exactly_once_by_key(spark, tmp_path):
    df, path = landed(spark, tmp_path)
    out = str(tmp_path / "out")
    sink = M.append_new(out, ["event_id"])
    for n in (0, 1, 1):
        sink(df.where("event_id % 2 = 0") if n == 0 else df, n)
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("event_id").distinct().count() == df.count()


def test_deduplicated(spark, tmp_path):
    df, path = landed(spark, tmp_path)
    twice = M.read_stream(spark, path, df.schema).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    assert M.drain(M.deduplicated(twice, "ts", ["event_id"]), "once", str(tmp_path / "cp2")).count() == df.count()


def test_story_states(spark, tmp_path):
    """Routed groups are resolved, others expire by event time, one that is opened again starts anew."""
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, "opened", hour(0)), (2, "opened", hour(1)), (3, "opened", hour(2))], [(1, "routed", hour(5)), (9, "routed", hour(5))], [(4, "opened", hour(80))], [(1, "opened", hour(81)), (2, "routed", hour(82))], [(5, "opened", hour(200))], [(6, "opened", hour(201))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "group_id long, kind string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = M.read_stream(spark, str(tmp_path / "in"), "group_id long, kind string, at timestamp", 1)
    got = [(r.group_id, r.state) for r in M.drain(M.story_states(stream, "at"), "states", str(tmp_path / "cp"), "append").collect()]
    assert sorted(got) == [(1, "expired"), (1, "resolved"), (2, "expired"), (3, "expired"), (4, "expired")]


def test_copies_of_any_age(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    for rows in ([(1, "a", at(0)), (2, "b", at(0))], [(3, "a", at(400))], [(4, "b", at(1)), (5, "c", at(2)), (6, "a", at(3))]):
        spark.createDataFrame(rows, "signal_id long, content_hash string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = M.read_stream(spark, str(tmp_path / "in"), "signal_id long, content_hash string, at timestamp", 1)
    got = M.drain(M.copies_of_any_age(stream, "at"), "copies", str(tmp_path / "cp"), "append").collect()
    assert sorted((r.signal_id, r.primary_id) for r in got) == [(3, 1), (4, 2), (6, 1)]


def test_first_seen(spark, tmp_path):
    df, path = landed(spark, tmp_path)
    got = M.drain(M.first_seen(M.read_stream(spark, path, df.schema), "ts", "user_id"), "firsts", str(tmp_path / "cp"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.first_seen(df, "ts", "user_id").collect()))
