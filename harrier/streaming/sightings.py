"""The polling stages as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and typed state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; what is later than the watermark is dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_seconds("window.start").alias("start_s"), key, "n", "total")


def deduplicated(events: DataFrame, time: str, key: list[str], within: str = "72 hours") -> DataFrame:
    """Overlapping polls see a sighting twice; the state of a key goes when the watermark has passed it."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def append_new(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that stores each key once, whatever its age and however often a batch is tried: the batch's
    number names its folder, and what an earlier try left there is replaced."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        disk = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if disk.exists(root):
            others = [str(s.getPath()) for s in disk.listStatus(root) if s.getPath().getName() != f"batch={number}" and s.getPath().getName().startswith("batch=")]
            if others:
                fresh = fresh.join(spark.read.parquet(*others).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def story_windows(signals: DataFrame, time: str, key: str, gap: str = "72 hours", late: str = "1 hour") -> DataFrame:
    """Stories that close when nothing has come for a gap."""
    return signals.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.unix_seconds("session_window.start").alias("start_s"), key, "n")


class _Stories(StatefulProcessor):
    """A story group from its opening to its end: resolved when its representative has been routed, expired when its time
    is up before that."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at long")

    def _end(self, key, state: str, at: int) -> Iterator[pd.DataFrame]:
        self.opened.clear()
        yield pd.DataFrame({"group_id": [key[0]], "state": [state], "at_s": [at // 1000]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("at_s")
        for kind, at in zip(seen["kind"], (seen["at_s"] * 1000).astype(int)):
            if kind == "opened" and not self.opened.exists():
                self.opened.update((at,))
                self.handle.registerTimer(at + self.hours * 3_600_000)
            elif kind == "routed" and self.opened.exists():
                due = self.opened.get()[0] + self.hours * 3_600_000
                self.handle.deleteTimer(due)
                # What was routed after its time had expired by then, though no timer has run yet.
                yield from self._end(key, *(("resolved", at) if at <= due else ("expired", due)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            yield from self._end(key, "expired", expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def story_states(changes: DataFrame, time: str, hours: int = 72, late: str = "1 hour") -> DataFrame:
    """(group_id, state, at_s) of story groups that end, from their changes (group_id, kind, time): kind is opened, or routed
    once the representative has left the queue. A group that nobody routes expires after hours of event time."""
    changes.sparkSession.conf.set(*STORE)
    rows = changes.withWatermark(time, late).select("group_id", "kind", time, F.unix_seconds(time).alias("at_s"))
    return rows.groupBy("group_id").transformWithStateInPandas(statefulProcessor=_Stories(hours), outputStructType="group_id long, state string, at_s long", outputMode="Append", timeMode="EventTime")


class _FirstOfHash(StatefulProcessor):
    """The signal that a hash was first seen with, for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "signal_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = pd.concat(list(rows)).sort_values(["at_s", "signal_id"])["signal_id"].astype(int).tolist()
        if not self.first.exists():
            self.first.update((ids[0],))
        first = self.first.get()[0]
        copies = [i for i in ids if i != first]
        yield pd.DataFrame({"signal_id": copies, "primary_id": [first] * len(copies)})

    def close(self) -> None:
        pass


def copies_of_any_age(signals: DataFrame, time: str) -> DataFrame:
    """(signal_id, primary_id) of signals whose content hash an earlier one had, however long ago: this state never goes.
    Likeness of titles, whose state does go, is the other path: deduplicated by normalized title within its hours."""
    signals.sparkSession.conf.set(*STORE)
    rows = signals.select("content_hash", "signal_id", F.unix_seconds(time).alias("at_s"))
    return rows.groupBy("content_hash").transformWithStateInPandas(statefulProcessor=_FirstOfHash(), outputStructType="signal_id long, primary_id long", outputMode="Append", timeMode="None")


def first_seen(sightings: DataFrame, time: str, key: str) -> DataFrame:
    """The first sight of each key, kept over all revisions; for update or complete mode."""
    return sightings.groupBy(key).agg(F.min(time).alias("first_seen_at"), F.count("*").alias("n_sightings"))


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there and return its table (tests and back-fills)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
