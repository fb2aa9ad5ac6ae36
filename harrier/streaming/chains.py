"""Story chains of a stream whose rows come late and in any order.

A key's state is its open chains: intervals of time that lie further apart than the gap. A row joins the interval that it is
near to, opens one of its own, or bridges two, one of which then goes: it is retracted. An interval that the watermark has
left by more than the gap can grow no more; it is closed and leaves the state, so what is kept of a key is bounded by the
time that rows may be late, not by its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harrier.functions import timegeo as T
from harrier.streaming.sightings import STORE

DAY = 86_400_000_000
CHANGES = "rule_group string, country string, start_us long, end_us long, n_signals long, representative_id long, change string"
Chain = list  # start, end, rows, best: [not official, -credibility, first seen, id]


def joined(chains: list[Chain], row: Chain, gap: int) -> tuple[list[Chain], list[Chain], Chain]:
    """(chains after a row has come, those that went, the one that has it). Chains are disjoint, gap or more apart."""
    near = [c for c in chains if row[0] - c[1] < gap and c[0] - row[1] < gap]
    parts = [*near, row]
    one = [min(c[0] for c in parts), max(c[1] for c in parts), sum(c[2] for c in parts), min(c[3] for c in parts)]
    return sorted([*(c for c in chains if c not in near), one]), near, one


class _Chains(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "chains string")

    def _rows(self, key, changes: list[tuple[Chain, str]]) -> Iterator[pd.DataFrame]:
        if changes:
            out = [(key[0], key[1], c[0], c[1], c[2], c[3][3], what) for c, what in changes]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])

    def _due(self, chain: Chain) -> int:
        """Milliseconds from which no row that is in time can join a chain."""
        return (chain[1] + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chains = json.loads(self.open.get()[0]) if self.open.exists() else []
        before = [list(c) for c in chains]
        for frame in rows:
            for at, official, rank, i in zip(frame["at_us"], frame["official"], frame["rank"], frame["signal_id"]):
                chains, _, _ = joined(chains, [int(at), int(at), 1, [int(not official), -int(rank), int(at), int(i)]], self.gap)
        gone, new = [c for c in before if c not in chains], [c for c in chains if c not in before]
        for c in gone:
            self.handle.deleteTimer(self._due(c))
        for c in new:
            self.handle.registerTimer(self._due(c))
        self.open.update((json.dumps(chains),))
        # A chain that only grew at its end is set again; one whose start is no chain's any more is retracted.
        starts = {c[0] for c in chains}
        yield from self._rows(key, [*((c, "gone") for c in gone if c[0] not in starts), *((c, "open") for c in new)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chains = json.loads(self.open.get()[0]) if self.open.exists() else []
        closed = [c for c in chains if self._due(c) <= expiredTimerInfo.getExpiryTimeInMs()]
        left = [c for c in chains if c not in closed]
        if left:
            self.open.update((json.dumps(left),))
        elif self.open.exists():
            self.open.clear()
        yield from self._rows(key, [(c, "closed") for c in closed])

    def close(self) -> None:
        pass


def chain_changes(signals: DataFrame, window_days: int = 1, late: str = "2 days") -> DataFrame:
    """CHANGES of story chains, per rule group and country (null keys are one), as rows (signal_id, rule_group, country,
    first_seen_at, is_official, credibility) come, up to `late` behind the newest: open (a chain as it stands now), gone
    (the chain of that start is part of another) or closed. Whole days of more than window_days part two chains, as in
    the batch's story_chains, and whatever the order of rows in time, the chains come out as there."""
    signals.sparkSession.conf.set(*STORE)
    rows = signals.withWatermark("first_seen_at", late).select(
        "rule_group", "country", "first_seen_at", "signal_id", F.unix_micros("first_seen_at").alias("at_us"),
        F.coalesce("is_official", F.lit(False)).alias("official"), T.lookup(F.col("credibility"), T.CREDIBILITY_RANK, 0).alias("rank"),
    )
    return rows.groupBy("rule_group", "country").transformWithStateInPandas(statefulProcessor=_Chains((window_days + 1) * DAY), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def latest_chains(changes: DataFrame, order: str = "number") -> DataFrame:
    """The chains that stand after all changes, each with the number of its batch: of each start the last change, unless it
    is gone."""
    key = ["rule_group", "country", "start_us"]
    last = changes.groupBy(*key).agg(F.max(F.struct(order, (F.col("change") != "gone").cast("int").alias("stands"), "end_us", "n_signals", "representative_id", "change")).alias("c"))
    return last.select(*key, "c.*").where("change <> 'gone'").drop(order, "stands")


def append_changes(path: str):
    """A foreachBatch sink that keeps every batch's changes under its number; a batch that is tried again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
