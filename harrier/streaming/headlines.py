"""Alike headlines in a stream: pairs of signals whose token sets are alike and whose times are near, late rows included.

Alike sets share a token among the first few of each, in any fixed order of tokens (here that of a hash). So a signal goes to
the state of each of its first few tokens, meets the signals there, and is verified on the spot; the first token that both
have among theirs reports the pair, so that it comes once. A signal leaves the state when the watermark has passed it by the
time that a pair may lie apart: no row that is still in time can pair with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harrier.functions import text as X
from harrier.streaming.sightings import STORE

PAIRS = "signal_id long, other_id long"
HOUR_MS = 3_600_000


def prefix(n: int, least: float) -> int:
    """How many of n tokens, in order, one of which any alike set has among its own first ones."""
    return int(n * (1 - least) + 1e-9) + 1


def alike(a: list[str], b: list[str], least: float) -> bool:
    both = len(set(a).intersection(b))
    return both >= least * (len(a) + len(b) - both) - 1e-9


class _Headlines(StatefulProcessor):
    def __init__(self, hours: int, least: float):
        self.reach, self.least = hours * HOUR_MS, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Signals by token set, so that a set is compared once however many signals have it.
        self.held = handle.getMapState("held", "tokens string", "signals string")

    def _reports(self, key: str, a: list[str], b: list[str]) -> bool:
        """Is key the first token that both have among their first ones?"""
        other = set(b[: prefix(len(b), self.least)])
        return next(t for t in a[: prefix(len(a), self.least)] if t in other) == key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: json.loads(v[0]) for k, v in self.held.iterator()}
        out, changed, due = [], set(), set()
        for frame in rows:
            for at, i, tokens in zip(frame["at_ms"].astype(int), frame["signal_id"].astype(int), frame["tokens"]):
                mine, own = list(tokens), json.dumps(list(tokens))
                for name, signals in held.items():
                    theirs = mine if name == own else json.loads(name)
                    if alike(mine, theirs, self.least) and self._reports(key[0], mine, theirs):
                        out += [(min(i, j), max(i, j)) for t, j in signals if abs(t - at) <= self.reach and i != j]
                held.setdefault(own, []).append([int(at), int(i)])
                changed.add(own)
                due.add(((int(at) + self.reach) // HOUR_MS + 1) * HOUR_MS)
        for name in changed:
            self.held.updateValue((name,), (json.dumps(held[name]),))
        for at in due:
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=["signal_id", "other_id"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in list(self.held.iterator()):
            signals = json.loads(v[0])
            left = [s for s in signals if s[0] + self.reach >= now]
            if not left:
                self.held.removeKey((k[0],))
            elif len(left) < len(signals):
                self.held.updateValue((k[0],), (json.dumps(left),))
        yield pd.DataFrame([], columns=["signal_id", "other_id"]).astype("int64")

    def close(self) -> None:
        pass


def alike_headlines(signals: DataFrame, hours: int = 72, least: float = 0.9, late: str = "1 hour") -> DataFrame:
    """(signal_id, other_id), the lesser first, of signals (signal_id, title, first_seen_at) that are no more than hours
    apart and whose title tokens have a Jaccard likeness of least or more; each pair once. Rows may come in any order up to
    `late` behind the newest. Titles without tokens pair with none."""
    signals.sparkSession.conf.set(*STORE)
    tokens = F.transform(F.array_sort(F.transform(X.title_tokens(F.col("title")), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), lambda x: x["t"])
    rows = signals.withWatermark("first_seen_at", late).select("first_seen_at", "signal_id", F.unix_millis("first_seen_at").alias("at_ms"), tokens.alias("tokens")).where("size(tokens) > 0")
    some = (F.floor(F.size("tokens") * (1 - least) + 1e-9) + 1).cast("int")
    keyed = rows.withColumn("k", F.explode(F.slice("tokens", F.lit(1), some)))
    return keyed.groupBy("k").transformWithStateInPandas(statefulProcessor=_Headlines(hours, least), outputStructType=PAIRS, outputMode="Append", timeMode="EventTime")
