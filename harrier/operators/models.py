"""Model passes with an injected callable: the roster, the ladder, and what its attempts cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.functions import timegeo as T

ATTEMPTS = "id string, model string, tier int, attempt int, outcome string, reason string, content string, tokens_in long, tokens_out long"


def roster(models: DataFrame, purpose: str, max_tier: int, min_tier: int = 1) -> DataFrame:
    """Active models for a purpose within the tiers, cheapest tier first; without one above min_tier, all up to max_tier."""
    fit = models.where(F.col("active") & (F.col("purpose").isNull() | (F.col("purpose") == purpose)) & (F.col("tier") <= max_tier))
    high = fit.where(F.col("tier") >= min_tier)
    return (high if high.limit(1).count() else fit).orderBy("tier", "model_id")


def climb(requests: DataFrame, ladder: list[tuple[str, int]], call: Callable[[str, str, str], tuple[str, int, int]], check: Callable[[str, str], str | None], per_partition: int | None = None) -> DataFrame:
    """Ask each rung (model, tier) once and, with the fault named, once more; stop at the first answer without fault.

    requests: id, prompt, body. call(model, prompt, fault) gives (content, tokens in, tokens out); check(content, body)
    gives the fault or None. per_partition: the share of a budget of requests that a partition may use; what it leaves
    over comes out as outcome deferred."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                fault, done = None, False
                for model, tier in ladder:
                    fault = None
                    for attempt in (1, 2):
                        if per_partition is not None and used >= per_partition:
                            out.append((r.id, model, tier, attempt, "deferred", "budget", None, 0, 0))
                            done = True
                            break
                        used += 1
                        content, tokens_in, tokens_out = call(model, r.prompt, fault or "")
                        fault = check(content, r.body)
                        out.append((r.id, model, tier, attempt, "rejected" if fault else "accepted", fault, content, tokens_in, tokens_out))
                        if not fault:
                            done = True
                            break
                    if done:
                        break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

    return requests.select("id", "prompt", "body").mapInPandas(run, ATTEMPTS)


def ask(requests: DataFrame, call: Callable[[str, str], tuple[str, int, int]], check: Callable[[str, str], str | None], model: str = "model") -> DataFrame:
    """One model, with one repair: the climb of a ladder of one rung. call(prompt, fault), check(content, body)."""
    return climb(requests, [(model, 1)], lambda _, prompt, fault: call(prompt, fault), check)


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """(key, embedding) of texts in batches of an injected model, vectors at length 1 (a zero vector as it is)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [v for lo in range(0, len(frame), batch) for v in embed(frame[text].iloc[lo : lo + batch].tolist())]
            yield pd.DataFrame({key: frame[key], "embedding": [list(map(float, v)) for v in vectors]})

    raw = rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")
    return raw.withColumn("embedding", T.unit(F.col("embedding")))


def unsummarized(signals: DataFrame, summaries: DataFrame, key: str = "event_key") -> DataFrame:
    """Per event: articles first seen after its last summary (all of them without one)."""
    last = summaries.groupBy(key).agg(F.max("created_at").alias("_last"))
    return signals.join(last, key, "left").groupBy(key).agg(F.count_if(F.col("_last").isNull() | (F.col("first_seen_at") > F.col("_last"))).alias("n_new"))


def same_counts(left: str, right: str, names: tuple[str, ...]) -> F.Column:
    """Equality of two structs of counts, missing ones equal to missing ones; two null structs are equal."""
    out = F.col(left).isNull().eqNullSafe(F.col(right).isNull())
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out
