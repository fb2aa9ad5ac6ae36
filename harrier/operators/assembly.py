"""Event assembly in order: later clusters see the events that earlier ones opened or moved.

Clusters and events of different disease or country never meet, and an event is a candidate only if it was updated since
now minus the look-back. So a cluster that ended before then changes nothing for those after it: what it opens is never a
candidate, and what it joins keeps its time. Only the recent clusters need turns, and time bounds how many there are. They
go in order within their disease and country and leave a log of the candidates after each turn; all older clusters meet
the candidates as they stood at their place in the order, by an as-of join, at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import timegeo as T
from harrier.operators.events import MATCH_WEIGHTS, match_scores
from harrier.operators.graph import step_table

COLUMNS = ["id", "identity", "country", "admin1", "admin2", "precision", "latitude", "longitude", "at", "updated"]
ASSEMBLED = ["cluster_id", "decision", "event_id", "score"]
_EVENT = "id:bigint,admin1:string,admin2:string,precision:string,latitude:double,longitude:double,at:double,updated:double"
_TURNS = f"identity string, country string, cluster_id long, at double, decision string, event_id long, score double, top array<struct<{_EVENT}>>"
_FIELDS = [x.split(":")[0] for x in _EVENT.split(",")]
#: Shares of a disease and country's older clusters that look up the log apart; the log goes to each of them.
SHARES = 32


def _km(a: dict, b: dict) -> float:
    p, q = math.radians(a["latitude"]), math.radians(b["latitude"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["longitude"] - a["longitude"]) / 2) ** 2
    return T.EARTH_KM * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def score(a: dict, b: dict, km: float, days: float) -> float:
    """The match score of a cluster and an event of one disease and country (events.match_scores, one pair at a time)."""
    rank = min(T.PRECISION_RANK.get(x["precision"], 0) for x in (a, b))
    if rank == 0:
        return 0.0
    one, two = (a["admin1"], b["admin1"]), (a["admin2"], b["admin2"])
    gap = max(0.0, b["at"] - a["updated"], a["at"] - b["updated"]) / 86400
    if gap > days or None not in one and one[0] != one[1]:
        return 0.0
    if rank == 2 and None in one or rank == 3 and (None in two or two[0] != two[1]):
        return 0.0
    spatial = {1: 0.25, 2: 0.5, 3: 0.75}.get(rank)
    if rank == 4:
        d = _km(a, b)
        if d > km:
            return 0.0
        spatial = max(0.5, 1 - 0.5 * d / km)
    weight = T.PRECISION_WEIGHT.get(a["precision"], 0.0)
    total = MATCH_WEIGHTS["disease"] + MATCH_WEIGHTS["spatial"] * spatial + MATCH_WEIGHTS["temporal"] * (1 - gap / days) + MATCH_WEIGHTS["precision"] * weight
    return min(1.0, max(0.0, total))


def _turns(cutoff: float, newest: int, threshold: float, km: float, days: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The turns of one disease and country's recent clusters. A row each; with the candidates after it if older clusters
    may come next; a first row has those that were stored."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype(object).where(rows.notna(), None)
        live = rows[rows.kind == "event"].to_dict("records")
        block = rows.identity.iloc[0], rows.country.iloc[0]
        best = lambda: sorted(live, key=lambda e: (-e["updated"], e["id"]))[:newest]
        shown = lambda: [{k: e[k] for k in _FIELDS} for e in best()]
        out = [(*block, None, None, None, None, None, shown())]
        for c in sorted(rows[rows.kind == "cluster"].to_dict("records"), key=lambda r: (r["at"], r["id"])):
            over = [(s, e) for e in best() if (s := score(c, e, km, days)) >= threshold]
            if len(over) == 1:
                s, e = over[0]
                e["updated"] = max(e["updated"], c["updated"])
                said = ("attach", e["id"], s)
            else:
                live.append(dict(c))
                said = ("refuse" if over else "create", c["id"], max((s for s, _ in over), default=0.0))
            out.append((*block, c["id"], c["at"], *said, shown() if c["at"] < cutoff else None))
        table = pd.DataFrame(out, columns=["identity", "country", "cluster_id", "at", "decision", "event_id", "score", "top"])
        return table.astype({"cluster_id": "Int64", "event_id": "Int64", "at": "float64", "score": "float64"})

    return run


def _as_of(older: DataFrame, log: DataFrame) -> DataFrame:
    """older clusters with top, the candidates of the last turn before theirs. A disease and country's clusters are dealt
    to SHARES tasks, each of which has the log."""
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")
    first = F.lit(float("-inf"))
    turns = log.select("identity", "country", F.coalesce("at", first).alias("at"), F.coalesce("cluster_id", F.lit(-(1 << 63))).alias("id"), "top", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    both = older.withColumn("share", share).unionByName(turns.withColumn("_turn", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("identity", "country", "share").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("top", F.last("top", ignorenulls=True).over(before)).where("_turn IS NULL").drop("_turn", "share")


def _decided(older: DataFrame, threshold: float, km: float, days: float) -> DataFrame:
    """Decisions on older clusters with the candidates that they meet."""
    time = F.timestamp_seconds
    place = lambda c: F.struct(F.col("country").alias("country"), *[F.col(f"{c}{x}").alias(x) for x in ("admin1", "admin2", "latitude", "longitude", "precision")])
    met = older.withColumn("e", F.explode("top")).select(
        F.col("id").alias("cluster_id"), "identity", F.col("identity").alias("o_identity"), place("").alias("place"), place("e.").alias("o_place"),
        time("at").alias("start"), time("updated").alias("end"), time("e.at").alias("o_start"), time("e.updated").alias("o_end"), F.col("e.id").alias("event_id"),
    )
    over = match_scores(met, km, days, threshold).where(F.col("score") >= threshold)
    found = over.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("event_id").alias("event_id"))
    j = older.select(F.col("id").alias("cluster_id")).join(found, "cluster_id", "left")
    attach = F.coalesce(F.col("n") == 1, F.lit(False))
    decision = F.when(attach, "attach").when(F.col("n") > 1, "refuse").otherwise("create")
    return j.select("cluster_id", decision.alias("decision"), F.when(attach, F.col("event_id")).otherwise(F.col("cluster_id")).alias("event_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def assemble(clusters: DataFrame, events: DataFrame, now: float, lookback_days: float = 7, newest: int = 20, threshold: float = 0.60, km: float = 50.0, days: float = 90.0) -> DataFrame:
    """(cluster_id, decision, event_id, score). clusters and events: id, identity, country, admin1, admin2, precision,
    latitude, longitude, at and updated (seconds: first and last time); ids of clusters are those of no event.

    In the order of at and id, a cluster attaches to the one event that reaches the threshold among the newest few updated
    within lookback_days of now. If several do, it is refused, and like one that none matches it opens an event named by
    its own id. Clusters without disease or country open events of their own."""
    spark, cutoff = clusters.sparkSession, now - lookback_days * 86400
    known = F.col("identity").isNotNull() & F.col("country").isNotNull()
    clusters = step_table(spark, clusters.select(*COLUMNS), "clusters")
    recent, live = (F.col("updated") >= cutoff) & known, events.select(*COLUMNS, F.lit("event").alias("kind")).where((F.col("updated") >= cutoff) & known)
    blocks = clusters.where(recent).withColumn("kind", F.lit("cluster")).unionByName(live).groupBy("identity", "country")
    turns = step_table(spark, blocks.applyInPandas(_turns(cutoff, newest, threshold, km, days), _TURNS), "turns")
    older = _as_of(clusters.where(~recent & known), turns.where("top IS NOT NULL"))
    alone = clusters.where(~known).select(F.col("id").alias("cluster_id"), F.lit("create").alias("decision"), F.col("id").alias("event_id"), F.lit(0.0).alias("score"))
    return turns.where("cluster_id IS NOT NULL").select(*ASSEMBLED).unionByName(_decided(older, threshold, km, days)).unionByName(alone)
