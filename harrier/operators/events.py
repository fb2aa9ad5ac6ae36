"""Events: clusters of signals, the match of a cluster with the events there are, and what a decision writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T
from harrier.operators.graph import components, step_table

#: Weights of a match, and of the likeness of embeddings on top.
MATCH_WEIGHTS = {"disease": 0.30, "spatial": 0.35, "temporal": 0.20, "precision": 0.15}
SIMILARITY_WEIGHT = 0.15
_PLACE = ("country", "admin1", "admin2", "latitude", "longitude", "precision")


def clusterable(signals: DataFrame) -> DataFrame:
    """Adds identity, at, place and whether a signal can be clustered at all."""
    d = signals.withColumn("identity", X.disease_identity(F.col("disease_id"), F.col("disease_text"))).withColumn("at", F.coalesce("published_at", "first_seen_at"))
    return d.withColumn("place", F.struct(*_PLACE)).withColumn("clusterable", F.col("identity").isNotNull() & F.col("country").isNotNull() & (F.col("precision") != "unresolved"))


def _anchored(members: DataFrame, anchors: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Edges (a, b) that join members as links to all anchors of the same keys within width seconds would.

    members, anchors: keys, signal_id, t. Anchors of one span of that width are within width of each other. So a member
    needs one anchor of its own span, the last one of the span before and the first one of the span after, each if near
    enough; a span's anchors need its least id. Each anchor is a member, too."""
    span = F.floor(F.col("t") / width).cast("long")
    spans = anchors.withColumn("span", span).groupBy(*keys, "span").agg(F.min("signal_id").alias("b"), F.min(F.struct("t", "signal_id")).alias("first"), F.max(F.struct("t", "signal_id")).alias("last"))
    m = members.withColumn("span", span).select(*keys, "span", "t", "signal_id")
    own = m.join(spans.select(*keys, "span", "b"), [*keys, "span"]).select(F.col("signal_id").alias("a"), "b")
    before = m.join(spans.select(*keys, (F.col("span") + 1).alias("span"), "last"), [*keys, "span"]).where(F.col("t") - F.col("last.t") <= width).select(F.col("signal_id").alias("a"), F.col("last.signal_id").alias("b"))
    after = m.join(spans.select(*keys, (F.col("span") - 1).alias("span"), "first"), [*keys, "span"]).where(F.col("first.t") - F.col("t") <= width).select(F.col("signal_id").alias("a"), F.col("first.signal_id").alias("b"))
    return own.unionByName(before).unionByName(after)


def _near_places(points: DataFrame, width: float, km: float) -> DataFrame:
    """Edges between signals with a position that are within km and width seconds. Signals of one position and span of
    time are within both, and only their least ids and first and last times go further: what meets is positions, by grid
    cells that are km wide, not signals."""
    keys = ["identity", "country", "latitude", "longitude", "span"]
    p = points.withColumn("span", F.floor(F.col("t") / width).cast("long"))
    spots = p.groupBy(*keys).agg(F.min("signal_id").alias("id"), F.min(F.struct("t", "signal_id")).alias("first"), F.max(F.struct("t", "signal_id")).alias("last"))
    star = p.join(spots.select(*keys, "id"), keys).select(F.col("signal_id").alias("a"), F.col("id").alias("b"))
    side = km / (T.EARTH_KM * 3.141592653589793 / 180) * 1.0001  # degrees of latitude that km make
    row = F.floor(F.col("latitude") / side).cast("long")
    # A cell's width in degrees of longitude is that of the row's edge nearest to a pole, so no neighbour is further off.
    edge = lambda r: F.greatest(F.abs(r * side), F.abs((r + 1) * side)) + side
    wide = lambda r: F.when(edge(r) > 88.0, 360.0).otherwise(F.least(F.lit(360.0), F.lit(side) / F.cos(F.radians(edge(r)))))
    column = lambda lon, r: F.floor((lon + 180) / wide(r)).cast("long")
    cells = lambda r: F.floor(F.lit(360.0) / wide(r)).cast("long")
    here = spots.withColumn("row", row).withColumn("column", column(F.col("longitude"), F.col("row")))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    seen = spots.withColumn("row", F.explode(F.transform(step, lambda d: row + d)))
    # Over the date line the last cell's neighbour is the first; the last one may be narrow, so two from each end.
    at = column(F.col("longitude"), F.col("row"))
    around = F.array_distinct(F.flatten(F.array(F.transform(step, lambda d: at + d), F.when(at <= 1, F.array(cells(F.col("row")), cells(F.col("row")) - 1)).otherwise(F.array().cast("array<bigint>")), F.when(at >= cells(F.col("row")) - 1, F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>")))))
    seen = seen.withColumn("column", F.explode(around)).select("identity", "country", "row", "column", *[F.col(c).alias(f"o_{c}") for c in ("latitude", "longitude", "span", "id", "first", "last")])
    met = here.join(seen, ["identity", "country", "row", "column"]).where("span = o_span AND id < o_id OR span + 1 = o_span")
    close = T.haversine_km(F.col("latitude"), F.col("longitude"), F.col("o_latitude"), F.col("o_longitude")) <= km
    linked = met.where(close & ((F.col("span") == F.col("o_span")) | (F.col("o_first.t") - F.col("last.t") <= width)))
    ends = F.when(F.col("span") == F.col("o_span"), F.struct(F.col("id").alias("a"), F.col("o_id").alias("b"))).otherwise(F.struct(F.col("last.signal_id").alias("a"), F.col("o_first.signal_id").alias("b")))
    return star.unionByName(linked.select(ends.alias("e")).select("e.*"))


def cluster_edges(signals: DataFrame, window_days: int = 7, km: float = 50.0) -> DataFrame:
    """Edges with the connected components of all pairs of signals of one disease within window_days whose places agree
    at the coarser of their precisions. Each rung of precision anchors what is as fine or finer in its unit; the number
    of edges grows with the signals, not with their pairs."""
    width = window_days * 86400.0
    rank = T.lookup(F.col("precision"), T.PRECISION_RANK, 0)
    c = clusterable(signals).where("clusterable").select("signal_id", "identity", "country", "admin1", "admin2", "latitude", "longitude", rank.alias("rank"), T.seconds(F.col("at")).alias("t"))
    c = step_table(signals.sparkSession, c, "clusterable")
    unit = lambda r, *names: (c.where(reduce(lambda a, b: a & b, [F.col("rank") >= r, *[F.col(n).isNotNull() for n in names]])), ["identity", "country", *names])
    edges = []
    for r, names in ((1, ()), (2, ("admin1",))):
        members, keys = unit(r, *names)
        edges.append(_anchored(members, members.where(F.col("rank") == r), keys, width))
    # Second level units: the first level may be unknown on a side, but not differ. The unknown meet every known one.
    members, keys = unit(3, "admin2")
    anchors = members.where("rank = 3")
    known, unknown = anchors.where("admin1 IS NOT NULL"), anchors.where("admin1 IS NULL")
    edges.append(_anchored(members.where("admin1 IS NOT NULL"), known, [*keys, "admin1"], width))
    edges.append(_anchored(members, unknown, keys, width))
    units = known.select(*keys, "admin1").distinct()
    edges.append(_anchored(members.where("admin1 IS NULL").drop("admin1").join(units, keys), known, [*keys, "admin1"], width))
    points, _ = unit(4, "latitude", "longitude")
    edges.append(_near_places(points, width, km))
    return reduce(DataFrame.unionByName, edges).where("a <> b")


def cluster(spark: SparkSession, signals: DataFrame, window_days: int = 7, km: float = 50.0) -> DataFrame:
    """(signal_id, cluster_id): single link over signals of one disease whose times and places agree; the least id of a
    cluster names it, null where a signal cannot be clustered."""
    found = components(spark, cluster_edges(signals, window_days, km))
    c = clusterable(signals).select("signal_id", "clusterable")
    own = F.when(F.col("clusterable"), F.coalesce("component", "signal_id"))
    return c.join(found.withColumnRenamed("node", "signal_id"), "signal_id", "left").select("signal_id", own.alias("cluster_id"))


def finest_place(order: Column) -> Column:
    """Aggregate: the place of finest precision, the first in an order of equally fine ones."""
    return F.min_by("place", F.struct((-T.lookup(F.col("place.precision"), T.PRECISION_RANK, 0)).alias("p"), order.alias("o")))


def cluster_facts(signals: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: identity, its first member's disease, the first text and embedding that are not null, the finest
    place, span and members, in the order of time and id. number: of a disease's clusters, by span start and first member."""
    m = clusterable(signals).join(clusters.where("cluster_id IS NOT NULL"), "signal_id")
    order = F.struct("at", "signal_id")
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    g = m.groupBy("cluster_id").agg(
        F.min("identity").alias("identity"), F.min_by("disease_id", order).alias("disease_id"), known("disease_text").alias("disease_text"), F.min("country").alias("country"),
        finest_place(order).alias("place"), F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n_signals"), F.min_by("signal_id", order).alias("first_id"),
    )
    return g.withColumn("number", F.row_number().over(Window.partitionBy("identity").orderBy("start", "first_id")))


def candidate_events(clusters: DataFrame, events: DataFrame, now: Column, lookback_days: int = 7, newest: int = 20) -> DataFrame:
    """Pairs of clusters (cluster_id, identity, country, place, start, end) and events (event_id, the same, updated) of one
    disease and country, the events updated within lookback_days; the newest few of each cluster."""
    recent = events.where(F.col("updated") >= now - F.make_interval(days=F.lit(lookback_days)))
    # The newest events of a disease and country are the same for all its clusters, so they are chosen before the join.
    top = recent.withColumn("_n", F.row_number().over(Window.partitionBy("identity", "country").orderBy(F.desc("updated"), "event_id"))).where(F.col("_n") <= newest)
    o = top.select("identity", "country", "event_id", F.col("identity").alias("o_identity"), F.col("place").alias("o_place"), F.col("start").alias("o_start"), F.col("updated").alias("o_end"))
    return clusters.join(o, ["identity", "country"])


def match_scores(pairs: DataFrame, km: float = 50.0, days: float = 90.0, threshold: float = 0.60, review: float | None = None, similarity: Column | None = None) -> DataFrame:
    """Pairs with identity, place, start and end, and the same with o_: score of the match, 0 if anything rules it out, and
    the first reason against it. similarity: a cosine that may lift a score, never one that is ruled out."""
    near = T.haversine_km(*[F.col(f"{p}.{c}") for p in ("place", "o_place") for c in ("latitude", "longitude")])
    shared = F.least(*[T.lookup(F.col(f"{p}.precision"), T.PRECISION_RANK, 0) for p in ("place", "o_place")])
    weight = T.lookup(F.col("place.precision"), T.PRECISION_WEIGHT, 0.0)
    same = F.coalesce(F.col("identity") == F.col("o_identity"), F.lit(False))
    fits = T.spatially_compatible("place", "o_place", km)
    spatial = F.when(shared == 4, F.greatest(F.lit(0.5), 1 - 0.5 * near / km)).when(shared == 3, 0.75).when(shared == 2, 0.5).otherwise(0.25)
    gap = T.span_gap_days(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))
    total = MATCH_WEIGHTS["disease"] + MATCH_WEIGHTS["spatial"] * spatial + MATCH_WEIGHTS["temporal"] * F.greatest(F.lit(0.0), 1 - gap / days) + MATCH_WEIGHTS["precision"] * weight
    total = T.clamp(total)
    if similarity is not None:
        total = F.least(F.lit(1.0), total + SIMILARITY_WEIGHT * F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0))))
    veto = F.coalesce(F.col("place.admin1") != F.col("o_place.admin1"), F.lit(False))
    against = F.when(~same, "disease_mismatch").when(veto, "conflicting_admin1").when(gap > days, "outside_time_window").when(~fits, "too_far")
    least = threshold if review is None else min(threshold, review)
    out = pairs.withColumn("reason", against).withColumn("score", F.when(F.col("reason").isNull(), total).otherwise(0.0))
    return out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("score") < least), "score_below_threshold").otherwise(F.col("reason")))


def decide(scored: DataFrame, key: str, threshold: float = 0.60, review: float | None = None) -> DataFrame:
    """One match attaches, two or more are refused, one in the review band is ambiguous, none creates."""
    over = F.col("score") >= threshold
    band = (~over & (F.col("score") >= review)) if review is not None else F.lit(False)
    g = scored.groupBy(key).agg(F.count_if(over).alias("n_over"), F.count_if(band).alias("n_band"), F.max_by("event_id", F.when(over, F.col("score"))).alias("best"), F.max_by("event_id", F.when(band, F.col("score"))).alias("near"))
    g = g.withColumn("decision", F.when(F.col("n_over") == 1, "attach").when(F.col("n_over") > 1, "refuse").when(F.col("n_band") == 1, "ambiguous").otherwise("create"))
    return g.select("*", F.when(F.col("decision") == "attach", F.col("best")).alias("event_id"), F.when(F.col("decision") == "ambiguous", F.col("near")).alias("ambiguous_id")).drop("best", "near")


def finalized_links(members: DataFrame, decisions: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows to append to the links of events and signals: members (cluster_id, signal_id, at) of clusters with a decision
    (cluster_id, decision, event_id, score). An attached cluster supports its event; any other one opens an event named by
    its first member, which is its initial report and primary. What is linked (event_id, signal_id) already stays."""
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy("at", "signal_id"))
    m = members.withColumn("_n", first).join(decisions.select("cluster_id", "decision", F.col("event_id").alias("_e"), "score"), "cluster_id")
    attach = F.col("decision") == "attach"
    opened = F.min(F.when(F.col("_n") == 1, F.col("signal_id"))).over(Window.partitionBy("cluster_id"))
    rows = m.select(
        F.when(attach, F.col("_e")).otherwise(-1 - opened).alias("event_id"), "signal_id",
        F.when(attach | (F.col("_n") > 1), "supporting_source").otherwise("initial_report").alias("relationship_type"),
        F.when(attach, F.col("score")).otherwise(1.0).alias("match_score"), (~attach & (F.col("_n") == 1)).alias("is_primary"),
    )
    return rows.join(linked.select("event_id", "signal_id"), ["event_id", "signal_id"], "left_anti")


def new_observations(links: DataFrame, signals: DataFrame, stored: DataFrame) -> DataFrame:
    """One observation for each link whose signal states any count, unless the pair (event_id, signal_id) has one."""
    s = signals.where("total_cases IS NOT NULL").select("signal_id", F.to_date("published_at").alias("observation_date"), F.coalesce("published_at", "first_seen_at").alias("reported_at"), "total_cases", "confidence")
    return links.select("event_id", "signal_id").join(s, "signal_id").join(stored.select("event_id", "signal_id"), ["event_id", "signal_id"], "left_anti")


def summaries_due(events: DataFrame, observations: DataFrame, now: Column, max_age_hours: int, limit: int) -> DataFrame:
    """Events without a summary, with an observation since the last one, or with one that is too old: one row for each,
    the latest update first, the page being the limit."""
    last = observations.groupBy("event_id").agg(F.max("reported_at").alias("_seen"))
    j = events.join(last, "event_id", "left")
    due = F.col("last_summarized_at").isNull() | F.coalesce(F.col("_seen") > F.col("last_summarized_at"), F.lit(False)) | (F.col("last_summarized_at") < now - F.make_interval(hours=F.lit(max_age_hours)))
    return j.where(due).groupBy("event_id").agg(F.max("updated").alias("updated")).orderBy(F.desc("updated"), "event_id").limit(limit)


def delta_targets(attached: DataFrame, signals: DataFrame, events: DataFrame, now: Column, days: float = 10) -> DataFrame:
    """(cluster_id, event_id, signal_id) of the attached clusters (cluster_id, event_id) that a delta pass is due for: the
    event has a brief and was updated within days; the target is the newest member with a brief."""
    due = attached.join(events.where(F.col("has_brief") & (T.seconds(now) - T.seconds(F.col("updated")) <= days * 86400.0)).select("event_id"), "event_id", "left_semi")
    return due.join(signals.where("n_brief > 0"), "cluster_id").groupBy("cluster_id", "event_id").agg(F.max_by("signal_id", F.struct(F.coalesce("published_at", "first_seen_at"), -F.col("signal_id"))).alias("signal_id"))
