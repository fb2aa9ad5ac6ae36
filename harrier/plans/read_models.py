"""Read models: evidence page, radar, event list and detail, spend, backlog, schema report, a reader's filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T


def _at() -> Column:
    return F.coalesce("published_at", "first_seen_at")


def evidence_page(signals: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Signals with a body, newest published first (nulls last), and the counts of all of them beside each."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is 1 to 50")
    s = signals.where("length(trim(raw_text)) > 0")
    page = s.orderBy(F.desc_nulls_last("published_at"), F.desc("first_seen_at"), "signal_id").limit(limit + offset).offset(offset) if offset else s.orderBy(F.desc_nulls_last("published_at"), F.desc("first_seen_at"), "signal_id").limit(limit)
    totals = s.agg(F.count("*").alias("n_total"), F.countDistinct("source").alias("n_sources"))
    return page.select("signal_id", "title", "source", "published_s").crossJoin(F.broadcast(totals))  # totals: one row


def radar(signals: DataFrame, now: Column, hours: int = 48, limit: int = 50, chunk: int = 50, max_scan: int | None = None) -> DataFrame:
    """The first `limit` valid signals of the window among the first max_scan (rounded up to a chunk), by effective time,
    heat and id; signals that share an event are one group row, the others rows of their own."""
    if not (1 <= hours <= 168 and 1 <= limit <= 100):
        raise ValueError("hours is 1 to 168, limit 1 to 100")
    scan = -(-(max_scan or max(limit * 5, 100)) // chunk) * chunk
    seen = signals.where(_at().between(now - F.make_interval(hours=F.lit(hours)), now) & F.col("status").isin("extracted", "matched", "normalized"))
    # Top-k by the window's order, then validity, then the page: both limits are the feature.
    top = seen.orderBy(F.desc(_at()), F.desc_nulls_last("heat"), "signal_id").limit(scan)
    valid = top.where(X.hash_holds(F.col("title"), F.col("raw_text"), F.col("stored_hash"))).orderBy(F.desc(_at()), F.desc_nulls_last("heat"), "signal_id").limit(limit)
    grouped = valid.withColumn("_n", F.count("*").over(Window.partitionBy("event_key")))
    unit = F.when((F.col("_n") >= 2) & F.col("event_key").isNotNull(), F.concat(F.lit("e"), "event_key")).otherwise(F.concat(F.lit("s"), "signal_id"))
    g = grouped.withColumn("unit", unit).groupBy("unit").agg(
        F.count("*").alias("n"), F.max_by("signal_id", F.struct(_at(), -F.col("signal_id"))).alias("representative"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("published_s").alias("first_published_s"), F.max("published_s").alias("last_published_s"), F.min("first_seen_s").alias("first_seen_s"),
    )
    return g.orderBy(F.desc(F.coalesce("last_published_s", "first_seen_s")), "unit")


def representative_places(places: DataFrame) -> DataFrame:
    """One plottable place per signal: primary first, then the finest, then the least place id."""
    ok = F.col("latitude").isNotNull() & ~F.isnan("latitude") & F.col("longitude").isNotNull() & ~F.isnan("longitude") & (F.col("precision") != "unresolved")
    rank = F.struct((F.col("role") != "primary").alias("r"), (-T.lookup(F.col("precision"), T.PRECISION_RANK, 0)).alias("p"), F.col("place_id"))
    return places.where(ok).groupBy("signal_id").agg(F.min_by(F.struct("place_id", "precision", "latitude", "longitude", X.country_code(F.col("country")).alias("country")), rank).alias("p")).select("signal_id", "p.*")


def event_list(events: DataFrame, *, disease: str | None = None, country: str | None = None, admin1: str | None = None, status: str | None = None, verification: str | None = None, start: Column | None = None, end: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Events by optional filters, the latest update first; the range of times is half open. A unit's name matches in part,
    and its wildcards count. n_total: how many there are on all pages."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    tests = [
        F.lower("disease") == disease.lower() if disease else None, F.col("country") == country.upper() if country else None, F.col("admin1").ilike(f"%{admin1}%") if admin1 else None, F.col("status") == status if status else None,
        F.col("verification") == verification if verification else None, F.col("last_updated_at") >= start if start is not None else None, F.col("last_updated_at") < end if end is not None else None,
    ]
    kept = events.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))
    page = kept.orderBy(F.desc("last_updated_at"), F.desc("event_key")).limit(limit + offset).offset(offset)
    return page.crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_total"))))  # one row


def event_sources(links: DataFrame, signals: DataFrame, sources: DataFrame, event_id: int | None = None) -> DataFrame:
    """The articles of one event (of every event without event_id), with their sources' standing and position: primary
    first, then the latest, then the greatest id."""
    l = links if event_id is None else links.where(F.col("event_id") == event_id)
    j = l.join(signals, "signal_id").join(sources, "source")
    w = Window.partitionBy("event_id").orderBy(F.desc("is_primary"), F.desc(_at()), F.desc("signal_id"))
    return j.select("event_id", F.row_number().over(w).alias("position"), "signal_id", "source", "is_official", "credibility", "title", "published_at", "first_seen_at", "relationship_type", "is_primary")


def event_observations(observations: DataFrame, event_id: int | None = None) -> DataFrame:
    """The observations of one event (of every event without event_id) by the time of their report."""
    o = observations if event_id is None else observations.where(F.col("event_id") == event_id)
    w = Window.partitionBy("event_id").orderBy(F.coalesce("reported_at", "created_at"), "created_at", "signal_id")
    return o.withColumn("position", F.row_number().over(w))


def event_summaries(summaries: DataFrame) -> DataFrame:
    """Versions of events' summaries, the newest first."""
    return summaries.withColumn("position", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("version"))))


def event_details(events: DataFrame, sources: DataFrame, observations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Events with what belongs to each, in order: sources, observations, summaries as arrays. For one event, filter first."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = ["position", *[c for c in df.columns if c not in ("event_id", "position")]]
        return df.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    out = events
    for df, name in ((sources, "sources"), (observations, "observations"), (summaries, "summaries")):
        out = out.join(listed(df, name), "event_id", "left")
    return out


def spend(ledger: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Requests and cost by model, purpose and outcome of the trailing days, the dearest first."""
    recent = ledger.where((F.col("at") >= now - F.make_interval(days=F.lit(days))) & (F.col("at") <= now))
    return recent.groupBy("model", "purpose", "outcome").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(12,6)")).alias("cost")).orderBy(F.desc("cost"), "model", "purpose", "outcome")


def within_budget(requests: DataFrame, order: str, cost: str, budget: float, by: str) -> DataFrame:
    """Requests that start before their share's running cost has used the budget up; shares are the values of by."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("_spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("_spent") < budget).drop("_spent")


def backlog(signals: DataFrame) -> DataFrame:
    return signals.groupBy("status").agg(F.count("*").alias("n"))


def source_counts(sources: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals per source, sources without any included."""
    n = signals.groupBy("source").agg(F.count("*").alias("_n"))
    return sources.join(n, "source", "left").select("source", F.coalesce("_n", F.lit(0)).alias("n_signals"))


def schema_report(spark: SparkSession, expected: list[str], tables: dict[str, DataFrame], key: str | None = None) -> DataFrame:
    """Each expected table: its state (missing, empty or filled) and its rows."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items() if t in expected]
    names = spark.createDataFrame([(t,) for t in sorted(expected)], "table_name string")
    found = reduce(DataFrame.unionByName, counts) if counts else names.select("table_name", F.lit(0).alias("n")).limit(0)
    j = names.join(found, "table_name", "left")
    return j.select("table_name", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("filled").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def within_reach(events: DataFrame, text: str | None = None, regions: dict[str, list[str]] | None = None, region: str | None = None, now: Column | None = None, hours: int | None = None, first_day: Column | None = None, last_day: Column | None = None) -> DataFrame:
    """What a reader's filters leave: a text anywhere in title, disease, country or unit; a region's countries; the last
    hours, or days from first to last, both included; the latest first."""
    hay = F.lower(F.concat_ws(" ", "title", "disease", "country", "admin1"))
    tests = [
        F.contains(hay, F.lit(text.strip().lower())) if text and text.strip() else None, F.col("country").isin(*(regions or {})[region]) if region else None,
        F.col("last_updated_at") >= now - F.make_interval(hours=F.lit(hours)) if hours else None,
        F.to_date("last_updated_at") >= first_day if first_day is not None else None, F.to_date("last_updated_at") <= last_day if last_day is not None else None,
    ]
    return events.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))).orderBy(F.desc("last_updated_at"), "event_key")


def shown_totals(events: DataFrame) -> DataFrame:
    """One row for a page's head: events, those on the map, the active ones, countries, and the choices of its filters."""
    on_map = F.col("latitude").isNotNull() & ~F.isnan("latitude") & F.col("longitude").isNotNull() & ~F.isnan("longitude")
    return events.agg(F.count("*").alias("n_events"), F.count_if(on_map).alias("n_mapped"), F.count_if(F.col("status") == "active").alias("n_active"), F.countDistinct("country").alias("n_countries"), F.array_sort(F.collect_set("disease")).alias("diseases"), F.array_sort(F.collect_set("country")).alias("countries"))
