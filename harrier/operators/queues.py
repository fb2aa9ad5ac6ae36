"""Work queues: which signals a stage takes next, by status, oldest first, up to a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses whose stored extraction a backfill may renew, and the versions of stored extractions.
BACKFILLED = ("extracted", "geocoded", "matched", "published")
LEAST_VERSION, VERSION = 2, 3
MOST_MEMBERS = 4


def oldest(signals: DataFrame, limit: int) -> DataFrame:
    """The first of a queue, by first sight and id; the limit is the feature."""
    return signals.orderBy("first_seen_at", "signal_id").limit(limit)


def oldest_valid(signals: DataFrame, valid: Column, limit: int) -> DataFrame:
    """The first valid signals among the first of a queue: chunks of max(limit, 20) are read until max(5 limit, 100) rows
    have been, so that a run of broken rows costs a bounded scan."""
    chunk, most = max(limit, 20), max(5 * limit, 100)
    return oldest(oldest(signals, -(-most // chunk) * chunk).where(valid), limit)


def deferred(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Signals that wait for the representative of an open group."""
    return members.where("role = 'deferred'").join(groups.where("state = 'open'").select("group_id"), "group_id", "left_semi").select("signal_id").distinct()


def status_queue(signals: DataFrame, waiting: DataFrame, stage: str, attempts: int = 3) -> DataFrame:
    """What a stage may take: signals (status, raw_text, attempts, triage_status, relevant, embedded, extraction_version);
    waiting: (signal_id) of those deferred by an open group."""
    body = F.col("raw_text").isNotNull()
    triaged = (F.col("status") == "normalized") & (F.col("triage_status") == "done") & F.coalesce(F.col("relevant"), F.lit(False)) & body
    rules = {
        "dedupe": (F.col("status") == "fetched") & body,
        "retrieval": (F.col("status") == "fetched") & ~body & (F.col("attempts") < attempts),
        "classification": (F.col("status") == "normalized") & body,
        "triage": (F.col("status") == "normalized") & (F.col("triage_status") == "pending") & body,
        "embedding": triaged & ~F.col("embedded"),
        "extraction": triaged,
        "backfill": F.col("status").isin(*BACKFILLED) & F.col("extracted") & body & (F.col("extraction_version").isNull() | (F.col("extraction_version") < LEAST_VERSION)),
        "matching": F.col("status") == "extracted",
        "geocoding": (F.col("status") == "extracted") & F.col("extracted"),
    }
    queue = signals.where(rules[stage])
    return queue.join(waiting, "signal_id", "left_anti") if stage in ("classification", "embedding") else queue


def requeued(signals: DataFrame) -> DataFrame:
    """The next state of signals whose extraction a schema change left behind: back to normalized, without extraction."""
    old = F.col("status").isin(*BACKFILLED) & F.col("extracted") & (F.col("extraction_version").isNull() | (F.col("extraction_version") < LEAST_VERSION))
    return signals.withColumns({"status": F.when(old, "normalized").otherwise(F.col("status")), "extraction_version": F.when(~old, F.col("extraction_version"))})


def clusters_to_extract(groups: DataFrame, members: DataFrame, signals: DataFrame, valid: Column, limit: int, most: int = MOST_MEMBERS) -> DataFrame:
    """(group_id, source_index, signal_id) of the oldest open groups: the representative first, then by retrieval, bodies
    that hold only, most members at most. A group whose first member is not its representative is left out."""
    oldest_groups = groups.where("state = 'open'").orderBy("opened_at", "group_id").limit(limit)
    rank = F.when(F.col("role") == "representative", 0).otherwise(1)
    m = members.join(oldest_groups.select("group_id"), "group_id").join(signals.where(F.col("raw_text").isNotNull()).where(valid), "signal_id")
    w = Window.partitionBy("group_id").orderBy(rank, "retrieved_at", "signal_id")
    kept = m.withColumn("source_index", F.row_number().over(w) - 1).where(F.col("source_index") < most)
    led = kept.where("source_index = 0 AND role = 'representative'").select("group_id")
    return kept.join(led, "group_id", "left_semi").select("group_id", "source_index", "signal_id")


def written_groups(chained: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(groups, members) rows to append for chained signals (story_chains): one open group for each chain, named by key."""
    c = chained.withColumn("group_id", key)
    groups = c.groupBy("group_id").agg(F.first("rule_group").alias("rule_group"), F.first("country").alias("country"), F.count("*").alias("n_members")).withColumn("state", F.lit("open"))
    return groups, c.select("group_id", "signal_id", F.when(F.col("is_representative"), "representative").otherwise("deferred").alias("role"))


def group_candidates(signals: DataFrame, sources: DataFrame, rules: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """Normalized signals in no group, with the facts that group them; without a rule they come with a null group."""
    s = oldest(signals.where("status = 'normalized'").join(members.select("signal_id"), "signal_id", "left_anti"), limit)
    return s.join(sources, "source").join(rules, "rule_id", "left")


def closed_groups(groups: DataFrame, members: DataFrame, signals: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """The next state of groups: expired after hours, else resolved once the representative has left normalized."""
    done = members.where("role = 'representative'").join(signals.where("status <> 'normalized'").select("signal_id"), "signal_id", "left_semi").select("group_id", F.lit(True).alias("_done")).distinct()
    open_ = F.col("state") == "open"
    state = F.when(open_ & (F.col("opened_at") < now - F.make_interval(hours=F.lit(hours))), "expired").when(open_ & F.coalesce("_done", F.lit(False)), "resolved").otherwise(F.col("state"))
    return groups.join(done, "group_id", "left").withColumn("state", state).drop("_done")
