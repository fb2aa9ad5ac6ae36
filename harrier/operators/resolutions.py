"""Review decisions that change the tables: cases, signals, links and events as they stand afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.graph import step_table
from harrier.operators.reviews import resolve_reviews
from harrier.operators.surveillance import early_signal_scores

LINKS = ["event_id", "signal_id", "relationship_type", "match_score", "is_primary"]


def _outcomes(cases: DataFrame, commands: DataFrame, events: DataFrame, diseases: DataFrame, candidates: DataFrame) -> DataFrame:
    """resolve_reviews with what a command points to: an event that is no candidate of the case, or is not there any more,
    makes it stale, a disease that is not there refuses it. Of two commands for one case the first by action counts."""
    once = commands.groupBy("case_id").agg(F.min(F.struct("action", "version", "event_id", "disease_id")).alias("c")).select("case_id", "c.*")
    r = resolve_reviews(cases, once).join(once.select("case_id", F.col("event_id").alias("target"), "disease_id"), "case_id", "left")
    scored = candidates.join(events.select("event_id"), "event_id", "left_semi").select("case_id", F.col("event_id").alias("target"), F.col("match_score").alias("score"))
    known = diseases.select("disease_id", F.lit(True).alias("_known"))
    r = r.join(scored, ["case_id", "target"], "left").join(known, "disease_id", "left")
    closed = F.col("outcome") == "closed"
    lost = closed & (F.col("action") == "link_event") & F.col("score").isNull()
    void = closed & (F.col("action") == "assign_disease") & F.col("_known").isNull()
    return r.withColumn("outcome", F.when(lost, "target_stale").when(void, "no_disease").otherwise(F.col("outcome")))


def apply_resolutions(cases: DataFrame, commands: DataFrame, signals: DataFrame, links: DataFrame, events: DataFrame, candidates: DataFrame, diseases: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The next state of cases, signals, links and events, and outcomes (case_id, outcome), after commands (case_id, action,
    version, event_id, disease_id).

    cases: case_id, signal_id, reason, state, version, resolution. A closed case has its action as resolution. The signal
    takes the status that the action leads to; a retrieval starts again with no attempts, an assigned disease is set. A
    linked signal supports its event, which is a candidate (case_id, event_id, match_score) of the case; a created event is
    named -1 - signal_id and has the signal as its initial report and primary. Events that gain a signal are updated, their
    articles counted again and their early score worked out again over all their signals."""
    spark = signals.sparkSession
    found = step_table(spark, _outcomes(cases, commands, events, diseases, candidates).select("case_id", "signal_id", "action", "outcome", "target", "disease_id", "score", "new_status"), "outcomes")
    done = found.where("outcome = 'closed'")
    own = done.select("case_id", F.col("action").alias("_action"))
    j = cases.join(own, "case_id", "left")
    closed = F.col("_action").isNotNull()
    cases = j.withColumns({"state": F.when(closed, "resolved").otherwise(F.col("state")), "version": F.col("version") + closed.cast("int"), "resolution": F.coalesce("_action", "resolution")}).select(cases.columns)

    said = done.select("signal_id", F.col("action").alias("_action"), F.col("new_status").alias("_status"), F.col("disease_id").alias("_disease"))
    j = signals.join(said, "signal_id", "left")
    set_ = {"status": F.coalesce("_status", "status"), "attempts": F.when(F.col("_action") == "retry_retrieval", 0).otherwise(F.col("attempts")), "disease_id": F.when(F.col("_action") == "assign_disease", F.col("_disease")).otherwise(F.col("disease_id"))}
    signals = step_table(spark, j.withColumns(set_).select(signals.columns), "signals")

    create = F.col("action") == "create_event"
    new = done.where("action IN ('link_event', 'create_event')").select(
        F.when(create, -1 - F.col("signal_id")).otherwise(F.col("target")).alias("event_id"), "signal_id",
        F.when(create, "initial_report").otherwise("supporting_source").alias("relationship_type"), F.when(create, 1.0).otherwise(F.col("score")).alias("match_score"), create.alias("is_primary"),
    )
    new = step_table(spark, new.join(links.select("event_id", "signal_id"), ["event_id", "signal_id"], "left_anti"), "new_links")
    links = links.select(LINKS).unionByName(new.select(LINKS))

    touched = new.select("event_id").distinct()
    members = links.join(touched, "event_id", "left_semi").select("event_id", "signal_id").join(signals.drop("event_id"), "signal_id")
    at = F.coalesce("published_at", "first_seen_at")
    facts = members.groupBy("event_id").agg(F.count("*").alias("_n"), F.max(at).alias("_last"), F.min(at).alias("_first"), F.min_by("disease_id", F.struct(at, "signal_id")).alias("_disease"), F.min_by("country", F.struct(at, "signal_id")).alias("_country"))
    facts = facts.join(early_signal_scores(members, now, "event_id").select("event_id", F.col("early_signal_score").alias("_early")), "event_id")
    j = events.join(facts, "event_id", "full")
    set_ = {
        "disease_id": F.coalesce("disease_id", "_disease"), "country": F.coalesce("country", "_country"), "start": F.least("start", "_first"), "updated": F.greatest("updated", "_last"),
        "n_articles": F.coalesce("_n", "n_articles"), "early_signal_score": F.coalesce("_early", "early_signal_score"),
    }
    events = j.withColumns(set_).select(events.columns)
    return {"cases": cases, "signals": signals, "links": links, "events": events, "outcomes": found.select("case_id", "outcome")}
