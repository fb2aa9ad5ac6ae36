"""Review cases: opened once a signal, resolved by what their reason allows, closed by a recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which resolutions close which kind of review case, and the status that a signal then takes.
ALLOWED = {
    "retrieval_failed": ["retry_retrieval", "dismiss"],
    "extraction_rejected": ["retry_extraction", "dismiss"],
    "disease_unresolved": ["assign_disease", "dismiss"],
    "location_unresolved": ["retry_geocoding", "dismiss"],
    "event_match_ambiguous": ["link_event", "create_event", "dismiss"],
    "content_integrity": ["dismiss"],
    "legacy_unclassified": ["dismiss"],
}
BECOMES = {"retry_retrieval": "fetched", "retry_extraction": "classified", "assign_disease": "extracted", "retry_geocoding": "extracted", "dismiss": "dismissed", "link_event": "matched", "create_event": "matched"}


def _matrix() -> F.Column:
    return F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def resolve_reviews(cases: DataFrame, commands: DataFrame) -> DataFrame:
    """cases (case_id, reason, state, version), commands (case_id, action, version): closed, refused (not allowed for the
    reason, or already closed), stale (another version) or untouched; and the status that the signal takes."""
    j = cases.join(commands.select("case_id", "action", F.col("version").alias("seen")), "case_id", "left")
    legal = F.coalesce(F.array_contains(_matrix()[F.col("reason")], F.col("action")), F.lit(False))
    outcome = F.when(F.col("action").isNull(), "untouched").when(F.col("state") != "open", "refused").when(F.col("seen") != F.col("version"), "stale").when(legal, "closed").otherwise("refused")
    becomes = F.create_map(*[F.lit(x) for kv in BECOMES.items() for x in kv])
    closed = F.col("outcome") == "closed"
    return j.withColumn("outcome", outcome).withColumns({"new_state": F.when(closed, "resolved").otherwise(F.col("state")), "new_version": F.col("version") + closed.cast("int"), "new_status": F.when(closed, becomes[F.col("action")])})


def open_reviews(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cases with those added that wanted (signal_id, reason, opened_at) asks for: a signal with an open case keeps it, and
    gets one new case, of its earliest reason."""
    new = wanted.join(cases.where("state = 'open'").select("signal_id"), "signal_id", "left_anti")
    first = new.groupBy("signal_id").agg(F.min(F.struct("opened_at", "reason")).alias("f")).select("signal_id", "f.reason", "f.opened_at", F.lit("open").alias("state"), F.lit(None).cast("string").alias("resolution"))
    return cases.select("signal_id", "reason", "opened_at", "state", "resolution").unionByName(first)


def recovered(cases: DataFrame, promoted: DataFrame) -> DataFrame:
    """Open cases of failed retrieval close by themselves when the signal (signal_id) has got its body."""
    j = cases.join(promoted.select("signal_id", F.lit(True).alias("_in")).distinct(), "signal_id", "left")
    hit = F.coalesce("_in", F.lit(False)) & (F.col("state") == "open") & (F.col("reason") == "retrieval_failed")
    return j.withColumns({"state": F.when(hit, "resolved").otherwise(F.col("state")), "resolution": F.when(hit, "recovered_automatically").otherwise(F.col("resolution"))}).drop("_in")


def review_queue(cases: DataFrame, signals: DataFrame, sources: DataFrame, diseases: DataFrame, candidates: DataFrame, limit: int = 50, offset: int = 0, reason: str | None = None, state: str = "open") -> DataFrame:
    """A page of cases, oldest first: the extraction's title and disease where it has them, the source, the disease, the
    places and the candidate events (best first) of each, and what its reason allows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    c = cases.where(F.col("state") == state)
    page = (c.where(F.col("reason") == reason) if reason else c).orderBy("opened_at", "case_id").limit(limit + offset).offset(offset)
    best = Window.partitionBy("case_id").orderBy(F.desc("match_score"), "event_id")
    few = candidates.join(page.select("case_id"), "case_id", "left_semi").withColumn("_n", F.row_number().over(best))
    listed = few.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_id"))), lambda x: x["event_id"]).alias("candidate_events"))
    said = lambda new, old: F.coalesce(F.when(F.btrim(new) != "", F.col(new)), old)
    j = page.join(signals, "signal_id").join(sources, "source").join(diseases, "disease_id", "left").join(listed, "case_id", "left")
    return j.select(
        "case_id", "signal_id", "reason", "opened_at", said("title_english", F.col("title")).alias("title"), "source", said("disease_name", F.lit(None)).alias("extracted_disease"), "canonical_name",
        F.coalesce("candidate_events", F.array().cast("array<bigint>")).alias("candidate_events"), F.array_sort(_matrix()[F.col("reason")]).alias("allowed"),
    )
