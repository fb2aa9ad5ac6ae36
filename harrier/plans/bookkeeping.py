"""Queries of the pipeline's bookkeeping: queues, retrieval, extraction, events' records, groups, reviews, runs; and of
small operators and functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T
from harrier.operators import events as E
from harrier.operators import extraction as N
from harrier.operators.graph import shared_folder
from harrier.operators import ledger as Y
from harrier.operators import models as M
from harrier.operators import places as P
from harrier.operators import queues as Q
from harrier.operators import resolutions as I
from harrier.operators import retrieval as L
from harrier.operators import reviews as V
from harrier.operators import runs as U
from harrier.plans import domain as D
from harrier.plans import read_models as R
from harrier.plans.registry import query
from harrier.sources import paged as W
from harrier.sources import sinks as K
from harrier.sources.store import Store

_W = f"WITH {D.SIGNALS_SQL}"
_QW = f"{_W}, {D.QUEUES_SQL}"
_AT = "coalesce(published_s, first_seen_s)"


# --- queues ----------------------------------------------------------------------------------------------------------

_TRIAGED = "queue_status = 'normalized' AND triage_status = 'done' AND coalesce(relevant, FALSE) AND body IS NOT NULL"
_OLD = "queue_status IN ('extracted', 'geocoded', 'matched', 'published') AND extracted AND (extraction_version IS NULL OR extraction_version < 2)"
_STAGES = {
    "dedupe": "queue_status = 'fetched' AND body IS NOT NULL", "retrieval": "queue_status = 'fetched' AND body IS NULL AND attempts < 3",
    "classification": "queue_status = 'normalized' AND body IS NOT NULL AND NOT waits", "triage": "queue_status = 'normalized' AND triage_status = 'pending' AND body IS NOT NULL",
    "embedding": f"{_TRIAGED} AND NOT embedded AND NOT waits", "extraction": _TRIAGED, "backfill": f"{_OLD} AND body IS NOT NULL",
    "matching": "queue_status = 'extracted'", "geocoding": "queue_status = 'extracted' AND extracted",
}
_WAITS = "waiting AS (SELECT *, role = 'deferred' AND state = 'open' AS waits FROM queued JOIN grouped USING (group_id))"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return D.queued(spark, d).drop("raw_text", "status").withColumnsRenamed({"body": "raw_text", "queue_status": "status"})


def _members(spark: SparkSession, d: str) -> DataFrame:
    return D.queued(spark, d).select("group_id", "signal_id", "role")


@query(f"{_QW}, {_WAITS}, stages AS (" + " UNION ALL ".join(f"(SELECT '{k}' AS stage, signal_id FROM (SELECT * FROM (SELECT * FROM waiting WHERE {v} ORDER BY first_seen_s, signal_id LIMIT 100) WHERE valid ORDER BY first_seen_s, signal_id LIMIT 10))" for k, v in _STAGES.items()) + ") SELECT * FROM stages")
def status_queues(spark: SparkSession, d: str) -> DataFrame:
    """The first ten valid signals of each stage's queue among the first hundred: the limits are the feature."""
    s, waiting = _signals(spark, d), Q.deferred(_members(spark, d), D.groups(spark, d))
    out = None
    for stage in _STAGES:
        q = Q.oldest_valid(Q.status_queue(s, waiting, stage), F.col("valid"), 10).select(F.lit(stage).alias("stage"), "signal_id")
        out = q if out is None else out.unionByName(q)
    return out


@query(f"{_QW}, {_WAITS} SELECT stage, count(*) AS n, min(signal_id) AS first_id, max(signal_id) AS last_id FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS stage, signal_id FROM waiting WHERE {v}" for k, v in _STAGES.items()) + ") GROUP BY stage")
def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    s, waiting = _signals(spark, d), Q.deferred(_members(spark, d), D.groups(spark, d))
    out = None
    for stage in _STAGES:
        q = Q.status_queue(s, waiting, stage).agg(F.count("*").alias("n"), F.min("signal_id").alias("first_id"), F.max("signal_id").alias("last_id")).select(F.lit(stage).alias("stage"), "*")
        out = q if out is None else out.unionByName(q)
    return out.where("n > 0")


@query(f"{_QW}, m AS (SELECT q.*, row_number() OVER (PARTITION BY group_id ORDER BY CASE role WHEN 'representative' THEN 0 ELSE 1 END, first_seen_s, signal_id) - 1 AS source_index FROM queued q JOIN (SELECT * FROM grouped WHERE state = 'open' ORDER BY opened_s, group_id LIMIT 60) USING (group_id) WHERE body IS NOT NULL AND valid) SELECT group_id, source_index, signal_id FROM m WHERE source_index < 4 AND group_id IN (SELECT group_id FROM m WHERE source_index = 0 AND role = 'representative')")
def clusters_to_extract(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d).withColumn("retrieved_at", F.col("first_seen_at")).select("signal_id", "raw_text", "valid", "retrieved_at")
    return Q.clusters_to_extract(D.groups(spark, d), _members(spark, d), s, F.col("valid"), 60)


@query(f"{_QW}, n AS (SELECT *, {_OLD} AS old FROM queued) SELECT CASE WHEN old THEN 'normalized' ELSE queue_status END AS status, CASE WHEN NOT coalesce(old, FALSE) THEN extraction_version END AS extraction_version, count(*) AS n FROM n GROUP BY 1, 2")
def requeued(spark: SparkSession, d: str) -> DataFrame:
    return Q.requeued(_signals(spark, d)).groupBy("status", "extraction_version").agg(F.count("*").alias("n"))


@query(f"{_QW} SELECT g.state AS was, CASE WHEN g.state = 'open' AND opened_s < {D.NOW} - 72 * 3600 THEN 'expired' WHEN g.state = 'open' AND EXISTS (SELECT 1 FROM queued q WHERE q.group_id = g.group_id AND role = 'representative' AND queue_status <> 'normalized') THEN 'resolved' ELSE g.state END AS state, count(*) AS n FROM grouped g GROUP BY 1, 2")
def group_states(spark: SparkSession, d: str) -> DataFrame:
    g = D.groups(spark, d).withColumn("was", F.col("state"))
    return Q.closed_groups(g, _members(spark, d), _signals(spark, d), D.now()).groupBy("was", "state").agg(F.count("*").alias("n"))


@query(f"{_QW}, c AS (SELECT * FROM queued WHERE queue_status = 'normalized' AND role IS NOT NULL AND signal_id % 5 <> 2) SELECT signal_id, is_official, credibility, CASE WHEN signal_id % 4 > 0 THEN 'g' || (signal_id % 4) END AS rule_group FROM c ORDER BY first_seen_s, signal_id LIMIT 50")
def group_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Signals that no group has yet (every fifth has one), with their source's standing and their rule's group."""
    s = _signals(spark, d).withColumn("rule_id", F.col("signal_id") % 4).drop("is_official", "credibility", "rule_group")
    rules = spark.createDataFrame([(k, f"g{k}") for k in (1, 2, 3)], "rule_id long, rule_group string")
    return Q.group_candidates(s, D.sources(spark, d), rules, s.where("signal_id % 5 = 2").select("signal_id"), 50).select("signal_id", "is_official", "credibility", "rule_group")


@query(f"""{_W}, l AS (SELECT *, lag(first_seen_s) OVER (PARTITION BY rule_group, country ORDER BY first_seen_s, signal_id) AS prev FROM signals),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR floor((first_seen_s - prev) / 3600.0) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rule_group, country ORDER BY first_seen_s, signal_id) AS chain FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_group, country, chain ORDER BY is_official DESC, CASE credibility WHEN 'official' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, first_seen_s, signal_id) = 1 AS lead_ FROM n)
SELECT concat_ws('/', rule_group, country, CAST(chain AS BIGINT)) AS group_id, 'open' AS state, count(*) AS n_members, max(CASE WHEN lead_ THEN signal_id END) AS representative, count(*) FILTER (NOT lead_) AS n_deferred FROM r GROUP BY rule_group, country, chain""")
def written_groups(spark: SparkSession, d: str) -> DataFrame:
    from harrier.operators import surveillance as S

    s = D.signals(spark, d).withColumn("first_seen_at", F.timestamp_seconds((F.col("first_seen_s") - D.EPOCH) * 24 + D.EPOCH))
    chained = S.story_chains(s)
    # Null keys are groups of their own; a key written as text would confuse them, so the row's own struct names a group.
    groups, members = Q.written_groups(chained, F.struct("rule_group", "country", "chain"))
    by_role = members.groupBy("group_id").agg(F.max(F.when(F.col("role") == "representative", F.col("signal_id"))).alias("representative"), F.count_if(F.col("role") == "deferred").alias("n_deferred"))
    return groups.join(by_role, "group_id").select(F.concat_ws("/", "group_id.rule_group", "group_id.country", F.col("group_id.chain").cast("string")).alias("group_id"), "state", "n_members", "representative", "n_deferred")


# --- retrieval -------------------------------------------------------------------------------------------------------

_KINDS = "CASE doc_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Text/HTML; charset=utf-8' WHEN 2 THEN NULL ELSE 'text/html' END"


@query(f"SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'not_html' WHEN 2 THEN 'not_html' END AS unreadable FROM pages")
def readable_pages(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "pages").withColumn("content_type", F.expr(_KINDS.replace("doc_id", "page_id")))
    return L.readable_pages(p).select("page_id", "unreadable")


_PAGE_TITLE = r"replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&')"


#: The text within paragraphs: tags in order, how many paragraphs are open after each, and the text where any is.
_PAGE_BODY = r"""tok AS (SELECT page_id, unnest(list_zip(x, range(len(x)))) AS z FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<(style|script|nav|header|footer|aside|form)[ >].*?</(style|script|nav|header|footer|aside|form)>', '', 'g'), '<[^>]*>|[^<]+') AS x FROM pages)),
deep AS (SELECT page_id, z[1] AS t, z[2] AS i, sum(CASE WHEN regexp_matches(z[1], '^<p[ >]') THEN 1 WHEN z[1] = '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY z[2]) AS d FROM tok),
body AS (SELECT page_id, length(trim(regexp_replace(string_agg(CASE WHEN regexp_matches(t, '^</?p[ >]') THEN ' ' WHEN t[1] <> '<' THEN t ELSE '' END, '' ORDER BY i), '\s+', ' ', 'g'))) AS n FROM deep WHERE d > 0 OR t = '</p>' GROUP BY page_id),
known AS (SELECT page_id, html, page_id % 4 = 0 OR coalesce(n, 0) < 200 AS failed FROM pages LEFT JOIN body USING (page_id))"""


@query(f"WITH {_PAGE_BODY} SELECT page_id, failed, CASE WHEN failed THEN 'Seen ' || page_id ELSE {_PAGE_TITLE} END AS title, 'd' || (page_id % 3) AS publisher, CASE WHEN failed THEN sha256('Seen ' || page_id || chr(31)) END AS stub_hash FROM known")
def retrieved_signals(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of all pages, a fourth of which could not be fetched."""
    p = D.table(spark, d, "pages")
    seen = p.select("page_id", "url", X.canonical_url(F.col("url")).alias("canonical_url"), F.concat(F.lit("Seen "), "page_id").alias("title"), F.concat(F.lit("d"), F.col("page_id") % 3).alias("domain"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("country"))
    # Each sighting has its page, found by a key, as urls repeat.
    key = F.concat("url", F.lit("#"), "page_id")
    got = L.retrieved(seen.withColumn("url", key), p.where("page_id % 4 <> 0").select(key.alias("url"), "html"))
    return got.select("page_id", "failed", "title", F.col("publisher.name").alias("publisher"), F.when(F.col("failed"), F.col("content_hash")).alias("stub_hash"))


_HEADLINE = "CASE WHEN signal_id % 50 < 25 THEN 'story ' || (signal_id % 50) ELSE 'flu story ' || (signal_id % 25) END"
_WAITING = f"""h AS (SELECT *, {_HEADLINE} AS headline FROM queued), stored AS (SELECT * FROM h WHERE body IS NOT NULL AND signal_id % 3 <> 0), w AS (SELECT * FROM h WHERE signal_id % 3 = 0),
f AS (SELECT headline, arg_min(signal_id, (first_seen_s, signal_id)) AS primary_id FROM stored WHERE queue_status <> 'published' AND first_seen_s >= {D.EPOCH} + 86400 - 72 * 3600 GROUP BY headline)"""


def _headlines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = _signals(spark, d).withColumn("headline", F.expr(_HEADLINE.replace("'flu", "'FLU"))).withColumn("normalized_title", X.masthead_title(F.concat("headline", F.lit(" - The Daily"))))
    h = h.withColumn("status", F.when(F.col("status") == "published", "duplicate").otherwise(F.col("status"))).withColumn("title", F.col("headline"))
    return h.where("signal_id % 3 = 0"), h.where("signal_id % 3 <> 0")


@query(f"{_QW}, {_WAITING} SELECT signal_id, primary_id FROM w JOIN f USING (headline)")
def title_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Waiting signals (each third) whose headline a stored one has: case and masthead do not count."""
    waiting, stored = _headlines(spark, d)
    return L.title_duplicates(waiting, stored, F.timestamp_seconds(F.lit(D.EPOCH + 86400)))


@query(f"""{_QW}, {_WAITING} SELECT CASE WHEN headline NOT LIKE 'flu%' AND signal_id % 2 = 0 THEN 'filtered' WHEN primary_id IS NOT NULL AND signal_id % 4 <> 0 THEN 'duplicate' WHEN signal_id % 5 = 0 THEN 'still_failing' WHEN signal_id % 7 = 0 THEN 'redundant' ELSE 'retrieved' END AS route, count(*) AS n, min(signal_id) AS first_id FROM w LEFT JOIN f USING (headline) GROUP BY 1""")
def retrieval_routes(spark: SparkSession, d: str) -> DataFrame:
    waiting, stored = _headlines(spark, d)
    same = L.title_duplicates(waiting, stored, F.timestamp_seconds(F.lit(D.EPOCH + 86400))).where("signal_id % 4 <> 0")
    fetched = waiting.select("signal_id", F.concat(F.lit("u"), "signal_id").alias("canonical_url"), F.lit("h").alias("content_hash"), (F.col("signal_id") % 5 == 0).alias("failed"))
    taken = fetched.where("signal_id % 7 = 0").select("canonical_url", "content_hash")
    w = waiting.withColumn("title", F.when(F.col("signal_id") % 2 == 1, F.concat(F.lit("The  Flu: "), "title")).otherwise(F.col("title")))
    return L.retrieval_routes(w.select("signal_id", "title"), same, fetched, taken, ["FLU"]).groupBy("route").agg(F.count("*").alias("n"), F.min("signal_id").alias("first_id"))


@query(f"{_QW}, s AS (SELECT *, signal_id % 2 = 0 AS failed FROM queued WHERE queue_status = 'fetched' AND body IS NULL AND attempts < 3) SELECT CASE WHEN failed AND attempts + 1 >= 3 THEN 'failed' ELSE 'fetched' END AS status, CAST(CASE WHEN failed THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts, count(*) AS n FROM s GROUP BY 1, 2")
def retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Stubs whose page is asked for again: a failed try counts, the third one ends it."""
    s = Q.status_queue(_signals(spark, d), Q.deferred(_members(spark, d), D.groups(spark, d)), "retrieval")
    attempts, status = K.count_attempt(F.col("attempts"), F.col("status"), F.col("signal_id") % 2 == 0)
    return s.select(attempts.cast("bigint").alias("attempts"), status.alias("status")).groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id AS pos, doc_id % 300 AS u, doc_id % 4 AS h, CASE WHEN doc_id % 10 = 7 THEN 'unsupported' WHEN doc_id % 10 = 8 THEN 'KeyError' END AS error FROM documents),
o AS (SELECT *, CASE WHEN error = 'unsupported' THEN 'rejected' WHEN error IS NOT NULL THEN 'failed' WHEN u % 6 = 0 AND h = 0 THEN 'skipped' WHEN row_number() OVER (PARTITION BY u, h, error IS NULL ORDER BY pos) > 1 THEN 'skipped' ELSE 'inserted' END AS outcome FROM x)
SELECT outcome, count(*) AS n, min(pos) AS first_pos FROM o GROUP BY outcome""")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    x = D.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 300).alias("url"), (F.col("doc_id") % 4).alias("content_hash"), F.when(F.col("doc_id") % 10 == 7, "unsupported").when(F.col("doc_id") % 10 == 8, "KeyError").alias("error"))
    stored = x.where("url % 6 = 0 AND content_hash = 0").select("url", "content_hash")
    return L.ingested(x, stored).groupBy("outcome").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(f"""{_W} SELECT CAST(signal_id AS VARCHAR) AS id, first_seen_s AS at_s, length(title) AS n_title, FALSE AS truncated FROM signals""")
def paged_articles(spark: SparkSession, d: str) -> DataFrame:
    """All signals as landed records, read back through a search that gives 25 at most, by windows of six hours."""
    s = D.signals(spark, d)
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex[:12]}"
    payload = F.to_json(F.struct(F.length("title").alias("n_title")))
    W.land_days(s.select(F.col("first_seen_at").alias("at"), F.col("signal_id").cast("string").alias("id"), payload.alias("payload")), path)
    W.register_pages(spark, "landed_search", W.LandedDays(path), capped=True, most=25)
    pages = spark.read.format("landed_search").option("width", "21600").load()
    return pages.select("id", F.unix_seconds("at").alias("at_s"), F.get_json_object("payload", "$.n_title").cast("long").alias("n_title"), "truncated")


# --- extraction ------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str, sound: bool = False) -> DataFrame:
    """A model's answer to each document: sound, or with one of twelve faults, by its id."""
    fault = F.lit(13) if sound else F.col("doc_id") % 14
    c = lambda value, span, index=0: F.struct(value.cast("bigint").alias("value"), span.alias("source_span"), F.lit(index).alias("source_index"))
    n = F.col("doc_id") % 50 + 10
    body = F.concat(F.lit("In all, "), n, F.lit("  Cases and "), n - 5, F.lit(" deaths were reported. Local spread is likely. "), F.substring("text", 1, 50))
    slot = lambda s, k: F.struct(F.when((fault == 4) & F.lit(k == 1), "timing").otherwise(F.lit(s)).alias("slot"), F.when((fault == 10) & F.lit(k == 2), "write to a@b.org").otherwise(F.concat(F.lit(f"point {k} of "), "doc_id")).alias("text"), F.lit(k < 3).alias("reported"))
    total = c(F.when(fault == 5, n - 7).otherwise(n), F.when(fault == 6, F.lit("in all nothing")).when(fault == 7, F.lit("Local spread is likely")).otherwise(F.concat(F.lit("in all, "), F.when(fault == 5, n - 7).otherwise(n), F.lit(" cases"))))
    deaths = F.when(fault != 8, c(n - 5, F.concat(n - 5, F.lit(" DEATHS")))).otherwise(F.struct((n - 5).cast("bigint").alias("value"), F.concat(n - 5, F.lit(" deaths")).alias("source_span"), F.lit(3).alias("source_index")))
    flag = F.struct(F.lit(True).alias("value"), F.lit("local spread is likely").alias("source_span"), F.lit(0).alias("source_index"))
    payload = F.to_json(F.struct(
        F.when(fault == 3, "gossip").otherwise("case_report").alias("signal_type"), F.lit("EN").alias("source_language"), F.when(fault == 9, "call +234 803 555 1234").otherwise("Cases rise").alias("title_english"),
        F.array(*[slot(s, k) for k, s in enumerate(N.SLOTS)]).alias("brief"), F.struct(F.lit("flu").alias("name"), F.lit(0.9).alias("confidence")).alias("disease"),
        F.array(F.struct(F.lit("primary").alias("role"), F.lit("NG").alias("country"), F.lit("Kano").alias("admin1"), F.lit("Kano city").alias("place_name")), F.struct(F.lit("mention").alias("role"), F.lit("CD").alias("country"), F.lit(None).cast("string").alias("admin1"), F.lit(None).cast("string").alias("place_name"))).alias("locations"),
        F.struct(total.alias("total_cases"), deaths.alias("deaths")).alias("epidemiology"), F.when(fault != 12, F.struct(flag.alias("local_transmission"))).alias("transmission"),
        F.when(fault == 11, 0.5).when(fault == 2, 1.5).otherwise(0.8).alias("confidence"),
    ))
    content = F.when(fault == 0, F.concat(F.lit("Here it is: "), payload)).when(fault == 1, F.regexp_replace(payload, "^\\{", '{"extra":1,')).otherwise(payload)
    return D.table(spark, d, "documents").select("doc_id", F.array(body).alias("bodies"), content.alias("content"))


_FAULTS = ["not_json", "shape", "shape", "shape", "shape", "arithmetic", "ungrounded", "ungrounded", "ungrounded", "privacy", "privacy", "low_confidence", None, None]
_REASON = "CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_FAULTS) if v) + " END"


@query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def extraction_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return N.validate_extraction(_answers(spark, d), "content", "bodies").select("doc_id", "reason")


@query(f"""WITH r AS (SELECT doc_id, doc_id % 4 AS s, {_REASON} AS reason FROM documents)
SELECT CASE WHEN s = 0 THEN 'normalized' WHEN reason IS NULL THEN 'extracted' ELSE 'failed' END AS status, CASE WHEN s > 0 AND reason IS NULL THEN 3 WHEN s = 1 THEN 1 END AS extraction_version, count(*) AS n,
max(CASE WHEN s > 0 AND reason IS NULL THEN 'point 0 of ' || doc_id || chr(10) || 'point 1 of ' || doc_id || chr(10) || 'point 2 of ' || doc_id || chr(10) || 'point 3 of ' || doc_id || chr(10) || 'point 4 of ' || doc_id END) AS summary FROM r GROUP BY 1, 2""")
def recorded_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Three of four documents were sent; one in four had an old extraction."""
    v = N.validate_extraction(_answers(spark, d), "content", "bodies").where("doc_id % 4 > 0").select(F.col("doc_id").alias("signal_id"), "reason", "content")
    s = D.table(spark, d, "documents").select(F.col("doc_id").alias("signal_id"), F.lit("normalized").alias("status"), F.lit(None).cast("string").alias("summary"), F.when(F.col("doc_id") % 4 == 1, 1).alias("extraction_version"))
    return N.record_extraction(s, v).groupBy("status", "extraction_version").agg(F.count("*").alias("n"), F.max("summary").alias("summary"))


@query(f"WITH r AS (SELECT doc_id, {_REASON} AS reason FROM documents) SELECT CASE WHEN reason IS NULL THEN 3 ELSE 1 END AS extraction_version, count(*) AS n FROM r GROUP BY 1")
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """A backfill renews what passes and demotes nothing."""
    v = N.validate_extraction(_answers(spark, d), "content", "bodies").select(F.col("doc_id").alias("signal_id"), "reason", "content")
    s = D.table(spark, d, "documents").select(F.col("doc_id").alias("signal_id"), F.lit("matched").alias("status"), F.lit(None).cast("string").alias("summary"), F.lit(1).alias("extraction_version"))
    return N.record_extraction(s, v, demote=False).where("status = 'matched'").groupBy("extraction_version").agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id % 14 > 0 AND doc_id % 3 > 0 AS presentable, CASE WHEN doc_id % 14 > 0 THEN '{\"suspected_cases\":null,\"confirmed_cases\":null,\"total_cases\":' || CASE WHEN doc_id % 14 = 5 THEN doc_id % 50 + 3 ELSE doc_id % 50 + 10 END || ',\"deaths\":' || (doc_id % 50 + 5) || ',\"new_cases\":null,\"new_deaths\":null}' END AS counts FROM documents")
def stored_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Stored extractions read back: may they be shown, and what they count. Two thirds carry a version."""
    a = _answers(spark, d)
    stamped = F.when(F.col("doc_id") % 3 > 0, F.regexp_replace("content", r"\}$", ',"extraction_schema_version":3}')).otherwise(F.col("content"))
    p = a.withColumn("p", N.stored(stamped))
    return p.select("doc_id", N.presentable(F.col("p")).alias("presentable"), F.when(F.col("p").isNotNull(), N.counts_snapshot(F.col("p"))).alias("counts"))


@query("SELECT doc_id AS signal_id, k AS position, CASE k WHEN 0 THEN 'primary' ELSE 'mention' END AS role, CASE k WHEN 0 THEN 'NG' ELSE 'CD' END AS country_name, CASE k WHEN 0 THEN 'Kano city' END AS place_name FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 14 > 0")
def named_places(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select(F.col("doc_id").alias("signal_id"), N.stored(F.col("content")).alias("p"))
    return N.places_of(a, "p").select("signal_id", "position", "role", "country_name", "place_name")


#: (what in a sound payload, by what it is replaced, the fault): one of each kind at each level.
_DEFECTS = [
    ('"signal_type":"case_report"', '"signal_type":"gossip"', "$.signal_type: value"), ('"signal_type":"case_report",', "", "$.signal_type: missing"), ('{"signal_type"', '{"zeal":1,"signal_type"', "$.zeal: unknown"),
    ('"source_language":"EN"', '"source_language":"xx"', "$.source_language: value"), ('"title_english":"Cases rise"', '"title_english":" "', "$.title_english: blank"), ('"title_english":"Cases rise"', '"title_english":"' + 301 * "t" + '"', "$.title_english: long"),
    ('"slot":"counts"', '"slot":"timing"', "$.brief: order"), ('"slot":"counts"', '"slot":"maybe"', "$.brief[1].slot: value"), ('"slot":"counts",', '"slot":"counts","note":"x",', "$.brief[1].note: unknown"), ('"text":"point 3', '"text":"' + 201 * "p" + " 3", "$.brief[3].text: long"),
    ('"text":"point 0', '"texts":"point 0', "$.brief[0].texts: unknown"), ('"reported":false', '"reported":"no"', "$.brief[3].reported: kind"), ('"name":"flu"', '"name":""', "$.disease.name: blank"), ('"name":"flu"', '"name":"' + 201 * "f" + '"', "$.disease.name: long"),
    ('"confidence":0.9', '"confidence":1.9', "$.disease.confidence: range"), ('"confidence":0.9', '"confidence":0.9,"code":7', "$.disease.code: unknown"), ('"confidence":0.9', '"confidence":null', "$.disease.confidence: null"), ('"disease":{', '"pathogen":"virus","disease":{', "$.pathogen: kind"),
    ('"role":"mention"', '"role":"rumour"', "$.locations[1].role: value"), ('"role":"mention",', "", "$.locations[1].role: missing"), ('"country":"CD"', '"country":"' + 101 * "c" + '"', "$.locations[1].country: long"), ('"admin1":"Kano"', '"admin1":"' + 201 * "k" + '"', "$.locations[0].admin1: long"),
    ('"place_name":"Kano city"', '"place_name":"' + 201 * "k" + '"', "$.locations[0].place_name: long"), ('"place_name":"Kano city"', '"place_name":"Kano city","lat":1.5', "$.locations[0].lat: unknown"), ('"admin1":"Kano"', '"admin1":3', "$.locations[0].admin1: kind"), ('"locations":[', '"locations":null,"places":[', "$.places: unknown"),
    ('"total_cases":{"value":', '"total_cases":{"value":-', "$.epidemiology.total_cases.value: range"), ('"total_cases":{"value":', '"total_cases":{"value":0.5,"was":', "$.epidemiology.total_cases.was: unknown"), ('"source_index":0}', '"source_index":-1}', "$.epidemiology.total_cases.source_index: range"), ('"source_index":0}', '"source_index":null}', "$.epidemiology.total_cases.source_index: null"),
    ('"deaths":{', '"recovered":{', "$.epidemiology.recovered: unknown"), ('"source_span":"in all', '"source_span":"' + 300 * "s", "$.epidemiology.total_cases.source_span: long"), ('"local_transmission":{"value":true', '"local_transmission":{"value":1', "$.transmission.local_transmission.value: kind"), ('"local_transmission":{', '"imported":[],"local_transmission":{', "$.transmission.imported: kind"),
    ('"transmission":{', '"dates":{"event_date":"2024-02-30"},"transmission":{', "$.dates.event_date: form"), ('"transmission":{', '"dates":{"published":"2024-02-03"},"transmission":{', "$.dates.published: unknown"), ('"transmission":{', '"dates":null,"transmission":{', "$.dates: null"), ('"confidence":0.8}', '"confidence":true}', "$.confidence: kind"),
    ('"confidence":0.8}', '"confidence":-0.8}', "$.confidence: range"), ('"brief":[', '"brief":{},"briefs":[', "$.briefs: unknown"), ("}", "", "$: not_json"), ('{"signal_type"', '[{"signal_type"', "$: not_json"),
]
_DEFECT_SQL = f"CASE doc_id % {len(_DEFECTS) + 1} " + " ".join(f"WHEN {k} THEN '{w}'" for k, (*_, w) in enumerate(_DEFECTS)) + " END"


@query(f"SELECT doc_id, {_DEFECT_SQL} AS fault FROM documents")
def payload_faults(spark: SparkSession, d: str) -> DataFrame:
    """An extraction of each document, with one defect by its id or none; the path of the first fault."""
    sound = _answers(spark, d, True)
    k, made = F.col("doc_id") % (len(_DEFECTS) + 1), F.col("content")
    for i, (old, new, _) in enumerate(_DEFECTS):
        at = F.locate(old, F.col("content"))
        cut = F.concat(F.substring(F.col("content"), F.lit(1), at - 1), F.lit(new), F.substring(F.col("content"), at + len(old), F.length("content")))
        made = F.when(k == i, cut).otherwise(made)
    return sound.select("doc_id", N.payload_fault(made, (*N.ROLES, "mention")).alias("fault"))


#: A document's answer is sound at this call of the four that it may have; 4 and 5: at none.
_CALLS = "calls AS (SELECT doc_id, k, doc_id % 6 = k AS sound FROM documents, (SELECT unnest(range(4)) AS k) WHERE k <= doc_id % 6), dealt AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) <= (SELECT count(*) * 3 // 2 FROM documents) AS ok FROM calls), gone AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc_id ORDER BY k) AS so_far, coalesce(bool_and(ok) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS before FROM dealt)"


@query(f"WITH {_CALLS} SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN k < 2 THEN 'small' ELSE 'large' END AS model, k % 2 + 1 AS attempt, CASE WHEN NOT ok THEN 'deferred' WHEN sound THEN 'accepted' ELSE 'rejected' END AS outcome, ok AS paid FROM gone WHERE before")
def budgeted_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Two models, two tries each, for all documents, with calls for one and a half of each: a stand-in for a model answers
    by the document's number."""
    docs = D.table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), F.col("doc_id").cast("string").alias("prompt"), F.lit("").alias("body"))
    number = {("small", ""): 0, ("small", "thin"): 1, ("large", ""): 2, ("large", "thin"): 3}
    call = lambda model, prompt, fault: ("sound" if int(prompt) % 6 == number[model, fault] else "thin", len(prompt), 1)
    ledger = Y.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex[:12]}")
    done = Y.climb_within(docs, [("small", 1), ("large", 2)], call, lambda content, body: F.when(content != "sound", "thin"), docs.count() * 3 // 2, ledger)
    return done.select(F.col("id").cast("long").cast("string").alias("id"), "model", "attempt", "outcome", "paid")


_REASONS = ["event_match_ambiguous", "event_match_ambiguous", "retrieval_failed", "disease_unresolved", "content_integrity"]
_ACTIONS = ["link_event", "create_event", "retry_retrieval", "assign_disease", "dismiss", "link_event"]
_RESOLVED = f"""{_W}, x AS (SELECT *, {_REASONS!r}[CAST(signal_id % 5 + 1 AS BIGINT)] AS reason, {_ACTIONS!r}[CAST(signal_id % 6 + 1 AS BIGINT)] AS action, (signal_id + signal_id // 7 % 3) % 40 AS target, signal_id % 13 AS dis, {_AT} AS t FROM signals),
o AS (SELECT *, CASE WHEN signal_id % 11 = 0 THEN 'refused' WHEN signal_id % 8 = 3 THEN 'stale' WHEN NOT (action = 'dismiss' OR reason = 'event_match_ambiguous' AND action IN ('link_event', 'create_event') OR reason = 'retrieval_failed' AND action = 'retry_retrieval' OR reason = 'disease_unresolved' AND action = 'assign_disease') THEN 'refused'
  WHEN action = 'link_event' AND signal_id // 7 % 3 = 2 THEN 'target_stale' WHEN action = 'assign_disease' AND dis > 3 THEN 'no_disease' ELSE 'closed' END AS outcome FROM x),
ol AS (SELECT event_key AS event_id, signal_id FROM signals WHERE signal_id % 4 = 1),
nl AS (SELECT CASE action WHEN 'create_event' THEN -1 - signal_id ELSE target END AS event_id, signal_id FROM o WHERE outcome = 'closed' AND action IN ('link_event', 'create_event') EXCEPT SELECT * FROM ol), al AS (SELECT * FROM ol UNION SELECT * FROM nl)"""


def _resolved(spark: SparkSession, d: str) -> tuple[Store, int]:
    """A store of the tables, and its version after one command for each signal's case."""
    s, i = D.signals(spark, d), F.col("signal_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    linked = s.where("signal_id % 4 = 1")
    first = {
        "signals": s.withColumn("attempts", F.lit(2)), "links": linked.select(F.col("event_key").alias("event_id"), "signal_id", F.lit("supporting_source").alias("relationship_type"), F.lit(0.8).alias("match_score"), F.lit(False).alias("is_primary")),
        "events": s.groupBy(F.col("event_key").alias("event_id")).agg(F.min("disease_id").alias("disease_id"), F.min("country").alias("country"), F.min(F.coalesce("published_at", "first_seen_at")).alias("start"), F.min(F.coalesce("published_at", "first_seen_at")).alias("updated")).withColumns({"n_articles": F.lit(0).cast("long"), "early_signal_score": F.lit(None).cast("double")}),
        "cases": s.select(i.alias("case_id"), "signal_id", pick(_REASONS, i % 5).alias("reason"), F.when(i % 11 == 0, "resolved").otherwise("open").alias("state"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("resolution")),
        "candidates": s.select(i.alias("case_id"), F.explode(F.array(*[F.struct(((i + k) % 40).alias("event_id"), F.lit(0.7 - 0.1 * k).alias("match_score")) for k in (0, 1)])).alias("c")).select("case_id", "c.*"),
        "diseases": s.where("disease_id IS NOT NULL").select("disease_id").distinct(),
    }
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")
    seen = store.commit(first, 0)
    commands = s.select(i.alias("case_id"), pick(_ACTIONS, i % 6).alias("action"), F.when(i % 8 == 3, 0).otherwise(1).alias("version"), ((i + F.floor(i / 7) % 3) % 40).alias("event_id"), F.concat(F.lit("d"), i % 13).alias("disease_id"))
    after = I.apply_resolutions(store.read("cases"), commands, store.read("signals"), store.read("links"), store.read("events"), store.read("candidates"), store.read("diseases"), D.now())
    return store, store.commit(after, seen)


@query(f"""{_RESOLVED} SELECT outcome, CASE WHEN outcome <> 'closed' THEN status ELSE CASE action WHEN 'retry_retrieval' THEN 'fetched' WHEN 'assign_disease' THEN 'extracted' WHEN 'dismiss' THEN 'dismissed' ELSE 'matched' END END AS status, CASE WHEN outcome = 'closed' THEN action END AS resolution, CASE WHEN outcome = 'closed' AND action = 'assign_disease' THEN 'd' || dis ELSE disease_id END AS disease_id, CASE WHEN outcome = 'closed' AND action = 'retry_retrieval' THEN 0 ELSE 2 END AS attempts, count(*) AS n FROM o GROUP BY ALL""")
def resolved_cases(spark: SparkSession, d: str) -> DataFrame:
    """One command for the case of each signal, committed: what became of cases and signals."""
    store, v = _resolved(spark, d)
    j = store.read("signals", v).join(store.read("cases", v).select("signal_id", "case_id", "resolution"), "signal_id").join(store.read("outcomes", v), "case_id")
    return j.groupBy("outcome", "status", "resolution", "disease_id", "attempts").agg(F.count("*").alias("n"))


@query(f"""{_RESOLVED}, e AS (SELECT event_key AS event_id, min({_AT}) AS t FROM signals GROUP BY 1), g AS (SELECT event_id, count(*) AS n, max({_AT}) AS u, min({_AT}) AS f FROM al JOIN signals USING (signal_id) WHERE event_id IN (SELECT event_id FROM nl) GROUP BY event_id)
SELECT coalesce(e.event_id, g.event_id) AS event_id, coalesce(n, 0) AS n_articles, greatest(e.t, u) AS updated_s, least(e.t, f) AS start_s, n IS NOT NULL AS scored FROM e FULL JOIN g ON g.event_id = e.event_id""")
def resolved_events(spark: SparkSession, d: str) -> DataFrame:
    """The events after those commands: linked ones updated and counted again, created ones there."""
    store, v = _resolved(spark, d)
    return store.read("events", v).select("event_id", "n_articles", F.unix_seconds("updated").alias("updated_s"), F.unix_seconds("start").alias("start_s"), F.col("early_signal_score").isNotNull().alias("scored"))


@query("SELECT conv_id, CASE conv_id % 5 WHEN 1 THEN 'batch_identity' WHEN 2 THEN 'batch_identity' WHEN 3 THEN 'batch_identity' END AS reason FROM (SELECT conv_id FROM conversations GROUP BY conv_id)")
def batch_identities(spark: SparkSession, d: str) -> DataFrame:
    """Batches are conversations, their ids the turns; an answer may miss one, repeat one or invent one."""
    b = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("sent"))
    got = F.when(F.col("conv_id") % 5 == 1, F.slice("sent", 2, 1000)).when(F.col("conv_id") % 5 == 2, F.array_append("sent", F.col("sent")[0])).when(F.col("conv_id") % 5 == 3, F.array_append("sent", F.lit(-1))).otherwise(F.reverse("sent"))
    return N.batch_identity(b.withColumn("got", got), "sent", "got").select("conv_id", "reason")


@query("""WITH v AS (SELECT doc_id, doc_id % 6 <> 1 AS valid, doc_id % 3 > 0 AS relevant, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'Flu' ELSE 'Cholera' END AS disease, CASE WHEN doc_id % 5 < 3 THEN 'NG' END AS country FROM documents WHERE doc_id % 7 > 0)
SELECT CASE WHEN valid AND NOT relevant THEN 'filtered' ELSE 'normalized' END AS status, CASE WHEN valid THEN 'done' WHEN NOT valid THEN 'failed' ELSE 'pending' END AS triage_status, CASE WHEN valid THEN disease END AS triage_disease, CASE WHEN valid THEN country END AS triage_country, count(*) AS n FROM documents LEFT JOIN v USING (doc_id) GROUP BY 1, 2, 3, 4""")
def recorded_triage(spark: SparkSession, d: str) -> DataFrame:
    s = D.table(spark, d, "documents").select(F.col("doc_id").alias("signal_id"), F.lit("normalized").alias("status"), F.lit("pending").alias("triage_status"))
    i = F.col("signal_id")
    v = s.where("signal_id % 7 > 0").select("signal_id", (i % 6 != 1).alias("valid"), (i % 3 > 0).alias("relevant"), (i % 2 == 0).alias("public_health"), F.when(i % 4 == 0, " unknown ").when(i % 4 == 1, " ").when(i % 4 == 2, "Flu").otherwise("Cholera").alias("disease"), F.when(i % 5 < 3, " ng").otherwise("Nigeria").alias("country"), F.lit("N/A").alias("admin1"))
    return N.record_triage(s, v).groupBy("status", "triage_status", "triage_disease", "triage_country").agg(F.count("*").alias("n"))


@query(f"{_QW} SELECT CASE WHEN l.id IS NULL THEN q.queue_status WHEN l.id = q.signal_id THEN 'extracted' ELSE 'duplicate' END AS status, count(*) AS n, count(CASE WHEN l.id <> q.signal_id THEN 1 END) AS n_pointing FROM queued q LEFT JOIN (SELECT group_id, min(signal_id) AS id FROM queued WHERE group_id % 4 = 0 GROUP BY group_id) l USING (group_id) GROUP BY 1")
def recorded_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d).select("signal_id", "status", "group_id")
    lead = s.where("group_id % 4 = 0").groupBy("group_id").agg(F.min("signal_id").alias("representative_id"))
    members = s.join(lead, "group_id").select("signal_id", "representative_id")
    return N.record_cluster_extraction(s, members).groupBy("status").agg(F.count("*").alias("n"), F.count("duplicate_of").alias("n_pointing"))


_DISEASES = "d AS (SELECT p_partkey AS disease_id, 'Disease ' || (p_partkey % 90) AS canonical_name, 'Syndrome ' || p_partkey AS synonym FROM part)"


@query(f"WITH {_DISEASES}, n AS (SELECT lower(x) AS x, min(disease_id) AS disease_id FROM (SELECT disease_id, canonical_name AS x FROM d UNION ALL SELECT disease_id, synonym FROM d) GROUP BY 1 HAVING count(DISTINCT disease_id) = 1) SELECT c_custkey, disease_id FROM customer LEFT JOIN n ON x = CASE WHEN c_custkey % 3 = 0 THEN 'disease ' || (c_custkey % 100) ELSE 'syndrome ' || (c_custkey % 300) END")
def disease_names(spark: SparkSession, d: str) -> DataFrame:
    diseases = D.table(spark, d, "part").select(F.col("p_partkey").alias("disease_id"), F.concat(F.lit("Disease "), F.col("p_partkey") % 90).alias("canonical_name"), F.array(F.concat(F.lit("Syndrome "), "p_partkey")).alias("synonyms"))
    names = D.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" DISEASE "), F.col("c_custkey") % 100)).otherwise(F.concat(F.lit("syndrome "), F.col("c_custkey") % 300)).alias("name"))
    return N.disease_of(names, diseases).select("c_custkey", "disease_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 < 2 THEN 'd' || (doc_id % 5) ELSE 'd' || (doc_id % 5) END AS slug FROM documents")
def classified_diseases(spark: SparkSession, d: str) -> DataFrame:
    """A model names a disease of the closed list; what is not on it is nothing."""
    rows = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Which? "), F.col("doc_id") % 5).alias("prompt"), F.lit("d0 d1 d2 d3").alias("body"))
    got = M.ask(rows, lambda prompt, fault: (f"d{prompt[-1]}", 3, 1), lambda content, body: None if content in body.split() else "not_listed")
    return got.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("outcome") == "accepted", F.col("content"))).alias("slug"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN doc_id % 6 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome FROM documents")
def model_passes(spark: SparkSession, d: str) -> DataFrame:
    """One pass with one repair: a third of the first answers is faulty, half of these is mended."""
    rows = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("prompt"), F.lit("").alias("body"))
    call = lambda prompt, fault: ("bad" if int(prompt) % 6 == 0 or int(prompt) % 3 == 0 and not fault else "good", 10, 1)
    got = M.ask(rows, call, lambda content, body: None if content == "good" else "shape")
    return got.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.max("attempt").alias("attempts"), F.max_by("outcome", "attempt").alias("outcome"))


@query("SELECT item_id, length(split_part(text, ' ', 1)) + 1 + least(length(text), 1200) AS n_chars, CAST(3 AS BIGINT) AS dims, 1.0 AS norm FROM benchmark")
def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of an injected model, in batches, at length 1."""
    rows = D.table(spark, d, "benchmark").select("item_id", X.embedding_text(F.substring_index("text", " ", 1), F.col("text")).alias("text"))
    got = M.embedded(rows, "item_id", "text", lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts])
    return got.select("item_id", F.round(F.col("embedding")[0] / F.col("embedding")[1]).cast("int").alias("n_chars"), F.size("embedding").cast("bigint").alias("dims"), F.round(T.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


# --- events' records -------------------------------------------------------------------------------------------------

_LINKS = f"links AS (SELECT event_key AS event_id, *, {_AT} AS t, row_number() OVER (PARTITION BY event_key ORDER BY first_seen_s, signal_id) = 1 AS is_primary FROM signals)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("event_key").orderBy("first_seen_s", "signal_id")) == 1
    return D.signals(spark, d).select(F.col("event_key").alias("event_id"), "signal_id", first.alias("is_primary")).withColumn("relationship_type", F.when(F.col("is_primary"), "initial_report").otherwise("supporting_source"))


def _event_sources(spark: SparkSession, d: str, event_id: int | None = None) -> DataFrame:
    s = D.signals(spark, d).select("signal_id", "source", "title", "published_at", "first_seen_at")
    return R.event_sources(_links(spark, d), s, D.sources(spark, d), event_id)


@query(f"{_W}, {_LINKS} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY is_primary DESC, t DESC, signal_id DESC) AS position, signal_id, source, is_official, credibility, title, CASE WHEN is_primary THEN 'initial_report' ELSE 'supporting_source' END AS relationship_type, is_primary FROM links")
def event_sources(spark: SparkSession, d: str) -> DataFrame:
    return _event_sources(spark, d).drop("published_at", "first_seen_at")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    o = E.new_observations(_links(spark, d), D.signals(spark, d), _links(spark, d).where("signal_id % 10 = 3"))
    return o.withColumn("created_at", F.col("reported_at"))


@query(f"{_W} SELECT event_key AS event_id, signal_id, row_number() OVER (PARTITION BY event_key ORDER BY {_AT}, signal_id) AS position, total_cases, CAST(CAST(to_timestamp(published_s) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS observation_date FROM signals WHERE total_cases IS NOT NULL AND signal_id % 10 <> 3")
def event_observations(spark: SparkSession, d: str) -> DataFrame:
    """One observation a link whose signal states a count; a tenth is stored already."""
    return R.event_observations(_observations(spark, d)).select("event_id", "signal_id", "position", "total_cases", F.col("observation_date").cast("string").alias("observation_date"))


@query(f"{_W}, {_LINKS} SELECT event_id, count(*) AS n_sources, count(*) FILTER (total_cases IS NOT NULL AND signal_id % 10 <> 3) AS n_observations, arg_max(signal_id, (is_primary, t, signal_id)) AS first_source, 1 + event_id % 3 AS newest_version FROM links GROUP BY event_id")
def event_details(spark: SparkSession, d: str) -> DataFrame:
    events = D.signals(spark, d).select(F.col("event_key").alias("event_id")).distinct()
    versions = events.select("event_id", F.explode(F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int"))).alias("version"))
    e = R.event_details(events, _event_sources(spark, d), R.event_observations(_observations(spark, d)), R.event_summaries(versions))
    return e.select("event_id", F.size("sources").alias("n_sources"), F.greatest(F.size("observations"), F.lit(0)).alias("n_observations"), F.col("sources")[0]["signal_id"].alias("first_source"), F.col("summaries")[0]["version"].alias("newest_version"))


_DECISIONS = "CASE event_key % 3 WHEN 0 THEN 'attach' WHEN 1 THEN 'refuse' ELSE 'create' END"


@query(f"""{_W}, m AS (SELECT event_key AS cluster_id, signal_id, {_DECISIONS} AS decision, row_number() OVER (PARTITION BY event_key ORDER BY {_AT}, signal_id) AS n, first_value(signal_id) OVER (PARTITION BY event_key ORDER BY {_AT}, signal_id) AS f FROM signals)
SELECT CASE WHEN decision = 'attach' THEN 1000 + cluster_id ELSE -1 - f END AS event_id, signal_id, CASE WHEN decision = 'attach' OR n > 1 THEN 'supporting_source' ELSE 'initial_report' END AS relationship_type, CASE WHEN decision = 'attach' THEN .85 ELSE 1.0 END AS match_score, decision <> 'attach' AND n = 1 AS is_primary FROM m WHERE NOT (decision = 'attach' AND signal_id % 4 = 0)""")
def finalized_links(spark: SparkSession, d: str) -> DataFrame:
    """What decisions append: clusters are the events' keys; a fourth of the attached signals is linked already."""
    m = D.signals(spark, d).select(F.col("event_key").alias("cluster_id"), "signal_id", F.coalesce("published_at", "first_seen_at").alias("at"))
    c = m.select("cluster_id").distinct()
    decisions = c.select("cluster_id", F.expr(_DECISIONS.replace("event_key", "cluster_id")).alias("decision"), F.when(F.col("cluster_id") % 3 == 0, F.col("cluster_id") + 1000).alias("event_id"), F.lit(0.85).alias("score"))
    linked = m.where("signal_id % 4 = 0").select((F.col("cluster_id") + 1000).alias("event_id"), "signal_id")
    return E.finalized_links(m, decisions, linked)


@query(f"""{_W}, e AS (SELECT event_key AS event_id, max({_AT}) AS u FROM signals GROUP BY 1), o AS (SELECT event_key AS event_id, max({_AT}) AS seen FROM signals WHERE total_cases IS NOT NULL GROUP BY 1),
s AS (SELECT *, CASE event_id % 4 WHEN 0 THEN NULL ELSE {D.EPOCH} + event_id * 7200 END AS last FROM e LEFT JOIN o USING (event_id)) SELECT event_id, u AS updated_s FROM s WHERE last IS NULL OR seen > last OR last < {D.NOW} - 150 * 3600 ORDER BY u DESC, event_id LIMIT 25""")
def summaries_due(spark: SparkSession, d: str) -> DataFrame:
    s = D.signals(spark, d)
    e = s.groupBy(F.col("event_key").alias("event_id")).agg(F.max(F.coalesce("published_at", "first_seen_at")).alias("updated"))
    e = e.withColumn("last_summarized_at", F.when(F.col("event_id") % 4 != 0, F.timestamp_seconds(F.lit(D.EPOCH) + F.col("event_id") * 7200)))
    o = s.where("total_cases IS NOT NULL").select(F.col("event_key").alias("event_id"), F.coalesce("published_at", "first_seen_at").alias("reported_at"))
    return E.summaries_due(e, o, D.now(), 150, 25).select("event_id", F.unix_seconds("updated").alias("updated_s"))


@query(f"""{_W}, m AS (SELECT CAST(floor(signal_id / 4) AS BIGINT) AS cluster_id, signal_id, signal_id % 3 AS n_brief, {_AT} AS t FROM signals), e AS (SELECT event_key AS event_id, max({_AT}) AS u FROM signals GROUP BY 1)
SELECT cluster_id, cluster_id % 40 AS event_id, arg_max(signal_id, (t, -signal_id)) AS signal_id FROM m JOIN e ON event_id = cluster_id % 40 WHERE n_brief > 0 AND event_id % 5 > 0 AND {D.NOW} - u <= 864000 GROUP BY cluster_id""")
def delta_targets(spark: SparkSession, d: str) -> DataFrame:
    s = D.signals(spark, d)
    m = s.select((F.floor(F.col("signal_id") / 4)).alias("cluster_id"), "signal_id", (F.col("signal_id") % 3).alias("n_brief"), "published_at", "first_seen_at")
    attached = m.select("cluster_id").distinct().withColumn("event_id", F.col("cluster_id") % 40)
    e = s.groupBy(F.col("event_key").alias("event_id")).agg(F.max(F.coalesce("published_at", "first_seen_at")).alias("updated")).withColumn("has_brief", F.col("event_id") % 5 > 0)
    return E.delta_targets(attached, m, e, D.now())


@query(f"{_W} SELECT event_key, 'EVT-' || upper(substr(sha256(CAST(event_key AS VARCHAR)), 1, 8)) AS public_id, 'event-' || substr(sha256(CAST(event_key AS VARCHAR)), 1, 10) AS slug, 'POINT(' || min(signal_id) || '.5 ' || max(signal_id) || '.0)' AS point, '1. outbreak report: ' || min(signal_id) || chr(10) || '2. outbreak report: ' || max(signal_id) AS prompt FROM signals GROUP BY event_key")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_key").cast("string")
    g = D.signals(spark, d).groupBy("event_key").agg(F.min("signal_id").alias("lo"), F.max("signal_id").alias("hi"))
    line = lambda x, i: F.concat(i, F.lit(". "), X.spaced(F.lit("outbreak_report")), F.lit(": "), x.cast("string"))
    return g.select("event_key", X.public_id(k).alias("public_id"), X.slug(k).alias("slug"), X.point_text(F.col("lo") + 0.5, F.col("hi").cast("double")).alias("point"), X.listing(F.array("lo", "hi"), line).alias("prompt"))


# --- reviews ---------------------------------------------------------------------------------------------------------

_WHY = "CASE signal_id % 7 WHEN 0 THEN 'retrieval_failed' WHEN 1 THEN 'extraction_rejected' WHEN 2 THEN 'disease_unresolved' WHEN 3 THEN 'location_unresolved' WHEN 4 THEN 'event_match_ambiguous' WHEN 5 THEN 'content_integrity' ELSE 'legacy_unclassified' END"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    s = D.signals(spark, d)
    return s.where("signal_id % 3 = 0").select((F.col("signal_id") + 5000).alias("case_id"), "signal_id", F.expr(_WHY).alias("reason"), F.col("first_seen_at").alias("opened_at"), F.when(F.col("signal_id") % 2 == 0, "open").otherwise("resolved").alias("state"), F.lit(None).cast("string").alias("resolution"))


@query(f"{_W}, c AS (SELECT *, {_WHY} AS reason FROM signals WHERE signal_id % 6 = 0 ORDER BY first_seen_s, signal_id LIMIT 20 OFFSET 5) SELECT signal_id + 5000 AS case_id, reason, CASE WHEN signal_id % 12 = 0 THEN 'English ' || signal_id ELSE title END AS title, source, CASE WHEN signal_id % 12 = 0 THEN 'flu' END AS extracted_disease, CASE disease_id WHEN 'd0' THEN 'Zero' WHEN 'd2' THEN 'Two' END AS canonical_name, CASE WHEN signal_id % 4 = 0 THEN signal_id + 1 || ',' || signal_id END AS candidates, CASE signal_id % 7 WHEN 0 THEN 'dismiss,retry_retrieval' WHEN 1 THEN 'dismiss,retry_extraction' WHEN 2 THEN 'assign_disease,dismiss' WHEN 3 THEN 'dismiss,retry_geocoding' WHEN 4 THEN 'create_event,dismiss,link_event' ELSE 'dismiss' END AS allowed FROM c")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The second page of open cases; every second signal has an English title and a disease from its extraction."""
    has = F.col("signal_id") % 12 == 0
    s = D.signals(spark, d).select("signal_id", "title", "source", "disease_id", F.when(has, F.concat(F.lit("English "), "signal_id")).otherwise("  ").alias("title_english"), F.when(has, "flu").alias("disease_name"))
    diseases = spark.createDataFrame([("d0", "Zero"), ("d2", "Two")], "disease_id string, canonical_name string")
    cases = _cases(spark, d)
    cand = cases.where("signal_id % 4 = 0").select("case_id", F.explode(F.array(F.struct(F.col("signal_id").alias("event_id"), F.lit(0.5).alias("match_score")), F.struct((F.col("signal_id") + 1).alias("event_id"), F.lit(0.7).alias("match_score")))).alias("e")).select("case_id", "e.*")
    q = V.review_queue(cases, s, D.sources(spark, d).select("source"), diseases, cand, 20, 5)
    return q.select("case_id", "reason", "title", "source", "extracted_disease", "canonical_name", F.nullif(F.array_join(F.transform("candidate_events", lambda x: x.cast("string")), ","), F.lit("")).alias("candidates"), F.array_join("allowed", ",").alias("allowed"))


@query(f"{_W}, c AS (SELECT *, {_WHY} AS reason, signal_id % 2 = 0 AS open_ FROM signals), k AS (SELECT CASE WHEN NOT open_ THEN 'resolved' WHEN reason = 'retrieval_failed' AND signal_id % 4 = 0 THEN 'recovered' ELSE 'open' END AS state FROM c WHERE signal_id % 3 = 0 UNION ALL SELECT 'open' FROM c WHERE signal_id % 5 = 0 AND NOT (signal_id % 6 = 0)) SELECT state, count(*) AS n FROM k GROUP BY 1")
def review_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases after a run: every fifth signal asks for one (twice), every fourth has recovered."""
    s = D.signals(spark, d)
    wanted = s.where("signal_id % 5 = 0").select("signal_id", F.lit("content_integrity").alias("reason"), F.col("first_seen_at").alias("opened_at"))
    after = V.recovered(V.open_reviews(_cases(spark, d), wanted.unionByName(wanted.withColumn("reason", F.lit("legacy_unclassified")))), s.where("signal_id % 4 = 0").select("signal_id"))
    return after.groupBy(F.when(F.col("resolution") == "recovered_automatically", "recovered").otherwise(F.col("state")).alias("state")).agg(F.count("*").alias("n"))


# --- runs ------------------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'partial' END AS status, CASE WHEN o_orderstatus <> 'O' THEN epoch(o_orderdate) + 600 WHEN o_custkey % 5 = 0 THEN epoch(o_orderdate) + 60 END AS finished_s, epoch(o_orderdate) AS started_s, o_custkey AS k FROM orders)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    o, k = D.table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("partial").alias("status"), F.col("at").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("at") + F.expr("interval 600 seconds")).when(F.col("o_custkey") % 5 == 0, F.col("at") + F.expr("interval 60 seconds")).alias("finished_at"),
        F.when(F.col("o_custkey") % 4 == 0, "[1]").otherwise(F.concat(F.lit('{"match":{"seen":'), k, F.lit(',"ok":true,"rate":0.5,"note":"7"},"odd":3,"triage":{}}'))).alias("stage_counts"),
        F.concat(F.lit('{"normalized":'), k, F.lit(',"x":"2","y":null}')).alias("backlog"),
        F.when(F.col("o_custkey") % 3 == 0, '["match","nonsense",{"stage":"embed","error":" Value_Error "},{"stage":"extract","error":"bad name!"},{"stage":"nope"},5]').alias("failed_stages"),
        F.lit("discovery").alias("chain"), F.when(F.col("o_custkey") % 2 == 0, F.col("at")).alias("window_end"),
    )


@query(f"WITH {_RUNS}, p AS (SELECT * FROM runs ORDER BY started_s DESC, run_id LIMIT 100) SELECT run_id, status, CASE WHEN k % 4 = 0 THEN '' ELSE 'match:seen=' || k || ';triage:' END AS stage_counts, 'normalized=' || k AS backlog, CASE WHEN k % 3 = 0 THEN 'match,embed Value_Error,extract' ELSE '' END AS failures, status = 'running' AND finished_s IS NULL AND epoch(TIMESTAMP '1998-08-01') - started_s > 120 * 60 AS is_stale FROM p")
def pipeline_runs(spark: SparkSession, d: str) -> DataFrame:
    r = U.pipeline_runs(_runs(spark, d), F.lit("1998-08-01").cast("timestamp"), 60, 100)
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    stages = F.array_join(F.transform(F.array_sort(F.map_keys("stage_counts")), lambda k: F.concat(k, F.lit(":"), flat(F.col("stage_counts")[k]))), ";")
    failures = F.array_join(F.transform("failures", lambda f: F.concat_ws(" ", f["stage"], f["error"])), ",")
    return r.select("run_id", "status", stages.alias("stage_counts"), flat(F.col("backlog")).alias("backlog"), failures.alias("failures"), "is_stale")


@query(f"WITH {_RUNS}, w AS (SELECT arg_max(started_s, started_s) AS e FROM runs WHERE k % 2 = 0 AND status <> 'running'), c AS (SELECT o_orderkey, epoch(o_orderdate) AS t, CASE WHEN o_custkey % 3 > 0 THEN e END AS e FROM orders, w) SELECT o_orderkey, CAST(least(t, greatest(coalesce(e, t - 30 * 60), t - 7 * 86400)) AS BIGINT) AS start_s FROM c")
def catch_up_windows(spark: SparkSession, d: str) -> DataFrame:
    """The polling window at each order's date, from the last run's end where there is one."""
    last = U.last_window_end(_runs(spark, d), "discovery")
    o = D.table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")).crossJoin(F.broadcast(last))  # one row
    start, _ = T.catch_up(F.col("at"), F.when(F.col("o_custkey") % 3 > 0, F.col("window_end")), 30, 7 * 24 * 60)
    return o.select("o_orderkey", F.unix_seconds(start).alias("start_s"))


@query("SELECT 'partial' AS status, 'Flaw' AS error, count(*) AS n_documents, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS n_even FROM documents")
def chain_log(spark: SparkSession, d: str) -> DataFrame:
    """A chain of three stages, the second of which fails, and what its log then says."""
    class Flaw(Exception):
        pass

    def flawed() -> dict[str, int]:
        raise Flaw("not for the log")

    docs = D.table(spark, d, "documents")
    count = lambda df: df.agg(F.count("*").alias("n")).first().n
    got = U.run_chain(spark, [("ingest", lambda: {"seen": count(docs)}), ("match", flawed), ("embed", lambda: {"even": count(docs.where("doc_id % 2 = 0"))})])
    empty = spark.createDataFrame([], "run_id long, status string, started_at timestamp, finished_at timestamp, stage_counts string, backlog string, failed_stages string")
    log = U.started(empty, spark.createDataFrame([(1,)], "run_id long").withColumn("started_at", D.now()))
    r = U.pipeline_runs(U.finished(log, got, 1, D.now(), docs.select(F.lit("fetched").alias("status")).groupBy("status").agg(F.count("*").alias("n"))), D.now(), 60)
    return r.select("status", F.col("failures")[0]["error"].alias("error"), F.col("backlog")["fetched"].alias("n_documents"), F.col("stage_counts")["embed"]["even"].alias("n_even"))


@query("SELECT model, count(*) AS n, count(*) FILTER (spent < 300) AS n_ran FROM (SELECT l_suppkey % 4 AS model, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM lineitem) GROUP BY model")
def guarded_cases(spark: SparkSession, d: str) -> DataFrame:
    l = D.table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("model"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_quantity").cast("bigint").alias("cost"))
    return U.guarded_cases(l, "seq", "cost", 300).groupBy("model").agg(F.count("*").alias("n"), F.count_if("ran").alias("n_ran"))


@query("SELECT 'absent' AS table_name, 'missing' AS state, 0 AS n UNION ALL SELECT 'none', 'empty', 0 UNION ALL SELECT 'orders', 'filled', count(*) FROM orders UNION ALL SELECT 'part', 'filled', count(*) FROM part")
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "part")
    return R.schema_report(spark, ["orders", "part", "absent", "none"], {"orders": D.table(spark, d, "orders"), "part": p, "none": p.where("p_partkey < 0"), "other": p})


@query(f"SELECT page_id, {D.NOW} + 5 * (row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1) AS due_s FROM pages WHERE page_id < 40")
def paced_fetches(spark: SparkSession, d: str) -> DataFrame:
    """The first forty pages, those of a host five seconds apart: the cap is a run's."""
    p = D.table(spark, d, "pages").select("page_id", (F.col("page_id") % 7).alias("host"))
    return U.paced(p, "host", ["page_id"], D.now(), 5, 40).select("page_id", F.unix_seconds("due_at").alias("due_s"))


# --- a reader's page, writes by rule ---------------------------------------------------------------------------------


@query(f"{_W}, e AS (SELECT event_key, arg_min(title, (first_seen_s, signal_id)) AS title, first(country ORDER BY first_seen_s, signal_id) AS country, max({_AT}) AS l FROM signals GROUP BY 1) SELECT event_key, country FROM e WHERE contains(lower(concat_ws(' ', title, 'd' || event_key % 4, country, 'unit')), 'd1') AND country IN ('C1', 'C5') AND l >= {D.NOW} - 200 * 3600 AND l < {D.EPOCH} + 7 * 86400")
def events_within_reach(spark: SparkSession, d: str) -> DataFrame:
    first = F.struct("first_seen_s", "signal_id")
    e = D.signals(spark, d).groupBy("event_key").agg(F.min_by("title", first).alias("title"), F.min_by("country", first).alias("country"), F.max(F.coalesce("published_at", "first_seen_at")).alias("last_updated_at"))
    e = e.withColumn("disease", F.concat(F.lit("d"), F.col("event_key") % 4)).withColumn("admin1", F.lit("unit"))
    return R.within_reach(e, " D1 ", {"odd": ["C1", "C5"]}, "odd", D.now(), 200, F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date")).select("event_key", "country")


@query(f"{_W}, e AS (SELECT * FROM signals WHERE disease_id IS NOT NULL) SELECT count(*) AS n_events, count(*) FILTER (signal_id % 4 > 0) AS n_mapped, count(*) FILTER (status = 'matched') AS n_active, count(DISTINCT country) AS n_countries, array_to_string(list_sort(list(DISTINCT disease_id)), ',') AS diseases, array_to_string(list_sort(list(DISTINCT country)), ',') AS countries FROM e")
def shown_totals(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("signal_id") % 4
    e = D.signals(spark, d).where("disease_id IS NOT NULL").withColumn("disease", F.col("disease_id")).withColumn("status", F.when(F.col("status") == "matched", "active").otherwise("closed"))
    e = e.withColumn("latitude", F.when(i > 0, F.col("latitude")).when(F.col("signal_id") % 8 == 0, F.lit(float("nan"))))
    t = R.shown_totals(e)
    return t.withColumn("diseases", F.array_join("diseases", ",")).withColumn("countries", F.array_join("countries", ","))


@query("SELECT c_custkey AS case_id, CASE WHEN c_acctbal < 0 THEN 'retrieval_failed' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'event_match_ambiguous' ELSE 'legacy_unclassified' END AS reason FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 5 > 0")
def backfilled_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases made of rows by rule, with a look-up; those that have one (each fifth) stay as they are."""
    c, o = D.table(spark, d, "customer"), D.table(spark, d, "orders")
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    j = c.where("c_mktsegment = 'BUILDING'").join(pending, "c_custkey", "left").join(c.where("c_custkey % 5 = 0").select("c_custkey"), "c_custkey", "left_anti")
    return j.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_acctbal") < 0, "retrieval_failed").when(F.col("hit"), "event_match_ambiguous").otherwise("legacy_unclassified").alias("reason"))


@query("SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1 HAVING count(l_linenumber) <> 1")
def cardinality_faults(spark: SparkSession, d: str) -> DataFrame:
    """Parents that have not exactly one child of a kind."""
    l = D.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return D.table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


@query(r"SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(p_name || ' - ' || p_brand, '\s+-\s+[^-]*$', ''), '[^A-Za-z0-9]+', ' ', 'g'))) AS slug FROM part")
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    """A column backfilled by nested replacements."""
    raw = F.concat("p_name", F.lit(" - "), "p_brand")
    return D.table(spark, d, "part").select("p_partkey", F.btrim(F.lower(F.regexp_replace(F.regexp_replace(raw, r"\s+-\s+[^-]*$", ""), "[^A-Za-z0-9]+", " "))).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'port b' ELSE 'port b,port ' || (c_custkey % 7) END AS alternates FROM customer")
def alternate_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    names = F.when(i % 4 == 0, F.array(F.lit("A "), F.lit("--"), F.lit(""))).when(i % 4 == 1, F.array(F.lit("Port-B"), F.lit("port  b"), F.lit("a"))).otherwise(F.array(F.lit("PORT B"), F.concat(F.lit("Port "), i % 7), F.lit("Port b")))
    return D.table(spark, d, "customer").select("c_custkey", F.array_join(P.alternates(names, F.lit("A")), ",").alias("alternates"))


# --- functions and small operators, each on whole tables -------------------------------------------------------------

_ZONES = ["Z", "+02:00", "-0530", ""]


@query(f"""WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT + o_custkey % 86400 AS t, o_orderkey % 4 AS z FROM orders)
SELECT o_orderkey, t - [0, 7200, -19800, 0][z + 1] AS iso_s, [0, 120, -330, NULL][z + 1] AS offset_minutes, CASE WHEN o_orderkey % 5 > 0 THEN t - 3600 END AS feed_s, CASE WHEN o_orderkey % 7 > 0 THEN t END AS seen_s, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM o""")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Times written as ISO, RFC 2822 and compact texts, some of them broken, and read back."""
    t = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 86400)
    iso = F.concat(F.lit(" "), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("o_orderkey") % 4 + 1).cast("int")))
    feed = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Thu, "), F.date_format(t, "d MMM yyyy HH:mm:ss"), F.lit(" +0100"))).otherwise("yesterday")
    seen = F.when(F.col("o_orderkey") % 7 > 0, F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")).otherwise("20240132T000000Z")
    o = D.table(spark, d, "orders").select("o_orderkey", iso.alias("iso"), feed.alias("feed"), seen.alias("seen"), t.alias("t"))
    return o.select("o_orderkey", F.unix_seconds(T.iso_time(F.col("iso"))).alias("iso_s"), T.stated_offset(F.btrim("iso")).alias("offset_minutes"), F.unix_seconds(T.feed_time(F.col("feed"))).alias("feed_s"), F.unix_seconds(T.seen_time(F.col("seen"))).alias("seen_s"), F.to_date("t").cast("string").alias("day"))


_P = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))")
_R = "CASE {}.precision WHEN 'place' THEN 4 WHEN 'admin2' THEN 3 WHEN 'admin1' THEN 2 WHEN 'country' THEN 1 ELSE 0 END"
_SHARED = f"least({_R.format('a')}, {_R.format('b')})"


@query(f"""{_W}, p AS (SELECT signal_id, {_AT} AS t, country, admin1, admin2, precision, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon FROM signals)
SELECT a.signal_id, k, round({_P}, 5) AS km, coalesce(CASE {_SHARED} WHEN 0 THEN FALSE WHEN 1 THEN a.country = b.country WHEN 2 THEN a.country = b.country AND a.admin1 = b.admin1 WHEN 3 THEN a.country = b.country AND NOT coalesce(a.admin1 <> b.admin1, FALSE) AND a.admin2 = b.admin2 ELSE a.country = b.country AND {_P} <= 50 END, FALSE) AS together, abs(a.t - b.t) <= 0.5 * 86400 AS near_in_time
FROM p a, (SELECT unnest([6, 12, 13]) AS k) JOIN p b ON b.signal_id = a.signal_id + k""")
def compared_places(spark: SparkSession, d: str) -> DataFrame:
    """Each signal against three others: kilometres, whether the places agree at the coarser precision, and the times."""
    s = D.signals(spark, d).select("signal_id", F.coalesce("published_at", "first_seen_at").alias("at"), F.struct("country", "admin1", "admin2", "latitude", "longitude", "precision").alias("place"))
    o = s.select(F.col("signal_id").alias("o_id"), F.col("at").alias("o_at"), F.col("place").alias("o_place"))
    j = s.withColumn("k", F.explode(F.array(F.lit(6), F.lit(12), F.lit(13)))).join(o, F.col("o_id") == F.col("signal_id") + F.col("k"))
    km = T.haversine_km(F.col("place.latitude"), F.col("place.longitude"), F.col("o_place.latitude"), F.col("o_place.longitude"))
    return j.select("signal_id", "k", F.round(km, 5).alias("km"), T.spatially_compatible("place", "o_place").alias("together"), T.within_days(F.col("at"), F.col("o_at"), 0.5).alias("near_in_time"))


@query("SELECT n_nationkey AS model_id, tier FROM (SELECT n_nationkey, n_nationkey % 4 + 1 AS tier, CASE n_nationkey % 3 WHEN 0 THEN 'triage' WHEN 1 THEN 'extraction' END AS purpose, n_nationkey % 5 > 0 AS active FROM nation) WHERE active AND coalesce(purpose, 'triage') = 'triage' AND tier BETWEEN 2 AND 3")
def model_roster(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    models = D.table(spark, d, "nation").select(k.alias("model_id"), (k % 4 + 1).alias("tier"), F.when(k % 3 == 0, "triage").when(k % 3 == 1, "extraction").alias("purpose"), (k % 5 > 0).alias("active"))
    return M.roster(models, "triage", 3, 2).select("model_id", "tier")


@query(f"""{_W}, o AS (SELECT signal_id, CAST(signal_id / 2 - signal_id % 2 * 0.5 AS BIGINT) % 50 AS url, CASE WHEN signal_id % 4 = 0 THEN NULL ELSE 'h' || signal_id % 3 END AS h FROM signals),
n AS (SELECT signal_id, url, 'h' || signal_id % 7 AS h FROM o WHERE signal_id % 4 = 0), taken AS (SELECT n.signal_id FROM n JOIN o ON o.url = n.url AND o.h = n.h AND o.signal_id <> n.signal_id UNION SELECT n.signal_id FROM n JOIN n m ON m.url = n.url AND m.h = n.h AND m.signal_id < n.signal_id)
SELECT count(*) AS n, count(o.h) + (SELECT count(*) FROM n) - (SELECT count(*) FROM taken) AS n_hashed, (SELECT count(*) FROM n) - (SELECT count(*) FROM taken) AS n_promoted, count(*) FILTER (o.signal_id % 4 = 0 AND o.signal_id NOT IN (SELECT signal_id FROM taken)) AS n_with_body FROM o""")
def promoted_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth signal is a stub that gets its body, unless another row has that url and hash or gets it first."""
    i = F.col("signal_id")
    old = D.signals(spark, d).select("signal_id", (((i - i % 2) / 2).cast("bigint") % 50).alias("url"), F.when(i % 4 != 0, F.concat(F.lit("h"), i % 3)).alias("content_hash"), F.lit(None).cast("string").alias("raw_text"))
    bodies = old.where("signal_id % 4 = 0").withColumns({"content_hash": F.concat(F.lit("h"), i % 7), "raw_text": F.lit("body")})
    after = K.promote(old, bodies)
    n = after.agg(F.count("*").alias("n"), F.count("content_hash").alias("n_hashed"), F.count("raw_text").alias("n_with_body"))
    return n.withColumn("n_promoted", F.col("n_with_body"))


@query("SELECT 'd' || k AS domain, CASE WHEN k < 40 THEN 'Name ' || k WHEN k % 60 < 40 OR row_number() OVER (PARTITION BY k < 40, k % 60 ORDER BY 'd' || k) > 1 THEN 'd' || k ELSE 'Name ' || k % 60 END AS name FROM (SELECT DISTINCT c_custkey % 200 AS k FROM customer)")
def publishers(spark: SparkSession, d: str) -> DataFrame:
    """Publishers by domain: forty are known, the others' names repeat, and a name that is taken falls back to the domain."""
    k = F.col("k")
    c = D.table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("k")).distinct()
    rows = c.select(F.concat(F.lit("d"), k).alias("domain"), F.concat(F.lit("Name "), F.when(k < 40, k).otherwise(k % 60)).alias("name"), "k")
    return K.get_or_create(rows.where("k < 40").drop("k"), rows.where("k >= 40").drop("k"), "domain", "name")


_SPOT = "CASE signal_id % 9 WHEN 0 THEN NULL ELSE CAST(latitude AS DOUBLE) END"


@query(f"""{_W}, p AS (SELECT CAST(floor(signal_id / 4) AS BIGINT) AS s, signal_id AS place_id, CASE WHEN signal_id % 5 = 0 THEN 'primary' ELSE 'mention' END AS role, precision, {_SPOT} AS lat, CASE WHEN signal_id % 3 = 0 THEN ' ng' ELSE 'Nigeria' END AS c, CASE precision WHEN 'place' THEN 4 WHEN 'admin2' THEN 3 WHEN 'admin1' THEN 2 ELSE 1 END AS r FROM signals),
f AS (SELECT s, arg_min({{'place_id': place_id, 'precision': precision, 'lat': lat, 'country': CASE c WHEN ' ng' THEN 'NG' END}}, (role <> 'primary', -r, place_id)) AS p FROM p WHERE lat IS NOT NULL AND precision <> 'unresolved' GROUP BY s)
SELECT s AS signal_id, p.place_id AS place_id, p.precision AS precision, p.lat AS latitude, p.country AS country, CASE WHEN s % 3 = 0 THEN 'Kano' WHEN p.country IS NOT NULL THEN p.country ELSE 'Unknown' END AS label FROM f""")
def representative_places(spark: SparkSession, d: str) -> DataFrame:
    """One plottable place for each signal of four, its country's code, and what a map calls it."""
    i = F.col("signal_id")
    p = D.signals(spark, d).select(F.floor(i / 4).alias("signal_id"), i.alias("place_id"), F.when(i % 5 == 0, "primary").otherwise("mention").alias("role"), "precision", F.expr(_SPOT).alias("latitude"), F.when(F.expr(_SPOT).isNotNull(), F.col("longitude")).alias("longitude"), F.when(i % 3 == 0, " ng").otherwise("Nigeria").alias("country"))
    r = R.representative_places(p)
    return r.select("signal_id", "place_id", "precision", "latitude", "country", P.label(F.when(F.col("signal_id") % 3 == 0, "Kano"), F.lit(""), F.col("country")).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN regexp_extract(left(text, 80), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(left(text, 80), '(?s)^(.+) [^ ]*$', 1) ELSE left(text, 80) END AS short, CASE doc_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN NULL ELSE '_x' END AS error, CASE doc_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' END AS country, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (doc_id % 90) || '.5,' || (doc_id % 40) || '.0]},"properties":{"doc_id":' || doc_id || '}}' AS feature FROM documents""")
def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at a word, safe names of errors, codes of countries, GeoJSON points."""
    i = F.col("doc_id")
    t = D.table(spark, d, "documents").select("doc_id", X.truncate_words(F.col("text"), 80).alias("short"), X.exception_name(F.when(i % 3 == 0, "ValueError").when(i % 3 == 1, "bad name").otherwise("_x")).alias("error"), X.country_code(F.when(i % 4 == 0, " de").when(i % 4 == 1, "fr ").when(i % 4 == 2, "unknown")).alias("country"), (i % 90 + 0.5).cast("double").alias("lon"), (i % 40).cast("double").alias("lat"))
    return t.select("doc_id", "short", "error", "country", P.feature(["doc_id"], "lat", "lon").alias("feature"))


@query("""SELECT doc_id AS signal_id, CASE WHEN c IS NULL THEN NULL ELSE c END AS place_country, CASE WHEN c IS NOT NULL THEN a END AS place_admin1, CASE WHEN c IS NULL THEN 'unresolved' WHEN a IS NOT NULL THEN 'admin1' ELSE 'country' END AS place_precision
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'GH' WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'NG' ELSE 'CD' END AS c, CASE WHEN doc_id % 5 = 0 THEN 'Stated' WHEN doc_id % 4 = 1 THEN 'First' WHEN doc_id % 4 > 1 THEN 'Main' END AS a FROM documents)""")
def direct_locations(spark: SparkSession, d: str) -> DataFrame:
    """The place of a signal from its extraction: none, one mention, or a primary place behind one; triage's facts first."""
    i = F.col("doc_id")
    place = lambda role, c, a: F.struct(F.lit(role).alias("role"), F.lit(c).alias("country"), F.lit(a).alias("admin1"))
    locations = F.when(i % 4 == 0, F.array().cast("array<struct<role:string,country:string,admin1:string>>")).when(i % 4 == 1, F.array(place("mention", "ng", "First"))).otherwise(F.array(place("mention", "NG", "First"), place("primary", "cd", "Main")))
    s = D.table(spark, d, "documents").select(i.alias("signal_id"), locations.alias("locations"), F.when(i % 3 == 0, "gh").alias("country"), F.when(i % 5 == 0, "Stated").otherwise(" ").alias("admin1"))
    return P.direct_location(s, "locations", "country", "admin1").select("signal_id", "place_country", "place_admin1", "place_precision")


@query(f"{_W}, l AS (SELECT event_key, max({D.EPOCH} + event_key * 6000) AS last FROM signals WHERE event_key % 3 > 0 GROUP BY 1) SELECT event_key, count(*) FILTER (last IS NULL OR first_seen_s > last) AS n_new, event_key % 4 = 0 OR event_key % 4 = 3 AS same FROM signals LEFT JOIN l USING (event_key) GROUP BY event_key")
def unsummarized(spark: SparkSession, d: str) -> DataFrame:
    """Articles since each event's last summary, and whether the counts are still those of the summary."""
    s = D.signals(spark, d)
    last = s.where("event_key % 3 > 0").select("event_key", F.timestamp_seconds(F.lit(D.EPOCH) + F.col("event_key") * 6000).alias("created_at"))
    k = F.col("event_key") % 4
    counts = lambda total: F.struct(total.cast("long").alias("total"), F.lit(None).cast("long").alias("deaths"))
    n = M.unsummarized(s, last).withColumns({"a": F.when(k != 0, counts(F.when(k == 1, 5).when(k == 2, 6))), "b": F.when(k.isin(1, 2, 3), counts(F.when(k == 1, 6)))})
    return n.select("event_key", "n_new", M.same_counts("a", "b", ("total", "deaths")).alias("same"))
