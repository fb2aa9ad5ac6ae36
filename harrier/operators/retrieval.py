"""From sightings to signals: pages fetched or deferred, headlines known already, what becomes of each try."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import html as H
from harrier.functions import text as X

#: The shortest body, the largest page and the kinds of page that are read.
LEAST_BODY, MOST_BYTES = 200, 2_000_000
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def readable_pages(pages: DataFrame, kind: str = "content_type") -> DataFrame:
    """Landed pages (url, html, a content type) with the reason against reading them: too_large, not_html or null."""
    plain = F.trim(F.lower(F.substring_index(F.col(kind), ";", 1)))
    return pages.withColumn("unreadable", F.when(F.octet_length("html") > MOST_BYTES, "too_large").when(~F.coalesce(plain.isin(*PAGE_TYPES), F.lit(False)), "not_html"))


def retrieved(sightings: DataFrame, pages: DataFrame) -> DataFrame:
    """Sightings (url, canonical_url, title, domain, language, country) with the page behind each. A page is no article if
    it is missing or has fewer than LEAST_BODY characters; then what is known is the headline, and body and time are null.
    The publisher is the page's site name, else the domain."""
    p = pages.select("url", H.extract_page(F.col("html")).alias("page"))
    j = sightings.join(p, "url", "left")
    found = F.coalesce(F.length("page.body") >= LEAST_BODY, F.lit(False))
    title = F.when(found, F.coalesce("page.title", "title")).otherwise(F.col("title"))
    body = F.when(found, F.col("page.body"))
    publisher = F.struct("domain", F.coalesce(F.when(found, F.col("page.site_name")), F.col("domain")).alias("name"), "language", "country")
    return j.select(*[c for c in sightings.columns if c != "title"], title.alias("title"), body.alias("raw_text"), F.when(found, F.col("page.published_at")).alias("published_at"), F.when(found, F.col("page.offset_minutes")).alias("offset_minutes"), X.content_hash(title, body).alias("content_hash"), publisher.alias("publisher"), (~found).alias("failed"), F.lit("fetched").alias("status"))


def title_duplicates(waiting: DataFrame, signals: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """(signal_id, primary_id): the earliest signal with a body, no duplicate itself, first seen within hours of now, that
    has the same headline."""
    known = signals.where(F.col("raw_text").isNotNull() & (F.col("status") != "duplicate") & (F.col("first_seen_at") >= now - F.make_interval(hours=F.lit(hours))))
    first = known.groupBy("normalized_title").agg(F.min_by("signal_id", F.struct("first_seen_at", "signal_id")).alias("primary_id"))
    return waiting.select("signal_id", "normalized_title").join(first, "normalized_title").where("primary_id <> signal_id").select("signal_id", "primary_id")


def retrieval_routes(waiting: DataFrame, duplicates: DataFrame, fetched: DataFrame, taken: DataFrame, keywords: list[str]) -> DataFrame:
    """What becomes of each waiting signal (signal_id, title): filtered without a keyword in its title, duplicate of a known
    headline, still_failing without a page, redundant if another row has the page's url and hash, else retrieved.

    fetched: (signal_id, canonical_url, content_hash, failed); taken: (canonical_url, content_hash) stored with bodies."""
    t = X.collapse(X.fold(F.col("title")))
    wanted = reduce(lambda a, b: a | b, [F.contains(t, F.lit(k.casefold())) for k in keywords]) if keywords else F.lit(True)
    same = taken.select("canonical_url", "content_hash").distinct().withColumn("_taken", F.lit(True))
    j = waiting.join(duplicates, "signal_id", "left").join(fetched.join(same, ["canonical_url", "content_hash"], "left"), "signal_id", "left")
    route = F.when(~wanted, "filtered").when(F.col("primary_id").isNotNull(), "duplicate").when(F.coalesce("failed", F.lit(True)), "still_failing").when(F.col("_taken"), "redundant").otherwise("retrieved")
    return j.select(*waiting.columns, "primary_id", route.alias("route"))


def ingested(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Normalized documents (url, content_hash, error) by outcome: failed or rejected with an error, skipped if the pair of
    url and hash is stored or came earlier (pos) in this run, else inserted."""
    first = documents.where("error IS NULL").groupBy("url", "content_hash").agg(F.min("pos").alias("_first"))
    known = stored.select("url", "content_hash").distinct().withColumn("_known", F.lit(True))
    j = documents.join(first, ["url", "content_hash"], "left").join(known, ["url", "content_hash"], "left")
    outcome = F.when(F.col("error") == "unsupported", "rejected").when(F.col("error").isNotNull(), "failed").when(F.col("_known") | (F.col("pos") > F.col("_first")), "skipped").otherwise("inserted")
    return j.withColumn("outcome", outcome).drop("_first", "_known")
