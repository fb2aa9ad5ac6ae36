"""The surveillance tables, derived from the test tables by fixed rules.

Documents are signals, their sources publishers; everything that the documents do not say (times, places, diseases,
counts) is arithmetic on the document id, so that SQL can say the same. Times are seconds since 1970 as well as timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import places as P

#: Midnight of 2024-01-01, and the clock that stands for now in every query.
EPOCH = 1704067200
NOW = EPOCH + 8 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIGNAL_RULES = {
    "signal_id": "doc_id",
    "title": "split_part(text, chr(10), 1)",
    "raw_text": "text",
    "language": "lang",
    "source": "source",
    "first_seen_s": f"{EPOCH} + doc_id * 600",
    "published_s": f"CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {EPOCH} + doc_id * 600 - (doc_id % 50) * 3600 END",
    "disease_id": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('d', doc_id % 4) END",
    "disease_text": "CASE WHEN doc_id % 10 = 5 THEN concat(' Grippe  ', doc_id % 3) END",
    "country": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('C', doc_id % 6) END",
    "admin1": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('A', doc_id % 4) END",
    "admin2": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('B', doc_id % 3) END",
    "precision": "CASE doc_id % 5 WHEN 0 THEN 'country' WHEN 1 THEN 'place' WHEN 2 THEN 'admin2' WHEN 3 THEN 'admin1' ELSE CASE WHEN doc_id % 2 = 0 THEN 'unresolved' ELSE 'place' END END",
    "latitude": "(doc_id % 6) * 10.0 - 30.0 + (doc_id % 13) * 0.05",
    "longitude": "(doc_id % 6) * 20.0 - 60.0 + (doc_id % 17) * 0.05",
    "is_official": "source IN ('src0', 'src5', 'src10', 'src15')",
    "credibility": "CASE WHEN source IN ('src0', 'src5', 'src10', 'src15') THEN 'official' WHEN source IN ('src4', 'src8', 'src12', 'src16') THEN 'high' WHEN source IN ('src1', 'src9', 'src13', 'src17') THEN 'medium' ELSE 'unknown' END",
    "total_cases": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id * 7) % 100 END",
    "confidence": "(doc_id % 10) / 10.0",
    "status": "CASE doc_id % 6 WHEN 0 THEN 'fetched' WHEN 1 THEN 'normalized' WHEN 2 THEN 'extracted' WHEN 3 THEN 'matched' WHEN 4 THEN 'duplicate' ELSE 'failed' END",
    "rule_group": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('r', doc_id % 3) END",
    "event_key": "doc_id % 40",
}

#: What the work queues look at; body is the text, missing for some.
QUEUE_RULES = {
    "body": "CASE WHEN signal_id % 17 = 0 THEN NULL ELSE raw_text END",
    "queue_status": "CASE signal_id % 8 WHEN 0 THEN 'fetched' WHEN 1 THEN 'normalized' WHEN 2 THEN 'normalized' WHEN 3 THEN 'normalized' WHEN 4 THEN 'extracted' WHEN 5 THEN 'geocoded' WHEN 6 THEN 'matched' ELSE 'published' END",
    "attempts": "signal_id % 5",
    "triage_status": "CASE signal_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END",
    "relevant": "CASE WHEN signal_id % 7 = 3 THEN NULL ELSE signal_id % 7 < 5 END",
    "embedded": "signal_id % 5 = 0",
    "extracted": "signal_id % 4 <> 1",
    "extraction_version": "CASE signal_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END",
    "valid": "signal_id % 9 <> 0",
    "group_id": "CAST(floor(signal_id / 5) AS BIGINT)",
    "role": "CASE WHEN signal_id % 5 = (signal_id * 7) % 3 THEN 'representative' ELSE 'deferred' END",
}
QUEUES_SQL = "queued AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in QUEUE_RULES.items()) + " FROM signals), grouped AS (SELECT group_id, CASE group_id % 4 WHEN 0 THEN 'resolved' ELSE 'open' END AS state, min(first_seen_s) AS opened_s FROM queued GROUP BY group_id)"

#: A gazetteer: countries, first level units and places, with names that differ in accents and case, some of them shared.
GAZETTEER_RULES = {
    "geonames_id": "c_custkey",
    "precision": "CASE WHEN c_custkey < 6 THEN 'country' WHEN c_custkey < 30 THEN 'admin1' ELSE 'place' END",
    "name": "CASE WHEN c_custkey < 6 THEN concat('Land ', c_custkey) WHEN c_custkey < 30 THEN concat('Région ', c_custkey) WHEN c_custkey % 3 = 0 THEN concat('São Tomé ', c_custkey % 70) ELSE concat('Port ', c_custkey % 90) END",
    "country_code": "concat('C', c_custkey % 6)",
    "admin1_code": "CASE WHEN c_custkey < 6 THEN NULL ELSE concat('A', c_custkey % 4) END",
    "admin2_code": "CASE WHEN c_custkey < 30 THEN NULL ELSE concat('B', c_custkey % 5) END",
    "other_name": "CASE WHEN c_custkey >= 30 THEN concat('harbour ', c_custkey % 200) ELSE '' END",
    "latitude": "CAST((c_custkey * 7) % 160 - 80 AS DOUBLE)",
    "longitude": "CAST((c_custkey * 11) % 340 - 170 AS DOUBLE)",
}
GAZETTEER_SQL = "gazetteer AS (SELECT *, lower(name) AS normalized_name, strip_accents(lower(name)) AS ascii_name FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in GAZETTEER_RULES.items()) + " FROM customer))"
#: Places that the documents name.
MENTION_RULES = {
    "signal_id": "doc_id",
    "country_name": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('LAND  ', doc_id % 7) ELSE concat('Land ', doc_id % 6) END",
    "admin1_name": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('Region ', 6 + doc_id % 24) WHEN 2 THEN concat('RÉGION ', 6 + doc_id % 24) ELSE 'Nowhere' END",
    "place_name": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('sao tome ', doc_id % 70) WHEN 2 THEN concat('SÃO TOMÉ ', doc_id % 70) WHEN 3 THEN concat('Harbour ', doc_id % 250) ELSE concat('Port ', doc_id % 100) END",
}
MENTIONS_SQL = "mentions AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in MENTION_RULES.items()) + " FROM documents)"
SIGNALS_SQL = "signals AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SIGNAL_RULES.items()) + " FROM documents)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(*[F.expr(v).alias(k) for k, v in SIGNAL_RULES.items()])
    return df.withColumns({"first_seen_at": F.timestamp_seconds("first_seen_s"), "published_at": F.timestamp_seconds("published_s"), "latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double"), "confidence": F.col("confidence").cast("double")})


def now() -> F.Column:
    return F.timestamp_seconds(F.lit(NOW))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("source").agg(F.first("is_official").alias("is_official"), F.first("credibility").alias("credibility"))


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("*", *[F.expr(v).alias(k) for k, v in QUEUE_RULES.items()])


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = queued(spark, sf_dir).groupBy("group_id").agg(F.min("first_seen_s").alias("opened_s"))
    return g.withColumn("state", F.when(F.col("group_id") % 4 == 0, "resolved").otherwise("open")).withColumn("opened_at", F.timestamp_seconds("opened_s"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").select(*[F.expr(v).alias(k) for k, v in GAZETTEER_RULES.items()])
    return g.withColumns({"normalized_name": X.place_form(F.col("name")), "ascii_name": X.ascii_form(F.col("name")), "alternate_names": P.alternates(F.array("other_name", "name"), F.col("name"))})


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*[F.expr(v).alias(k) for k, v in MENTION_RULES.items()])


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"land {k}", f"C{k}") for k in range(6)], "alias string, country_code string")
