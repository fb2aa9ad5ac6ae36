"""Landed inputs as DataFrames: API pages, feeds, sightings, seeds, gazetteer dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import html as H
from harrier.functions import text as X
from harrier.functions import timegeo as T

#: The columns of a place-name dump by position.
PLACE_COLUMNS = {"geonames_id": 0, "name": 1, "alternates": 3, "latitude": 4, "longitude": 5, "feature": 7, "country": 8, "admin1": 10, "admin2": 11, "population": 14}


def outbreak_bulletins(spark: SparkSession, path: str, since: str, inclusive: bool = False) -> DataFrame:
    """Landed pages of an OData news API: value rows published or modified after since, least recently modified first;
    five HTML sections joined by blank lines. Rows without name or publication date carry an error."""
    parts = ["Overview", "Epidemiology", "Assessment", "Advice", "Response"]
    schema = "value array<struct<" + ",".join(f"{c}:string" for c in ["Id", "DonId", "UrlName", "Title", "PublicationDate", "PublicationDateAndTime", "LastModified", *parts]) + ">>"
    v = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")
    after = (lambda c: T.iso_time(F.col(c)) >= F.lit(since).cast("timestamp")) if inclusive else (lambda c: T.iso_time(F.col(c)) > F.lit(since).cast("timestamp"))
    body = F.array_join(F.filter(F.array(*[H.strip_html(F.col(p)) for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n\n")
    error = F.when(F.col("UrlName").isNull(), "UrlName").when(F.col("PublicationDate").isNull(), "PublicationDate")
    return v.where(after("PublicationDateAndTime") | after("LastModified")).select("Id", H.strip_html(F.col("Title")).alias("title"), body.alias("raw_text"), "UrlName", T.iso_time(F.col("PublicationDate")).alias("published_at"), T.iso_time(F.col("LastModified")).alias("modified_at"), error.alias("error")).orderBy("modified_at")


def feed_items(spark: SparkSession, path: str, since: str) -> DataFrame:
    """RSS items after since, title and link and time."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return items.withColumn("published_at", T.feed_time(F.col("pubDate"))).where(F.col("published_at") > F.lit(since).cast("timestamp"))


def with_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the page behind their link: its own canonical link and date come before the feed's."""
    body = H.strip_html_within("div", "wysiwyg-content")(F.col("html"))
    canonical = F.regexp_extract("html", r'<link[^>]*rel="canonical"[^>]*href="([^"]+)"', 1)
    meta = F.regexp_extract("html", r'<meta[^>]*property="article:published_time"[^>]*content="([^"]+)"', 1)
    j = items.join(pages.select(F.col("url").alias("link"), "html"), "link", "left")
    return j.select("title", X.canonical_url(F.when(canonical != "", canonical).otherwise(F.col("link"))).alias("canonical_url"), F.coalesce(T.iso_time(F.when(meta != "", meta)), "published_at").alias("published_at"), body.alias("raw_text"), F.when(F.coalesce(body, F.lit("")) == "", "unsupported").alias("error"))


def news_sightings(spark: SparkSession, path: str, languages: dict[str, str], wanted: str | None = None) -> DataFrame:
    """Articles of landed search responses; partial entries and unmapped or other languages are dropped."""
    a = spark.read.schema("articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>").option("multiLine", True).json(path)
    a = a.select(F.explode("articles").alias("a")).select("a.*").withColumn("seen_at", T.seen_time(F.col("seendate")))
    whole = (F.trim("url") != "") & (F.trim("title") != "") & (F.trim("domain") != "") & F.col("seen_at").isNotNull()
    a = a.where(whole).withColumn("code", T.lookup(F.lower("language"), {k.lower(): v for k, v in languages.items()}))
    return a.where(F.col("code").isNotNull() if wanted is None else F.col("code") == wanted).withColumn("canonical_url", X.canonical_url(F.col("url")))


def seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def gazetteer(spark: SparkSession, path: str, schema: str, array_columns: tuple[str, ...] = ("alternate_names",)) -> DataFrame:
    """A (gzip) TSV artifact with header: empty is null, arrays are comma lists without empty names."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="", quote="")
    return df.withColumns({c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "") for c in array_columns})


def place_dump(spark: SparkSession, path: str) -> DataFrame:
    """A place-name dump: tab separated, # comments, columns by position."""
    t = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("v"))
    cols = {n: F.nullif(F.get("v", F.lit(i)), F.lit("")) for n, i in PLACE_COLUMNS.items()}
    kinds = {"geonames_id": "long", "latitude": "double", "longitude": "double", "population": "long"}
    return t.select(*[c.cast(kinds.get(n, "string")).alias(n) for n, c in cols.items()])
