"""URL filters: dated list entries as validity intervals, and an as-of join with captures.

A list is a log of entries (pattern, listed_at, action add or remove, verdict block or allow). A pattern is `d:` and a
domain, which covers its subdomains, or `p:` and a host with a path, which covers what is below it. Each entry holds from
its time until the pattern's next entry; a capture is judged by the entries that hold when it was fetched, the most
specific one first. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A list of at most so many intervals is broadcast (some 20 MB); a longer one is joined in SALTS copies.
BROADCAST_ROWS = 200_000
SALTS = 16
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: F.Column, depth: int) -> F.Column:
    """All patterns that can cover a URL: its host's suffixes of two labels or more (an address has itself alone), and its
    path's prefixes of at most depth steps, which is as deep as any listed path is."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(labels)
    most = F.when(host.rlike(r"^[0-9.]+$|^\["), 1).otherwise(F.greatest(F.lit(1), n - 1))
    domains = F.transform(F.sequence(F.lit(1), most), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.slice(F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != ""), 1, max(1, depth))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(host != "", F.concat(domains, F.coalesce(paths, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, since, until): when each pattern was listed. Of entries of a pattern at one time, a removal
    counts first, then the greatest verdict. Entries without pattern, time, action or verdict are left out."""
    known = entries.select(F.col("pattern").cast("string").alias("pattern"), F.col("listed_at").cast("timestamp").alias("since"), F.lower("action").alias("action"), F.lower("verdict").alias("verdict"))
    known = known.where("pattern IS NOT NULL AND since IS NOT NULL AND action IN ('add', 'remove') AND (verdict IN ('block', 'allow') OR action = 'remove')")
    single = known.groupBy("pattern", "since").agg(F.max(F.struct("action", "verdict")).alias("e"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since")).alias("until")
    return single.select("pattern", "since", "e.action", "e.verdict", until).where("action = 'add'").drop("action")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per capture: id, url, fetched_at, host, verdict (block, allow or none), pattern and listed_at of the deciding
    entry, and n_active, the number of entries that hold for it.

    The longest path pattern decides, then the longest domain. A capture with a null or unreadable URL or without time
    has no entries. The host of an address is the address (IPv6 in brackets), with no suffixes. Rows equal in id, URL and
    time are one capture; patterns of one length and kind come in the order of their text, the last first. URLs of any
    length are read whole. Other columns are ignored; an empty table gives an empty result, an empty list judges nothing.
    """
    held = intervals(entries)
    size = held.agg(F.count("*").alias("n"), F.max(F.size(F.split("pattern", "/"))).alias("steps")).first()
    small = size.n <= broadcast_rows
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("at"))
    keyed = rows.select("*", F.explode_outer(patterns_of(F.col("url"), (size.steps or 1) - 1)).alias("pattern"))
    on = "c.pattern = i.pattern AND c.at >= i.since AND (i.until IS NULL OR c.at < i.until)"
    if small:
        met = keyed.alias("c").join(F.broadcast(held).alias("i"), F.expr(on), "left")
    else:
        # A host of a third of all captures is dealt over SALTS tasks; every interval is in each.
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url", "at"), F.lit(SALTS)).cast("int"))
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.alias("c").join(held.alias("i"), F.expr(f"{on} AND c.salt = i.salt"), "left")
    rank = F.struct(F.substring("i.pattern", 1, 1).alias("kind"), F.length("i.pattern").alias("size"), F.col("i.pattern").alias("pattern"), F.col("i.verdict").alias("verdict"), F.col("i.since").alias("since"))
    best = met.groupBy("c.id", "c.url", "c.at").agg(F.max(F.when(F.col("i.pattern").isNotNull(), rank)).alias("b"), F.countDistinct("i.pattern").alias("n_active"))
    return best.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce("b.verdict", F.lit("none")).alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.since").alias("listed_at"), "n_active",
    )


def _digits(text: F.Column, first: int) -> F.Column:
    """Six hexadecimal digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(text), first, 6), 16, 10).cast("int")


def _day(days: F.Column) -> F.Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).cast("timestamp")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list for the synthetic pages, which come without one: each host is listed, most are taken off and listed
    again; each site's domain is allowed from some day; a fifth of the first path steps are listed."""
    url = F.col("url")
    hosts = pages.select(host_of(url).alias("h"), F.element_at(F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != ""), 1).alias("step")).where("h <> ''").distinct()
    first, second = _digits(F.col("h"), 1) % 300, _digits(F.col("h"), 7) % 60 + 20
    log = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.when(_digits(F.col("h"), 13) % 3 != 0, F.struct(F.lit("remove").alias("action"), (first + second).alias("day"))),
        F.when(_digits(F.col("h"), 13) % 3 == 1, F.struct(F.lit("add").alias("action"), (first + second + 45).alias("day"))),
    )
    one = hosts.select("h").distinct().select("h", F.explode(log).alias("e")).where("e IS NOT NULL").select(F.concat(F.lit("d:"), "h").alias("pattern"), "e.action", F.lit("block").alias("verdict"), _day(F.col("e.day")).alias("listed_at"))
    site = F.substring_index("h", ".", -2)
    two = hosts.select(site.alias("s")).distinct().select(F.concat(F.lit("d:"), "s").alias("pattern"), F.lit("add").alias("action"), F.lit("allow").alias("verdict"), _day(_digits(F.col("s"), 1) % 200).alias("listed_at"))
    below = F.concat("h", F.lit("/"), "step")
    three = hosts.where("step IS NOT NULL").where(_digits(below, 1) % 5 == 0).select(F.concat(F.lit("p:"), below).alias("pattern"), F.lit("add").alias("action"), F.lit("block").alias("verdict"), _day(_digits(below, 7) % 365).alias("listed_at"))
    return one.unionByName(two).unionByName(three)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(F.pmod(F.col("page_id"), F.lit(365))))
    return judge_captures(captures, sample_list(pages))


_SQL_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1))"
_SQL_STEPS = "list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '')"
ORACLE = f"""
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 365 AS INTEGER)) AS ft, {_SQL_HOST} AS h, {_SQL_STEPS} AS steps FROM pages),
hosts AS (SELECT DISTINCT h, CASE WHEN len(steps) > 0 THEN steps[1] END AS step FROM p WHERE h <> ''),
n AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 6) AS INTEGER) % 300 AS a, CAST('0x' || substr(md5(h), 7, 6) AS INTEGER) % 60 + 20 AS b, CAST('0x' || substr(md5(h), 13, 6) AS INTEGER) % 3 AS c FROM hosts),
sites AS (SELECT DISTINCT array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS s FROM hosts),
log AS (
  SELECT 'd:' || h AS pattern, 'add' AS action, 'block' AS verdict, a AS day FROM n
  UNION ALL SELECT 'd:' || h, 'remove', 'block', a + b FROM n WHERE c <> 0
  UNION ALL SELECT 'd:' || h, 'add', 'block', a + b + 45 FROM n WHERE c = 1
  UNION ALL SELECT 'd:' || s, 'add', 'allow', CAST('0x' || substr(md5(s), 1, 6) AS INTEGER) % 200 FROM sites
  UNION ALL SELECT 'p:' || h || '/' || step, 'add', 'block', CAST('0x' || substr(md5(h || '/' || step), 7, 6) AS INTEGER) % 365 FROM hosts WHERE step IS NOT NULL AND CAST('0x' || substr(md5(h || '/' || step), 1, 6) AS INTEGER) % 5 = 0
),
single AS (SELECT pattern, TIMESTAMP '2024-01-01' + to_days(day) AS since, max(action) AS action, arg_max(verdict, (action, verdict)) AS verdict FROM log GROUP BY ALL),
held AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM single),
keyed AS (
  SELECT page_id, url, ft, unnest(list_concat(
    [CASE WHEN i > 0 THEN 'd:' || array_to_string(list_slice(string_split(h, '.'), i, 99), '.') END FOR i IN range(1, greatest(2, len(string_split(h, '.'))))],
    ['p:' || h || '/' || array_to_string(list_slice(steps, 1, i), '/') FOR i IN range(1, len(steps) + 1)])) AS pattern
  FROM (SELECT DISTINCT page_id, url, ft, h, steps FROM p) WHERE h <> ''
),
met AS (SELECT k.page_id, k.url, k.ft, i.pattern, i.verdict, i.since FROM keyed k JOIN held i ON k.pattern = i.pattern AND i.action = 'add' AND k.ft >= i.since AND (i.until IS NULL OR k.ft < i.until)),
best AS (SELECT page_id, url, ft, arg_max((pattern, verdict, since), (substr(pattern, 1, 1), length(pattern), pattern)) AS b, count(DISTINCT pattern) AS n_active FROM met GROUP BY ALL)
SELECT DISTINCT p.page_id, p.url, p.ft AS fetched_at, p.h AS host, coalesce(b[2], 'none') AS verdict, b[1] AS pattern, b[3] AS listed_at, coalesce(n_active, 0) AS n_active
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.url = best.url AND p.ft = best.ft
"""
