"""The first stages as set operations: gates, duplicates, stories, scores, places, summaries.

Every function takes and returns DataFrames; `now` is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T
from harrier.operators.graph import flatten_pointers, step_table
from harrier.operators.rangejoin import band_join

#: Weights of the scores.
EARLY_WEIGHTS = {"recency": 0.25, "velocity": 0.20, "sources": 0.25, "spread": 0.15, "precision": 0.15}
EVIDENCE_WEIGHTS = {"official": 0.30, "credibility": 0.25, "observations": 0.20, "consistency": 0.15, "confidence": 0.10}


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(df: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return df.join(stored.select(*on).distinct(), on, "left_anti")


# --- gates -----------------------------------------------------------------------------------------------------------


def blocked_domain(domain: Column, blocked: list[str]) -> Column:
    d = F.lower(domain)
    return reduce(lambda a, b: a | b, [(d == x.lower()) | F.endswith(d, F.lit("." + x.lower())) for x in blocked], F.lit(False))


def first_rule(df: DataFrame, column: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The name of the first rule (name, kind, pattern), in order, that a text meets: kind regex or substring."""
    hits = [F.when(column.rlike("(?i)" + p) if kind == "regex" else F.contains(X.collapse(X.fold(column)), F.lit(p.lower())), F.lit(n)) for n, kind, p in rules]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def gate(df: DataFrame, domain: str, title: str, blocked: list[str], excluded: list[str], included: list[str]) -> DataFrame:
    """verdict: blocked_domain, excluded_title, no_keyword or pass; the domain comes before the title, and an empty list
    of keywords lets every title through."""
    t = X.collapse(X.fold(F.col(title)))
    ex = reduce(lambda a, b: a | b, [F.col(title).rlike("(?i)" + p) for p in excluded], F.lit(False))
    inc = reduce(lambda a, b: a | b, [F.contains(t, F.lit(k.lower())) for k in included]) if included else F.lit(True)
    return df.withColumn("verdict", F.when(blocked_domain(F.col(domain), blocked), "blocked_domain").when(ex, "excluded_title").when(~inc, "no_keyword").otherwise("pass"))


def discover(sightings: DataFrame, stored: DataFrame, blocked: list[str], excluded: list[str], cap: int) -> DataFrame:
    """Sightings (canonical_url, domain, title, seen_at, pos): first of each URL, not stored yet, past the gate; the
    oldest `cap` are stored, the rest deferred."""
    fresh = unseen(first_wins(sightings, ["canonical_url"], [F.col("pos")]), stored, ["canonical_url"])
    judged = gate(fresh, "domain", "title", blocked, excluded, [])
    passed = judged.where("verdict = 'pass'")
    oldest = passed.orderBy("seen_at", "canonical_url").limit(cap).select("canonical_url", F.lit(True).alias("_in"))
    return judged.join(oldest, "canonical_url", "left").withColumn("route", F.when(F.col("verdict") != "pass", "rejected").when(F.col("_in"), "stored").otherwise("deferred")).drop("_in")


# --- duplicates ------------------------------------------------------------------------------------------------------


def precedence() -> Column:
    """The order in which signals come before their duplicates: first seen, published with nulls last, id."""
    return F.struct("first_seen_at", F.col("published_at").isNull().alias("_undated"), "published_at", "signal_id")


def _alike_titles(s: DataFrame, width: float, least: float) -> DataFrame:
    """Pairs (signal_id < o_signal_id) of (signal_id, tokens, t) whose token sets are alike. They meet in a band of time by
    a token of a prefix that alike sets must share, the rarest tokens first."""
    tokens = s.select("signal_id", "t", F.size("tokens").alias("n"), F.explode("tokens").alias("k"))
    rare = tokens.groupBy("k").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("signal_id").orderBy("df", "k"))
    prefix = tokens.join(rare, "k").withColumn("_r", rank).where(F.col("_r") <= F.floor(F.col("n") * (1 - least) + 1e-9) + 1).select("k", "signal_id", "t", "n")
    other = prefix.select("k", F.col("signal_id").alias("o_signal_id"), F.col("t").alias("o_t"), F.col("n").alias("o_n"))
    fits = f"signal_id < o_signal_id AND least(n, o_n) >= {least} * greatest(n, o_n) - 1e-9"
    met = band_join(prefix, other, "t", "o_t", width, ["k"]).where(fits).select("signal_id", "o_signal_id").distinct()
    sets = s.select("signal_id", "tokens")
    both = met.join(sets, "signal_id").join(sets.select(F.col("signal_id").alias("o_signal_id"), F.col("tokens").alias("o_tokens")), "o_signal_id")
    return both.where(X.jaccard(F.col("tokens"), F.col("o_tokens")) >= least).select("signal_id", "o_signal_id")


def duplicate_pairs(signals: DataFrame, hours: int = 72, title_at_least: float = 0.9, body_at_least: float = 0.8, near_exact: bool = True) -> DataFrame:
    """(signal_id, other_id), in both directions, where other is the same by hash at any age, or within hours by a
    near-exact title (see near_exact_pairs; needs title and published_at) or by title tokens and body shingles.

    Of the signals of one hash, each is paired with the one that precedes all others, not with every other: that is the
    one that they are copies of. Bodies are only read for signals with an alike title, and cut into shingles once."""
    spark = signals.sparkSession
    s = step_table(spark, signals.select("signal_id", "content_hash", "tokens", "first_seen_at", "published_at", T.seconds(F.col("first_seen_at")).alias("t")), "signals")
    first = s.groupBy("content_hash").agg(F.min(precedence()).alias("f"), F.count("*").alias("n")).where("n > 1").select("content_hash", F.col("f.signal_id").alias("other_id"))
    exact = s.join(first, "content_hash").where("signal_id <> other_id").select("signal_id", F.col("other_id").alias("o_signal_id"))
    alike = step_table(spark, _alike_titles(s.where("size(tokens) > 0").select("signal_id", "tokens", "t"), hours * 3600.0, title_at_least), "alike")
    wanted = alike.selectExpr("explode(array(signal_id, o_signal_id)) AS signal_id").distinct()
    bodies = step_table(spark, signals.select("signal_id", "raw_text").join(wanted, "signal_id", "left_semi").select("signal_id", X.shingle_hashes(F.col("raw_text")).alias("grams")), "grams")
    both = alike.join(bodies, "signal_id").join(bodies.select(F.col("signal_id").alias("o_signal_id"), F.col("grams").alias("o_grams")), "o_signal_id")
    near = both.where(X.jaccard(F.col("grams"), F.col("o_grams")) >= body_at_least).select("signal_id", "o_signal_id")
    if near_exact:
        t = s.select("signal_id", "t")
        met = near_exact_pairs(signals).join(t, "signal_id").join(t.select(F.col("signal_id").alias("o_signal_id"), F.col("t").alias("o_t")), "o_signal_id")
        near = near.unionByName(met.where(F.abs(F.col("t") - F.col("o_t")) <= hours * 3600.0).select("signal_id", "o_signal_id"))
    pairs = near.unionByName(exact)
    turned = F.explode(F.array(F.struct("signal_id", F.col("o_signal_id").alias("other_id")), F.struct(F.col("o_signal_id").alias("signal_id"), F.col("signal_id").alias("other_id"))))
    return pairs.select(turned.alias("e")).select("e.*").distinct()


def near_exact_titles(titles: DataFrame, least: float = 92.0, hours: int = 48) -> DataFrame:
    """(title, o_title, span) of different titles (title, t: seconds) that are alike by insertions and deletions, once each
    two, for each span of `hours` in which title stands and o_title does, or in the one before or after. However many
    signals have a title, it is compared once.

    Nothing is lost before the ratio decides. Titles of one span and the two next to it meet by their length, which can
    differ by a fixed factor only, and leave if the counts of their characters, by 32 classes, differ by more than the
    distance allowed; two that meet in several spans are compared once."""
    spark, width = titles.sparkSession, hours * 3600.0
    span = F.floor(F.col("t") / width).cast("long")
    standing = step_table(spark, titles.select("title", span.alias("span"), F.md5("title").alias("id")).distinct(), "standing")
    texts = standing.select("id", "title").distinct()
    band = F.floor(F.log(F.length("title")) / F.log(F.lit((200 - least) / least * 1.001))).cast("int")
    kinds = step_table(spark, texts.select("id", F.length("title").alias("n"), band.alias("k"), X.character_counts(F.col("title")).alias("counts")), "kinds")
    s = standing.select("id", "span").join(kinds, "id")
    cells = F.explode(F.array(*[F.struct((F.col("k") + i).alias("k"), (F.col("span") + j).alias("span")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = s.select(F.col("id").alias("o_id"), F.col("n").alias("o_n"), F.col("counts").alias("o_counts"), cells.alias("at")).select("o_id", "o_n", "o_counts", "at.k", "at.span")
    apart = F.aggregate(F.zip_with("counts", "o_counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    fits = (F.col("id") < F.col("o_id")) & (200.0 * F.least("n", "o_n") / (F.col("n") + F.col("o_n")) >= least) & (apart <= (F.col("n") + F.col("o_n")) * (1 - least / 100) + 1e-6)
    met = step_table(spark, s.join(o, ["k", "span"]).where(fits).select("id", "o_id", "span").distinct(), "met")
    both = met.select("id", "o_id").distinct().join(texts, "id").join(texts.select(F.col("id").alias("o_id"), F.col("title").alias("o_title")), "o_id")
    ratio = X.indel_ratio(F.col("title"), F.col("o_title"))
    return both.where((ratio >= least) & (ratio < 100)).join(met, ["id", "o_id"]).select("title", "o_title", "span")


def near_exact_pairs(signals: DataFrame, least: float = 92.0, hours: int = 48) -> DataFrame:
    """(signal_id, o_signal_id), the lesser id first, of signals (signal_id, title, published_at) whose titles are alike by
    insertions and deletions but not equal, published within hours: the alike titles, and then their signals."""
    s = signals.where("published_at IS NOT NULL AND length(title) > 0").select("signal_id", "title", T.seconds(F.col("published_at")).alias("t"))
    alike = step_table(signals.sparkSession, near_exact_titles(s, least, hours), "alike")
    # A signal meets the titles that stand near its time only.
    one = s.withColumn("span", F.floor(F.col("t") / (hours * 3600.0)).cast("long")).join(alike, ["title", "span"]).select("o_title", "signal_id", "t")
    other = s.join(alike.select("o_title").distinct(), F.col("title") == F.col("o_title"), "left_semi").select(F.col("title").alias("o_title"), F.col("signal_id").alias("other_id"), F.col("t").alias("o_t"))
    near = band_join(one, other, "t", "o_t", hours * 3600.0, ["o_title"])
    return near.select(F.least("signal_id", "other_id").alias("signal_id"), F.greatest("signal_id", "other_id").alias("o_signal_id"))


def resolve_duplicates(spark: SparkSession, signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(signal_id, primary_id): each signal's earliest match that precedes it (first seen, published with nulls last, id),
    followed to the root; a signal without one is its own primary."""
    ranked = signals.select("signal_id", precedence().alias("rank"))
    met = pairs.join(ranked, "signal_id").join(ranked.select(F.col("signal_id").alias("other_id"), F.col("rank").alias("o_rank")), "other_id")
    parent = met.where("o_rank < rank").groupBy("signal_id").agg(F.min_by("other_id", "o_rank").alias("parent"))
    roots = flatten_pointers(spark, ranked.select("signal_id").join(parent, "signal_id", "left"), "signal_id", "parent")
    return roots.select(F.col("node").alias("signal_id"), F.col("root").alias("primary_id"))


# --- stories ---------------------------------------------------------------------------------------------------------


def sessions(rows: DataFrame, keys: list[str], time: str, order: list[str], gap_seconds: float) -> DataFrame:
    """Adds session (from 1, per key): a gap of more than gap_seconds opens the next."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    new = F.coalesce((F.unix_micros(time) - F.unix_micros(F.lag(time).over(w)) > gap_seconds * 1e6).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def representative_order() -> Column:
    """The best first: official, credible, seen early, least id."""
    rank = T.lookup(F.col("credibility"), T.CREDIBILITY_RANK, 0)
    return F.struct((~F.col("is_official")).cast("int").alias("a"), (-rank).alias("b"), F.col("first_seen_at").alias("c"), F.col("signal_id").alias("d"))


def story_chains(signals: DataFrame, window_days: int = 1) -> DataFrame:
    """Adds chain (from 1, per rule group and country): a gap of more than window_days whole days opens the next. Null
    keys form one group. Adds is_representative: official, credible, early, least id.

    Times are cut into spans of window_days + 1 days. Within one, no gap is long enough, so chains break between spans
    only: the window runs over a key's spans, whose number time bounds, not over its signals."""
    if not 1 <= window_days <= 2:
        raise ValueError("window_days is 1 or 2")
    day, keys = 86_400_000_000, ["rule_group", "country", "_span"]
    s = signals.withColumn("_span", F.floor(F.unix_micros("first_seen_at") / ((window_days + 1) * day)))
    spans = s.groupBy(*keys).agg(F.min("first_seen_at").alias("_from"), F.max("first_seen_at").alias("_to"))
    along = Window.partitionBy("rule_group", "country").orderBy("_span")
    new = F.coalesce((T.whole_days(F.col("_from"), F.lag("_to").over(along)) > window_days).cast("int"), F.lit(1))
    spans = spans.withColumn("_new", new).withColumn("chain", F.sum("_new").over(along))
    same = lambda names: reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names])
    chained = s.alias("s").join(spans.alias("o"), same(keys)).select(*[f"s.{c}" for c in signals.columns], "o.chain")
    chain = ["rule_group", "country", "chain"]
    best = chained.groupBy(*chain).agg(F.min(representative_order()).alias("b")).select(*chain, F.col("b.d").alias("_best"))
    return chained.alias("s").join(best.alias("o"), same(chain)).select(*[f"s.{c}" for c in signals.columns], "s.chain", (F.col("s.signal_id") == F.col("o._best")).alias("is_representative"))


# --- scores ----------------------------------------------------------------------------------------------------------


def early_signal_scores(signals: DataFrame, now: Column, key: str = "event_key") -> DataFrame:
    """Five components and their weighted sum per event; signals carry a location each."""
    at = F.coalesce("published_at", "first_seen_at")
    place = F.when(F.col("country").isNotNull(), F.struct("country", "admin1"))
    g = signals.groupBy(key).agg(
        F.max(at).alias("_last"), F.min(at).alias("_first"), F.count("*").alias("n_signals"), F.countDistinct("source").alias("_sources"),
        F.size(F.collect_set(place)).alias("_places"), F.avg(T.lookup(F.col("precision"), T.PRECISION_WEIGHT, 0.0)).alias("precision_score"),
    )
    span = F.greatest(F.lit(1.0), T.gap_days(F.col("_last"), F.col("_first")))
    g = g.withColumns({
        "recency": F.exp(-F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("_last")) / 86_400e6) / 14),
        "velocity": T.saturate(F.col("n_signals") / span, 4), "sources": T.saturate(F.col("_sources"), 3), "spread": T.saturate(F.col("_places"), 2),
    })
    total = sum(F.col("precision_score" if k == "precision" else k) * v for k, v in EARLY_WEIGHTS.items())
    return g.withColumn("early_signal_score", T.clamp(total)).drop("_last", "_first", "_sources", "_places")


def evidence_scores(signals: DataFrame, key: str = "event_key") -> DataFrame:
    """Official, credibility, observations, consistency of successive totals, confidence; and the verification status."""
    at = F.coalesce("published_at", "first_seen_at")
    counted = signals.where("total_cases IS NOT NULL").withColumn("_prev", F.lag("total_cases").over(Window.partitionBy(key).orderBy(at, "signal_id")))
    drops = counted.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_prev") > 0, F.greatest(F.lit(0.0), (F.col("_prev") - F.col("total_cases")) / F.col("_prev")))).alias("_drop"))
    g = signals.groupBy(key).agg(F.max(F.col("is_official").cast("int")).alias("_official"), F.max(T.lookup(F.col("credibility"), T.CREDIBILITY, 0.0)).alias("credibility_score"), F.avg("confidence").alias("_conf"), F.max((F.col("credibility") == "high").cast("int")).alias("_high"))
    g = g.join(drops, key, "left").withColumns({"_n": F.coalesce("_n", F.lit(0))})
    g = g.withColumns({
        "observations": T.saturate(F.col("_n"), 3),
        "consistency": F.when(F.col("_n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("_drop", F.lit(0.0)) / (F.col("_n") - 1))),
        "confidence_score": F.coalesce("_conf", F.lit(0.5)),
        "verification": F.when(F.col("_official") == 1, "officially_confirmed").when(F.col("_high") == 1, "high_credibility").otherwise("signal"),
    })
    parts = {"official": F.col("_official"), "credibility": F.col("credibility_score"), "observations": F.col("observations"), "consistency": F.col("consistency"), "confidence": F.col("confidence_score")}
    return g.withColumn("evidence_score", T.clamp(sum(parts[k] * v for k, v in EVIDENCE_WEIGHTS.items()))).drop("_official", "_conf", "_high", "_n", "_drop")


# --- places ----------------------------------------------------------------------------------------------------------


def centroids(places: DataFrame) -> DataFrame:
    """Mean positions of countries, first and second level units; units without places have none."""
    sets = places.groupingSets([[F.col("country")], [F.col("country"), F.col("admin1")], [F.col("country"), F.col("admin1"), F.col("admin2")]], "country", "admin1", "admin2")
    g = sets.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("n_places"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "country").when(F.col("_g") == 1, "admin1").otherwise("admin2")
    return g.withColumn("level", level).where("level = 'country' OR (level = 'admin1' AND admin1 IS NOT NULL) OR (admin1 IS NOT NULL AND admin2 IS NOT NULL)").drop("_g")


# --- summaries, model checks ------------------------------------------------------------------------------------------


def pick_sources(articles: DataFrame, k: int, key: str = "event_key") -> DataFrame:
    """k representative articles per event by official, newest, brief, title, id; if the newest one with a brief is not
    among them, it takes the last slot."""
    at = F.coalesce("published_at", "first_seen_at")
    order = [F.desc("is_official"), F.desc(at), F.desc("n_brief"), F.asc("title"), F.asc("signal_id")]
    r = articles.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    r = r.withColumn("newest", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.col("n_brief") > 0), F.desc(at), "signal_id")) == 1)
    forced = F.max(F.when(F.col("newest") & (F.col("n_brief") > 0), F.col("slot"))).over(Window.partitionBy(key))
    r = r.withColumn("_f", forced)
    return r.where((F.col("slot") <= F.when(F.col("_f") > k, k - 1).otherwise(k)) | (F.col("slot") == F.col("_f"))).drop("_f", "newest")


def should_resummarize(last: Column, latest: Column, same_counts: Column, new_articles: Column, now: Column, hours: int = 24, articles: int = 3) -> Column:
    return last.isNull() | (latest.isNotNull() & ~same_counts) | (new_articles >= articles) | (F.unix_micros(now) - F.unix_micros(last) > hours * 3_600_000_000)


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, tn, fn, accuracy and recall of 0/1 columns; a rate over nothing is 0."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    g = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return g.withColumns({"accuracy": F.when(n == 0, 0.0).otherwise((F.col("tp") + F.col("tn")) / n), "recall": F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))})
