"""Operators on small inputs with results worked out by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from harrier.functions import html as H
from harrier.functions import text as X
from harrier.functions import timegeo as T
from harrier.operators import events as E
from harrier.operators import extraction as N
from harrier.operators import places as P
from harrier.operators import surveillance as S
from harrier.operators.graph import components, flatten_pointers
from harrier.operators.rangejoin import band_join
from harrier.plans import read_models as R
from harrier.sources import readers, sinks as K

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_text(spark):
    L = F.lit
    r = one(
        spark, X.canonical_url(L(" HTTPS://Ex.COM/A/b/?utm_source=x&b=2&a=&gclid=1#f ")), X.masthead_title(L("Cholera: in  Kano - The Daily News")), X.title_tokens(L("Big Straße fire — The Post")),
        F.size(X.shingles(L("a b c d e f"))), X.shingles(L("a b")), X.truncate_words(L("alpha beta gamma"), 11), X.truncate_words(L("alphabeta"), 4), X.ascii_form(L("São-Tomé (city)")), X.country_code(L(" ng ")), X.country_code(L("unknown")),
        X.private_text(L("call +234 803 555 1234")), X.private_text(L("14 deaths")), X.disease_identity(L(None).cast("string"), L("  GRIPPE x ")), X.content_hash(L(" a  b"), L("c")) == X.content_hash(L("a b"), L("c ")), X.hash_holds(L("a"), L(None).cast("string"), L("")),
    )
    urls = {"http://H/?a-b=1&a=1": "http://h/?a=1&a-b=1", "http://h/p//?x=%41+b&x=A%20a&k&%zz=1": "http://h/p?%25zz=1&k=&x=A+a&x=A+b", "http://h?UTM_x=1&FbClid=2": "http://h", "http://h/a?q=%C3%A9*~#z": "http://h/a?q=%C3%A9%2A~"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {x.u: x.c for x in df.select("u", X.canonical_url(F.col("u")).alias("c")).collect()} == urls
    assert r[0] == "https://ex.com/A/b?a=&b=2" and r[1] == "cholera in kano" and r[2] == ["big", "fire", "strasse"]
    assert r[3] == 2 and r[4] == ["a b"] and r[5] == "alpha beta" and r[6] == "alph" and r[7] == "sao tome city" and r[8] == "NG" and r[9] is None
    assert r[10] and not r[11] and r[12] == "text:grippe x" and r[13] and r[14] is False


def test_indel_ratio(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 70))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 70)))) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(X.indel_ratio("a", "b")).collect()]
    assert all(abs(g - slow(a, b)) < 1e-9 for g, (a, b) in zip(got, pairs))


def test_times_and_places(spark):
    L = F.lit
    r = one(
        spark, T.stated_offset(L("2026-08-20T13:39:42+0200")), T.stated_offset(L("2026-08-20T13:39:42Z")), T.stated_offset(L("2026-08-20T13:39:42")), F.unix_seconds(T.feed_time(L("Thu, 20 Aug 2026 11:39:42 +0000"))),
        F.unix_seconds(T.seen_time(L("20260820T113942Z"))), T.seen_time(L("nonsense")), F.round(T.haversine_km(L(18.79), L(98.98), L(7.88), L(98.39))), T.geocode_confidence(L("place"), L("ascii")), T.money(L(1500), L(None).cast("int"), L("0.15"), L("0.6")), T.unit(F.array(L(3.0), L(4.0))), T.unit(F.array(L(0.0))),
    )
    assert r[0] == 120 and r[1] == 0 and r[2] is None and r[3] == r[4] and r[5] is None and 1210 < r[6] < 1220 and r[7] == 0.85 and str(r[8]) == "0.000225" and r[9] == [0.6, 0.8] and r[10] == [0.0]


def test_html():
    page = '<html><head><title> T </title><meta property="og:title" content="OG"><meta property="og:site_name" content="S"><script type="application/ld+json">{"a":[{"datePublished":"2026-01-02"}]}</script></head><body><nav><p>skip</p></nav><p>One &amp; two</p><script>x</script><p>three</p></body></html>'
    assert H.page_of(page) == ("OG", "S", dt.datetime(2026, 1, 2, tzinfo=dt.UTC), None, ["2026-01-02"], "One & two three")
    assert H.text_of("<p>a</p><style>z</style><b>b</b>c<br>d") == "a bc d" and H.text_of(None) is None
    page = '<header><meta name="date" content="2001-01-01"><time datetime="2002-01-01"></header><meta itemprop="date" content="2003-01-01"><time datetime="soon"><script type="application/ld+json">{"dateCreated": "2026-08-20T13:39:42+02:00"}</script><meta name="DC.date.issued" content="2027-01-01"><p>a<footer>b</footer>c'
    got = H.page_of(page)
    assert got[2].isoformat() == "2026-08-20T13:39:42+02:00" and got[3] == 120 and got[4] == ["soon", "2026-08-20T13:39:42+02:00", "2027-01-01"] and got[5] == "ac"
    assert H.regions_of('<div class="x y"><div>a</div>b</div><div class="xx">c</div><div class="y">d</div>', "div", "y") == "a b\n\nd"


def test_graphs_and_bands(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (8, 9), (9, 8)], "node long, parent long")
    assert {tuple(r) for r in flatten_pointers(spark, p).collect()} >= {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(spark, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    rnd = random.Random(1)
    a = [("k%d" % rnd.randrange(2), i, rnd.uniform(-50, 50)) for i in range(60)]
    x, y = spark.createDataFrame(a, "k string, i long, t double"), spark.createDataFrame(a, "k string, j long, u double")
    assert sorted((r.i, r.j) for r in band_join(x, y, "t", "u", 7.0, ["k"]).collect()) == sorted((p[1], q[1]) for p in a for q in a if p[0] == q[0] and abs(p[2] - q[2]) <= 7.0)


def signal(i, **k):
    base = dict(signal_id=i, disease_id="d1", disease_text=None, country="TH", admin1="A", admin2=None, precision="place", latitude=18.79, longitude=98.98, published_at=DAY(i), first_seen_at=DAY(i), source=f"s{i}", is_official=False, credibility="medium", total_cases=None, confidence=0.9, rule_group="r", event_key=1)
    return base | k


SCHEMA = "signal_id long, disease_id string, disease_text string, country string, admin1 string, admin2 string, precision string, latitude double, longitude double, published_at timestamp, first_seen_at timestamp, source string, is_official boolean, credibility string, total_cases long, confidence double, rule_group string, event_key long"


def signals(spark, *rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_clusters_of_the_calibration_kind(spark):
    rows = [signal(1), signal(2), signal(3, latitude=18.9), signal(4, latitude=7.88, longitude=98.39, admin1="B"), signal(5, disease_id="d2"), signal(6, disease_id=None), signal(7, country=None), signal(40), signal(8, disease_id=None, disease_text=" Flu "), signal(9, disease_id=None, disease_text="flu", precision="country")]
    got = {r.signal_id: r.cluster_id for r in E.cluster(spark, signals(spark, *rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: None, 7: None, 40: 40, 8: 8, 9: 8}


def test_decisions(spark):
    s = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (2, 10, 0.7), (2, 11, 0.8), (3, 10, 0.57), (4, 10, 0.1)], "c long, event_id long, score double")
    got = {r.c: (r.decision, r.event_id) for r in E.decide(s, "c", 0.6, 0.55).collect()}
    assert got == {1: ("attach", 10), 2: ("refuse", None), 3: ("ambiguous", None), 4: ("create", None)}


def test_scores(spark):
    rows = [signal(1, total_cases=10), signal(2, total_cases=5, is_official=True), signal(3, total_cases=20)]
    e = S.evidence_scores(signals(spark, *rows)).first()
    assert abs(e.consistency - 0.75) < 1e-9 and e.verification == "officially_confirmed" and abs(e.credibility_score - 0.5) < 1e-9
    r = S.early_signal_scores(signals(spark, *rows), F.lit(DAY(3))).first()
    assert r.recency == 1.0 and 0 < r.early_signal_score < 1


def test_clusters_against_all_pairs(spark):
    """Chains, anchors and grid cells give the components of all pairs, on both sides of the date line and at the poles."""
    rnd = random.Random(7)
    rows = []
    for i in range(1, 260):
        lat, lon = rnd.choice([(18.79, 98.98), (0.0, 179.9), (0.0, -179.9), (88.4, 10.0), (60.0, 5.0)])
        rows.append(signal(i, disease_id=rnd.choice(["d1", "d2"]), country=rnd.choice(["TH", "LA", None]), admin1=rnd.choice(["A", "B", None]), admin2=rnd.choice(["x", "y", None]), precision=rnd.choice(["place"] * 8 + ["admin2", "admin2", "admin1", "unresolved"] + ["country"] * (i % 40 == 0)), latitude=lat + rnd.uniform(-0.6, 0.6), longitude=max(-180.0, min(180.0, lon + rnd.uniform(-0.6, 0.6))), published_at=DAY(rnd.uniform(0, 60))))
    df = signals(spark, *rows)
    c = E.clusterable(df).where("clusterable").select("identity", "signal_id", "place", "at")
    o = c.select("identity", F.col("signal_id").alias("o_id"), F.col("place").alias("o_place"), F.col("at").alias("o_at"))
    fits = T.within_days(F.col("at"), F.col("o_at"), 7) & T.spatially_compatible("place", "o_place", 50.0)
    pairs = [tuple(r) for r in c.join(o, "identity").where("signal_id < o_id").where(fits).select("signal_id", "o_id").collect()]
    label = {r.signal_id: r.signal_id for r in c.collect()}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert len(pairs) > 100 and {r.signal_id: r.cluster_id for r in E.cluster(spark, df).where("cluster_id IS NOT NULL").collect()} == label


def test_match_scores(spark):
    """Spans that overlap have no gap, the cluster's own precision counts, and the first reason is named."""
    place = lambda **k: tuple((dict(country="TH", admin1="A", admin2=None, latitude=18.79, longitude=98.98, precision="place") | k).values())
    kind = "struct<country:string,admin1:string,admin2:string,latitude:double,longitude:double,precision:string>"
    p, q = place(), place(precision="country")
    rows = [(1, "d", p, 0, 10, "d", p, 5, 6), (2, "d", q, 0, 1, "d", p, 46, 50), (3, "d", p, 0, 1, "e", p, 0, 1), (4, "d", p, 0, 1, "d", place(admin1="B"), 0, 1), (5, "d", p, 200, 201, "d", p, 0, 1), (6, "d", p, 0, 1, "d", place(latitude=20.0), 0, 1)]
    df = spark.createDataFrame([(i, a, x, DAY(s), DAY(e), b, y, DAY(t), DAY(f)) for i, a, x, s, e, b, y, t, f in rows], f"cluster_id long, identity string, place {kind}, start timestamp, end timestamp, o_identity string, o_place {kind}, o_start timestamp, o_end timestamp")
    got = {r.cluster_id: (round(r.score, 6), r.reason) for r in E.match_scores(df).collect()}
    assert got == {1: (1.0, None), 2: (round(0.3 + 0.35 * 0.25 + 0.2 * 0.5 + 0.15 * 0.25, 6), "score_below_threshold"), 3: (0.0, "disease_mismatch"), 4: (0.0, "conflicting_admin1"), 5: (0.0, "outside_time_window"), 6: (0.0, "too_far")}
    lifted = {r.cluster_id: r.score for r in E.match_scores(df, similarity=F.lit(0.8)).collect()}
    assert abs(lifted[2] - got[2][0] - 0.12) < 1e-6 and lifted[1] == 1.0 and lifted[3] == 0.0


def test_geocoding_never_guesses(spark):
    row = lambda i, name, precision, country, a1, lat, other=(): (i, name, precision, name.lower(), {"São Tomé": "sao tome"}.get(name, name.lower()), list(other), country, a1, None, lat, lat)
    rows = [row(1, "Springfield", "place", "US", "IL", 1.0, ["x"]), row(2, "Springfield", "place", "US", "MA", 3.0), row(3, "São Tomé", "place", "ST", "S", 5.0, ["st tome"]), row(4, "Illinois", "admin1", "US", "IL", 9.0), row(5, "America", "country", "US", None, 8.0)]
    g = spark.createDataFrame(rows, "geonames_id long, name string, precision string, normalized_name string, ascii_name string, alternate_names array<string>, country_code string, admin1_code string, admin2_code string, latitude double, longitude double")
    aliases = spark.createDataFrame([("usa", "US"), ("são tomé", "ST"), ("atlantis", "XX")], "alias string, country_code string")
    asked = [(1, "USA", None, "springfield"), (2, "usa", "ILLINOIS", "Springfield"), (3, "São Tomé", None, "Sao Tome"), (4, "São Tomé", None, "St. Tome"), (5, "USA", "illinois", "Nowhere"), (6, "Atlantis", None, "Nowhere"), (7, None, None, "SÃO TOMÉ"), (8, "Unknown", None, "springfield"), (9, None, None, "far town"), (10, "usa", None, "Far  Town"), (11, "usa", None, None), (12, None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, country_name string, admin1_name string, place_name string")
    known = spark.createDataFrame([("far town", None, "Far Town", 7.0, 7.0)], "normalized_query string, country_code string, resolved_name string, latitude double, longitude double")
    served = spark.createDataFrame([("far town", "US", "Far Town, US", 6.0, 6.0)], "normalized_query string, country_code string, resolved_name string, latitude double, longitude double")
    got = {r.query_id: (r.form, r.ambiguous, r.precision, r.geonames_id, r.latitude) for r in P.geocode(q, g, aliases, known, served).collect()}
    none = (None, False, "unresolved", None, None)
    assert got == {1: (None, True, "country", 5, 8.0), 2: ("exact", False, "place", 1, 1.0), 3: ("ascii", False, "place", 3, 5.0), 4: ("alternate", False, "place", 3, 5.0), 5: (None, False, "admin1", 4, 9.0), 6: none, 7: ("exact", False, "place", 3, 5.0), 8: (None, True, "unresolved", None, None), 9: ("external", False, "place", None, 7.0), 10: ("external", False, "place", None, 6.0), 11: (None, False, "country", 5, 8.0), 12: none}


def test_validation_ladder(spark):
    import json

    brief = [{"slot": s, "text": f"about {s}", "reported": True} for s in N.SLOTS]
    good = {"signal_type": "rumor", "title_english": "T", "brief": brief, "confidence": 0.9}
    count = lambda v, span, i=0: {"value": v, "source_span": span, "source_index": i}
    cases = [
        ("nope", "not_json"), ([], "not_json"), (good, None), (good | {"x": 1}, "shape"), (good | {"brief": brief[::-1]}, "shape"), (good | {"confidence": 1.2}, "shape"), (good | {"title_english": " "}, "shape"), (good | {"source_language": "english"}, "shape"),
        (good | {"epidemiology": {"total_cases": count(3, "14 deaths"), "deaths": count(5, "14 deaths")}}, "arithmetic"),
        (good | {"epidemiology": {"confirmed_cases": count(2, "a"), "suspected_cases": count(2, "a"), "total_cases": count(3, "a")}}, "arithmetic"),
        (good | {"epidemiology": {"deaths": count(14, "14  Deaths")}}, None), (good | {"epidemiology": {"deaths": count(14, "so far")}}, "ungrounded"), (good | {"epidemiology": {"deaths": count(14, "14 deaths", 1)}}, "ungrounded"), (good | {"epidemiology": {"dead": count(14, "14 deaths")}}, "shape"),
        (good | {"transmission": {}}, None), (good | {"transmission": {"imported": count(True, "nowhere said")}}, "ungrounded"), (good | {"title_english": "ask a@b.org"}, "privacy"), (good | {"confidence": 0.3}, "low_confidence"), (good | {"locations": [{"role": "primary", "place_name": "+234 803 555 1234"}]}, "privacy"),
    ]
    df = spark.createDataFrame([(i, c if isinstance(c, str) else json.dumps(c), ["so far 14  deaths", "other"]) for i, (c, _) in enumerate(cases)], "i long, c string, b array<string>")
    assert [r.reason for r in N.validate_extraction(df, "c", "b").orderBy("i").collect()] == [w for _, w in cases]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "u", "h1", None), (2, "u", "h2", "b")], "signal_id long, url string, content_hash string, raw_text string")
    new = spark.createDataFrame([(1, "u", "h2", "x")], "signal_id long, url string, content_hash string, raw_text string")
    assert {tuple(r) for r in K.promote(old, new).collect()} == {(1, "u", "h1", None), (2, "u", "h2", "b")}
    d = spark.createDataFrame([("a.org", "A")], "domain string, name string")
    w = spark.createDataFrame([("b.org", "A"), ("c.org", "C"), ("d.org", "C"), ("a.org", "Z")], "domain string, name string")
    assert {tuple(r) for r in K.get_or_create(d, w, "domain", "name").collect()} == {("a.org", "A"), ("b.org", "b.org"), ("c.org", "C"), ("d.org", "d.org")}
    n = one(spark, *K.count_attempt(F.lit(2), F.lit("fetched"), F.lit(True)))
    assert tuple(n) == (3, "failed")


def test_read_models(spark):
    p = spark.createDataFrame([(1, 1, "mention", "place", 1.0, 1.0, "th"), (1, 2, "primary", "country", 2.0, 2.0, "th"), (1, 3, "primary", "admin1", 3.0, 3.0, "th"), (2, 4, "primary", "place", None, 1.0, "th")], "signal_id long, place_id long, role string, precision string, latitude double, longitude double, country string")
    assert [(r.signal_id, r.place_id, r.country) for r in R.representative_places(p).collect()] == [(1, 3, "TH")]
    b = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0), (3, "a", 3.0), (1, "b", 9.0)], "n long, s string, c double")
    assert sorted((r.s, r.n) for r in R.within_budget(b, "n", "c", 5.0, "s").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert {r.table_name: r.state for r in R.schema_report(spark, ["x", "y"], {"x": spark.range(2)}).collect()} == {"x": "filled", "y": "missing"}


def test_readers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n\n7\tKano\tK\tkn,Kanó\t12.0\t8.5\tP\tPPL\tNG\t\t29\t\t\t\t3000\n")
    r = readers.place_dump(spark, str(tmp_path / "g.txt")).first()
    assert (r.geonames_id, r.country, r.admin1, r.admin2, r.population) == (7, "NG", "29", None, 3000)
    (tmp_path / "n.json").write_text('{"articles":[{"url":"http://A.x/1/","title":"t","seendate":"20260820T113942Z","domain":"a.x","language":"English"},{"url":"","title":"t","seendate":"20260820T113942Z","domain":"a","language":"English"},{"url":"http://b","title":"t","seendate":"bad","domain":"b","language":"English"},{"url":"http://c/","title":"t","seendate":"20260820T113942Z","domain":"c","language":"Klingon"}]}')
    assert [r.canonical_url for r in readers.news_sightings(spark, str(tmp_path / "n.json"), {"English": "en"}).collect()] == ["http://a.x/1"]


def test_landed_inputs(spark, tmp_path):
    """Bulletins, feeds with their pages, seeds, a gazetteer artifact written and read back, JSON results."""
    import gzip
    import json

    (tmp_path / "b.json").write_text(json.dumps({"value": [
        {"Id": "1", "UrlName": "u1", "Title": "<b>Flu</b> &amp; more", "PublicationDate": "2026-01-05T00:00:00Z", "PublicationDateAndTime": "2026-01-05T00:00:00Z", "LastModified": "2026-01-06T00:00:00Z", "Overview": "<p>One</p>", "Advice": "<p>two</p>", "Response": ""},
        {"Id": "2", "Title": "no name", "PublicationDate": "2026-01-05T00:00:00Z", "PublicationDateAndTime": "2026-01-05T00:00:00Z", "LastModified": "2026-01-05T00:00:00Z"},
        {"Id": "3", "UrlName": "old", "Title": "t", "PublicationDate": "2025-01-05T00:00:00Z", "PublicationDateAndTime": "2025-01-05T00:00:00Z", "LastModified": "2025-01-05T00:00:00Z"},
        {"Id": "4", "UrlName": "edge", "Title": "t", "PublicationDate": "2026-01-01T00:00:00Z", "PublicationDateAndTime": "2026-01-01T00:00:00Z", "LastModified": "2026-01-01T00:00:00Z"},
    ]}))
    got = [(r.Id, r.title, r.raw_text, r.error) for r in readers.outbreak_bulletins(spark, str(tmp_path / "b.json"), "2026-01-01T00:00:00Z").collect()]
    assert got == [("2", "no name", "", "UrlName"), ("1", "Flu & more", "One\n\ntwo", None)]
    assert readers.outbreak_bulletins(spark, str(tmp_path / "b.json"), "2026-01-01T00:00:00Z", True).count() == 3
    (tmp_path / "f.xml").write_text('<rss><channel><item><title>A</title><link>http://e/a</link><pubDate>Thu, 20 Aug 2026 11:39:42 +0000</pubDate></item><item><title>B</title><link>http://e/b</link><pubDate>Thu, 20 Aug 2025 11:39:42 +0000</pubDate></item></channel></rss>')
    items = readers.feed_items(spark, str(tmp_path / "f.xml"), "2026-01-01T00:00:00Z")
    pages = spark.createDataFrame([("http://e/a", '<link rel="canonical" href="http://E/canon/"><meta property="article:published_time" content="2026-08-19T10:00:00+0200"><div class="wysiwyg-content x"><p>Body</p></div>')], "url string, html string")
    r = readers.with_pages(items, pages).collect()
    assert [(x.title, x.canonical_url, x.raw_text, x.error) for x in r] == [("A", "http://e/canon", "Body", None)]
    (tmp_path / "s.json").write_text('[{"slug": "flu", "synonyms": ["grippe"]}]')
    assert readers.seeds(spark, str(tmp_path / "s.json"), "slug string, synonyms array<string>").first().synonyms == ["grippe"]
    g = spark.createDataFrame([(2, "B", None), (1, "A", "x,,y")], "geonames_id long, name string, alternate_names string")
    K.write_sorted_tsv(g, str(tmp_path / "g"), "geonames_id")
    (part,) = (tmp_path / "g").glob("part-*.gz")
    assert gzip.open(part, "rt").read().splitlines()[1].startswith("1\tA")
    back = readers.gazetteer(spark, str(tmp_path / "g"), "geonames_id long, name string, alternate_names string").orderBy("geonames_id").collect()
    assert [(r.geonames_id, r.alternate_names) for r in back] == [(1, ["x", "y"]), (2, [])]
    K.write_json(g.where("geonames_id = 2"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().name == "B"
