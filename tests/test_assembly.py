"""Assembly, model passes and places on small inputs."""

from pyspark.sql import functions as F

from harrier.operators import assembly as A
from harrier.operators import models as M
from harrier.operators import places as P

COLS = "id long, identity string, country string, admin1 string, admin2 string, precision string, latitude double, longitude double, at double, updated double"


def place(i, at, lat=10.0, identity="id:d", country="TH", admin1="A", precision="place"):
    return (i, identity, country, admin1, None, precision, lat, 20.0, at * 86400.0, at * 86400.0)


def test_later_clusters_see_earlier_events(spark):
    clusters = spark.createDataFrame([place(1, 1), place(2, 2), place(3, 3, lat=50.0), place(4, 3, identity=None), place(5, 4, precision="unresolved"), place(6, 5, lat=50.1)], COLS)
    events = spark.createDataFrame([place(100, 0, lat=70.0)], COLS)
    got = {r.cluster_id: (r.decision, r.event_id) for r in A.assemble(clusters, events, 5 * 86400.0).collect()}
    assert got == {1: ("create", 1), 2: ("attach", 1), 3: ("create", 3), 4: ("create", 4), 5: ("create", 5), 6: ("attach", 3)}
    two = spark.createDataFrame([place(100, 0), place(101, 0)], COLS)
    assert {r.cluster_id: (r.decision, r.event_id) for r in A.assemble(clusters.where("id = 1"), two, 86400.0).collect()} == {1: ("refuse", 1)}
    assert {r.decision for r in A.assemble(clusters.where("id = 1"), two, 30 * 86400.0).collect()} == {"create"}


def test_ladder(spark):
    requests = spark.createDataFrame([("a", "p", "good"), ("b", "p", "never"), ("c", "p", "second")], "id string, prompt string, body string").coalesce(1)
    call = lambda model, prompt, fault: (f"{model}{'+' if fault else ''}", 10, 5)
    check = lambda content, body: None if body == "good" or body == "second" and content == "big+" else "shape"
    got = sorted((r.id, r.model, r.attempt, r.outcome) for r in M.climb(requests, [("small", 1), ("big", 2)], call, check).collect())
    assert got == [("a", "small", 1, "accepted"), *[("b", m, k, "rejected") for m in ("big", "small") for k in (1, 2)], ("c", "big", 1, "rejected"), ("c", "big", 2, "accepted"), ("c", "small", 1, "rejected"), ("c", "small", 2, "rejected")]
    assert [r.outcome for r in M.climb(requests, [("small", 1)], call, check, per_partition=2).collect()].count("deferred") == 2
    models = spark.createDataFrame([("m1", 1, None, True), ("m2", 2, "triage", True), ("m3", 2, "other", True), ("m4", 1, None, False)], "model_id string, tier int, purpose string, active boolean")
    assert [r.model_id for r in M.roster(models, "triage", 2).collect()] == ["m1", "m2"] and [r.model_id for r in M.roster(models, "x", 2, 2).collect()] == ["m1"]


def test_places(spark):
    df = spark.createDataFrame([(1, [("mention", "ng", "Kano"), ("primary", "cd", None)], None, ""), (2, [], "gh", " "), (3, [], None, None)], "id long, locs array<struct<role:string,country:string,admin1:string>>, c string, a string")
    got = {r.id: (r.place_country, r.place_admin1, r.place_precision) for r in P.direct_location(df, "locs", "c", "a").collect()}
    assert got == {1: ("CD", None, "country"), 2: ("GH", None, "country"), 3: (None, None, "unresolved")}
    q = spark.createDataFrame([(" Kano ", None), ("kano", "NG"), ("x", None)], "name string, country string")
    c = spark.createDataFrame([("kano", None, 1.0, 2.0)], "normalized_query string, country_code string, latitude double, longitude double")
    assert sorted((r.name, r.latitude) for r in P.cached(q, c).collect()) == [(" Kano ", 1.0), ("kano", None), ("x", None)]
    r = c.select(P.feature(["normalized_query"]).alias("f"), P.label(F.lit(""), F.lit(None).cast("string")).alias("l")).first()
    assert r.f == '{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,1.0]},"properties":{"normalized_query":"kano"}}' and r.l == "Unknown"


def in_order(clusters, events, now, lookback, newest, threshold):
    """The plain form: one cluster after the other, all events at hand. Rows as in COLS."""
    keys = [c.split()[0] for c in COLS.split(", ")]
    events, out = [dict(zip(keys, e)) for e in events], []
    for c in sorted((dict(zip(keys, c)) for c in clusters), key=lambda c: (c["at"], c["id"])):
        met = [e for e in events if c["identity"] and c["country"] and (e["identity"], e["country"]) == (c["identity"], c["country"]) and e["updated"] >= now - lookback]
        met = sorted(met, key=lambda e: (-e["updated"], e["id"]))[:newest]
        over = [(s, e) for e in met if (s := A.score(c, e, 50.0, 90.0)) >= threshold]
        if len(over) == 1:
            s, e = over[0]
            e["updated"] = max(e["updated"], c["updated"])
            out.append((c["id"], "attach", e["id"], round(s, 9)))
        else:
            events.append(c)
            out.append((c["id"], "refuse" if over else "create", c["id"], round(max((s for s, _ in over), default=0.0), 9)))
    return sorted(out)


def random_clusters(seed, n, first):
    import random

    rnd = random.Random(seed)
    for i in range(n):
        at = rnd.uniform(0, 40) * 86400
        one = rnd.random() < 0.4  # one disease and country has many
        yield (first + i, "id:d" if one else rnd.choice(["id:d", "id:e", "text:f", None]), "TH" if one else rnd.choice(["TH", "NG", None]), rnd.choice(["A", "B", None]), rnd.choice(["x", "y", None]), rnd.choice(["place", "place", "admin1", "admin2", "country", "unresolved"]), rnd.uniform(10, 11), 20.0, at, at + rnd.choice([0, 0, 1, 5, 30]) * 86400)


def test_old_clusters_at_once_are_as_in_order(spark):
    decisions = set()
    for seed in range(3):
        clusters, events = list(random_clusters(seed, 150, 0)), list(random_clusters(seed + 50, 25, 1000))
        now, newest, threshold = [45 * 86400.0, 30 * 86400.0, 20 * 86400.0][seed], [20, 3, 1][seed], [0.6, 0.8, 0.9][seed]
        got = A.assemble(spark.createDataFrame(clusters, COLS), spark.createDataFrame(events, COLS), now, newest=newest, threshold=threshold)
        want = in_order(clusters, events, now, 7 * 86400, newest, threshold)
        assert sorted((r.cluster_id, r.decision, r.event_id, round(r.score, 9)) for r in got.collect()) == want
        decisions |= {(d, clusters[i][-1] >= now - 7 * 86400) for i, d, *_ in want}
    assert decisions == {(d, recent) for d in ("attach", "refuse", "create") for recent in (True, False)}
    none = spark.createDataFrame([], COLS)
    assert A.assemble(none, none, 0.0).count() == 0 and A.assemble(spark.createDataFrame(clusters, COLS), none, 1e12).count() == 150
