"""Versions of several tables, and review decisions that change them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harrier.operators import resolutions as R
from harrier.sources import sinks as K
from harrier.sources.store import Conflict, Store

DAY = dt.datetime(2024, 1, 5)


def one(spark, v):
    return spark.createDataFrame([(v,)], "v int")


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    assert a.version() == 0 and a.tables() == {}
    assert a.commit({"x": one(spark, 1), "y": one(spark, 10)}, 0) == 1
    seen = b.version()
    assert a.commit({"x": one(spark, 2)}, seen) == 2
    with pytest.raises(Conflict):
        b.commit({"x": one(spark, 3), "y": one(spark, 30)}, seen)
    assert [b.read(n).first().v for n in "xy"] == [2, 10] and b.read("x", 1).first().v == 1
    assert b.commit({"x": one(spark, 3)}, b.version()) == 3


def test_a_writer_that_is_late_by_a_moment(spark, tmp_path, monkeypatch):
    """The other manifest comes between the look at the version and the move."""
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    a.commit({"x": one(spark, 1)}, 0)
    a.commit({"x": one(spark, 2)}, 1)
    monkeypatch.setattr(b, "version", lambda: 1)
    with pytest.raises(Conflict):
        b.commit({"x": one(spark, 9)}, 1)
    monkeypatch.undo()
    assert b.read("x").first().v == 2 and b.version() == 2


def test_columns_become_null(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    new = spark.createDataFrame([(1, None, 7)], "k int, s string, n int")
    assert sorted(map(tuple, K.set_columns(old, new, ["k"]).collect())) == [(1, None, 7), (2, "b", 6)]
    assert sorted(map(tuple, K.set_columns(old, new.select("k", "s"), ["k"]).collect())) == [(1, None, 5), (2, "b", 6)]


def test_resolutions_by_hand(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    signals = spark.createDataFrame(
        [(i, "src", at(i), None, "d1", "NG", None, "country", "review", 2) for i in range(1, 8)],
        "signal_id long, source string, first_seen_at timestamp, published_at timestamp, disease_id string, country string, admin1 string, precision string, status string, attempts int",
    )
    kinds = ["event_match_ambiguous", "event_match_ambiguous", "retrieval_failed", "disease_unresolved", "disease_unresolved", "event_match_ambiguous", "content_integrity"]
    cases = spark.createDataFrame([(10 + i, i, kinds[i - 1], "open", 1, None) for i in range(1, 8)], "case_id long, signal_id long, reason string, state string, version int, resolution string")
    commands = spark.createDataFrame(
        [(11, "link_event", 1, 100, None), (12, "create_event", 1, None, None), (13, "retry_retrieval", 1, None, None), (14, "assign_disease", 1, None, "d2"), (15, "assign_disease", 1, None, "none"), (16, "link_event", 1, 200, None), (17, "dismiss", 0, None, None)],
        "case_id long, action string, version int, event_id long, disease_id string",
    )
    events = spark.createDataFrame([(100, "d1", "NG", at(0), at(0), 1, 0.1), (200, "d1", "NG", at(0), at(0), 0, None)], "event_id long, disease_id string, country string, start timestamp, updated timestamp, n_articles long, early_signal_score double")
    links = spark.createDataFrame([(100, 7, "initial_report", 1.0, True)], "event_id long, signal_id long, relationship_type string, match_score double, is_primary boolean")
    candidates = spark.createDataFrame([(11, 100, 0.7), (16, 300, 0.9)], "case_id long, event_id long, match_score double")
    diseases = spark.createDataFrame([("d1",), ("d2",)], "disease_id string")
    t = R.apply_resolutions(cases, commands, signals, links, events, candidates, diseases, F.lit(at(9)))
    assert {r.case_id: r.outcome for r in t["outcomes"].collect()} == {11: "closed", 12: "closed", 13: "closed", 14: "closed", 15: "no_disease", 16: "target_stale", 17: "stale"}
    assert {r.case_id: (r.state, r.version, r.resolution) for r in t["cases"].collect()} == {11: ("resolved", 2, "link_event"), 12: ("resolved", 2, "create_event"), 13: ("resolved", 2, "retry_retrieval"), 14: ("resolved", 2, "assign_disease"), **{k: ("open", 1, None) for k in (15, 16, 17)}}
    assert {r.signal_id: (r.status, r.attempts, r.disease_id) for r in t["signals"].collect()} == {1: ("matched", 2, "d1"), 2: ("matched", 2, "d1"), 3: ("fetched", 0, "d1"), 4: ("extracted", 2, "d2"), 5: ("review", 2, "d1"), 6: ("review", 2, "d1"), 7: ("review", 2, "d1")}
    assert {tuple(r) for r in t["links"].collect()} == {(100, 7, "initial_report", 1.0, True), (100, 1, "supporting_source", 0.7, False), (-3, 2, "initial_report", 1.0, True)}
    got = {r.event_id: r for r in t["events"].collect()}
    assert {k: (r.n_articles, r.updated, r.start) for k, r in got.items()} == {100: (2, at(7), at(0)), 200: (0, at(0), at(0)), -3: (1, at(2), at(2))}
    assert got[-3].disease_id == "d1" and got[-3].country == "NG" and got[100].early_signal_score > 0.1 and got[200].early_signal_score is None
