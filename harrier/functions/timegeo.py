"""Time, geography, vectors and scores as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and rank of a location's precision, from fine to coarse.
PRECISION_WEIGHT = {"place": 1.0, "admin2": 0.75, "admin1": 0.5, "country": 0.25, "unresolved": 0.0}
PRECISION_RANK = {"place": 4, "admin2": 3, "admin1": 2, "country": 1, "unresolved": 0}
#: Credibility of a source, and its rank among representatives.
CREDIBILITY = {"official": 1.0, "high": 0.8, "medium": 0.5, "unknown": 0.2}
CREDIBILITY_RANK = {"official": 3, "high": 2, "medium": 1, "unknown": 0}
EARTH_KM = 6371.0


def lookup(c: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def stated_offset(c: Column) -> Column:
    """Minutes of the UTC offset that an ISO time states; null for a naive one."""
    zone = F.regexp_extract(c, r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    return F.when(zone == "Z", 0).when(zone != "", sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))


def iso_time(c: Column) -> Column:
    return F.try_to_timestamp(F.btrim(c))


def feed_time(c: Column) -> Column:
    """An RFC 2822 date; the weekday is not parsed."""
    return F.try_to_timestamp(F.regexp_replace(F.btrim(c), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def seen_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def seconds(c: Column) -> Column:
    return F.unix_micros(c) / 1e6


def gap_days(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86_400e6


def span_gap_days(start: Column, end: Column, o_start: Column, o_end: Column) -> Column:
    """Days between two spans of time, 0 where they overlap."""
    apart = F.greatest(F.unix_micros(o_start) - F.unix_micros(end), F.unix_micros(start) - F.unix_micros(o_end), F.lit(0))
    return apart / 86_400e6


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000)


def catch_up(now: Column, last_end: Column, default_minutes: int, most_minutes: int) -> tuple[Column, Column]:
    """(start, end) of a polling window: from the last run's end (or the default back from now), at most most_minutes
    back and never after now."""
    back = lambda minutes: now - F.make_interval(mins=F.lit(minutes))
    return F.least(F.greatest(F.coalesce(last_end, back(default_minutes)), back(most_minutes)), now), now


def stale_run(status: Column, finished: Column, started: Column, now: Column, poll_minutes: int) -> Column:
    return (status == "running") & finished.isNull() & (F.unix_micros(now) - F.unix_micros(started) > 2 * poll_minutes * 60_000_000)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _rank(c: Column) -> Column:
    return lookup(c, PRECISION_RANK, 0)


def spatially_compatible(a: str, b: str, km: float = 50.0) -> Column:
    """Two locations (struct columns a and b: country, admin1, admin2, latitude, longitude, precision) at the coarser of
    their precisions. Never across or without countries; a place pair must be within km."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    shared = F.least(_rank(x("precision")), _rank(y("precision")))
    veto = F.coalesce(x("admin1") != y("admin1"), F.lit(False))
    near = haversine_km(x("latitude"), x("longitude"), y("latitude"), y("longitude")) <= km
    out = F.when(shared == 0, False).when(~F.coalesce(x("country") == y("country"), F.lit(False)), False)
    out = out.when(shared == 1, True).when(shared == 2, x("admin1") == y("admin1"))
    return F.coalesce(out.when(shared == 3, ~veto & (x("admin2") == y("admin2"))).otherwise(near), F.lit(False))


def within_days(t1: Column, t2: Column, days: float) -> Column:
    return gap_days(t1, t2) <= days


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def saturate(c: Column, scale: float) -> Column:
    return 1 - F.exp(-c / scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector unchanged."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def geocode_confidence(precision: Column, form: Column) -> Column:
    """By form for a place, by precision for a coarser answer."""
    place = lookup(form, {"exact": 0.95, "ascii": 0.85, "alternate": 0.75, "external": 0.65})
    return F.when(precision == "place", place).otherwise(lookup(precision, {"admin2": 0.70, "admin1": 0.55, "country": 0.30}))


def money(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a request at prices per million tokens, six places, half to even; missing tokens count 0."""
    d = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,6)")
    return F.bround((d(tokens_in) * price_in.cast("decimal(12,6)") + d(tokens_out) * price_out.cast("decimal(12,6)")) / 1_000_000, 6).cast("decimal(12,6)")
