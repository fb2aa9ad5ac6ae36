"""Places: the ladder from a name to a position, its pass over signals, direct locations, labels, GeoJSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions import timegeo as T
from harrier.sources import sinks as K

_FOUND = ("geonames_id", "name", "precision", "country_code", "admin1_code", "admin2_code", "latitude", "longitude")
_ROW = "struct<geonames_id:bigint,name:string,precision:string,country_code:string,admin1_code:string,admin2_code:string,latitude:double,longitude:double>"
_ASKED = ("country_name", "admin1_name", "place_name")


def direct_location(df: DataFrame, locations: str, country: str, admin1: str) -> DataFrame:
    """One location of a signal from its extraction (array of role, country, admin1): the first primary one, else the
    first; the triage's country wins. Never finer than a first level unit."""
    all_ = F.col(locations)
    primary = F.filter(all_, lambda x: x["role"] == "primary")
    own = F.when(F.size(primary) > 0, primary[0]).when(F.size(all_) > 0, all_[0])
    c, a = F.coalesce(X.country_code(F.col(country)), X.country_code(own["country"])), F.coalesce(F.nullif(F.trim(F.col(admin1)), F.lit("")), own["admin1"])
    return df.withColumns({"place_country": c, "place_admin1": F.when(c.isNotNull(), a), "place_precision": F.when(c.isNull(), "unresolved").when(a.isNotNull(), "admin1").otherwise("country")})


def label(*parts: Column) -> Column:
    """The first part that says something, else Unknown."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit("Unknown"))


def cached(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries (name, country) with what the cache knows; a null country is the whole world and matches only itself."""
    q = queries.withColumn("_k", X.cache_key(F.col("name")))
    c = cache.select(F.col("normalized_query").alias("_ck"), F.col("country_code").alias("_cc"), "latitude", "longitude")
    return q.join(c, (F.col("_k") == F.col("_ck")) & F.col("country").eqNullSafe(F.col("_cc")), "left").drop("_k", "_ck", "_cc")


def feature(properties: list[str], latitude: str = "latitude", longitude: str = "longitude") -> Column:
    """A GeoJSON point feature."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(longitude), F.col(latitude)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))


def alternates(names: Column, name: Column) -> Column:
    """Other names of a place in their look-up form: no empty ones, none equal to the name's, each once, in their order."""
    form = lambda x: X.place_form(x, X.latin_fold)
    return F.array_distinct(F.filter(F.transform(names, form), lambda x: (x != "") & (x != form(name))))


def _first(rows: DataFrame, keys: list[str], what: Column) -> DataFrame:
    """The row of least geonames_id of each key."""
    return rows.groupBy(*keys).agg(F.min_by(what, F.col("geonames_id")).alias("_f"))


def geocode(queries: DataFrame, gazetteer: DataFrame, aliases: DataFrame, cache: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """queries (any key, country_name, admin1_name, place_name) with what they resolve to: precision, form, ambiguous and the
    columns of the place.

    gazetteer: geonames_id, name, precision, normalized_name, ascii_name, alternate_names, codes, latitude, longitude.
    aliases: (alias, country_code). The place is looked up by its exact, then ASCII, then alternate form within the country
    and first level unit that were named (the whole world without a known country). Two places for a form end the
    search: what is ambiguous is never guessed. What no form knows is asked of the cache, then of the answers of an
    external service (both: normalized_query, country_code, resolved_name, latitude, longitude). Else the unit's or the
    country's own row is the answer. Each different question is answered once, however many rows ask it."""
    asked = queries.select(*_ASKED).distinct().withColumn("_q", F.xxhash64(*[F.coalesce(F.concat(F.lit("s"), c), F.lit("n")) for c in _ASKED]))
    named = aliases.select(F.col("alias").alias("_alias"), F.col("country_code").alias("_cc")).dropDuplicates(["_alias"])
    q = asked.withColumn("_k", X.place_form(F.col("country_name"))).join(named, F.col("_k") == F.col("_alias"), "left").drop("_alias", "_k")
    units = gazetteer.where("precision = 'admin1'")
    called = units.select("country_code", "geonames_id", "admin1_code", F.explode(F.array_distinct(F.array(F.concat(F.lit("n"), "normalized_name"), F.concat(F.lit("a"), "ascii_name")))).alias("_k"))
    unit = q.where("_cc IS NOT NULL AND admin1_name <> ''").select("_q", "_cc", F.explode(F.array(F.concat(F.lit("n"), X.place_form(F.col("admin1_name"))), F.concat(F.lit("a"), X.ascii_form(F.col("admin1_name"))))).alias("_k"))
    unit = _first(unit.join(called, (F.col("_cc") == F.col("country_code")) & (unit["_k"] == called["_k"])), ["_q"], F.col("admin1_code")).withColumnRenamed("_f", "_a1")
    q = q.join(unit, "_q", "left").withColumns({"_exact": X.place_form(F.col("place_name")), "_ascii": X.ascii_form(F.col("place_name")), "_cached": X.cache_key(F.col("place_name"))})
    found = F.struct(*[F.col(f"g.{c}") for c in _FOUND])
    scope = (F.col("q._cc").isNull() | (F.col("q._cc") == F.col("g.country_code"))) & (F.col("q._cc").isNull() | F.col("q._a1").isNull() | (F.col("q._a1") == F.col("g.admin1_code")))
    forms = {"exact": ("_exact", gazetteer.withColumn("_k", F.col("normalized_name"))), "ascii": ("_ascii", gazetteer.withColumn("_k", F.col("ascii_name"))), "alternate": ("_exact", gazetteer.withColumn("_k", F.explode("alternate_names")))}
    out = q
    for form, (key, g) in forms.items():
        m = q.where("place_name <> ''").alias("q").join(g.alias("g"), (F.col(f"q.{key}") == F.col("g._k")) & scope)
        m = m.groupBy("q._q").agg(F.countDistinct("g.geonames_id").alias(f"_n_{form}"), F.min_by(found, F.col("g.geonames_id")).alias(f"_p_{form}"))
        out = out.join(m, "_q", "left")
    n = {f: F.coalesce(F.col(f"_n_{f}"), F.lit(0)) for f in forms}
    tried = F.when(n["exact"] > 0, "exact").when(n["ascii"] > 0, "ascii").when(n["alternate"] > 0, "alternate")
    out = out.withColumn("_tried", tried)
    many = reduce(lambda c, f: c.when(F.col("_tried") == f, n[f] > 1), list(forms)[1:], F.when(F.col("_tried") == "exact", n["exact"] > 1)).otherwise(False)
    out = out.withColumn("ambiguous", F.coalesce(many, F.lit(False)))
    place = reduce(lambda c, f: c.when(F.col("_tried") == f, F.col(f"_p_{f}")), list(forms)[1:], F.when(F.col("_tried") == "exact", F.col("_p_exact")))
    place = F.when(~F.col("ambiguous"), place)
    outside = [F.lit(None).cast(_ROW)]
    for k, answers in enumerate((cache, external)):
        if answers is not None:
            a = answers.groupBy(F.col("normalized_query").alias("_cached"), F.col("country_code").alias("_acc")).agg(F.min(F.struct(F.lit(None).cast("bigint").alias("geonames_id"), F.col("resolved_name").alias("name"), F.lit("place").alias("precision"), F.col("country_code").alias("country_code"), F.lit(None).cast("string").alias("admin1_code"), F.lit(None).cast("string").alias("admin2_code"), "latitude", "longitude")).alias(f"_e{k}"))
            out = out.alias("o").join(a.alias("a"), (F.col("o._cached") == F.col("a._cached")) & F.col("o._cc").eqNullSafe(F.col("a._acc")), "left").select("o.*", f"a._e{k}")
            outside.append(F.col(f"_e{k}"))
    missing = F.col("_tried").isNull() & (F.col("place_name") != "")
    row = F.struct(*_FOUND)
    own_unit = _first(units.where("admin1_code IS NOT NULL"), ["country_code", "admin1_code"], row).select(F.col("country_code").alias("_cc"), F.col("admin1_code").alias("_a1"), F.col("_f").alias("_unit"))
    land = _first(gazetteer.where("precision = 'country'"), ["country_code"], row).select(F.col("country_code").alias("_cc"), F.col("_f").alias("_land"))
    out = out.join(own_unit, ["_cc", "_a1"], "left").join(land, "_cc", "left")
    out = out.withColumn("_place", place).withColumn("_outside", F.when(missing, F.coalesce(*outside)))
    form = F.when(F.col("_place").isNotNull(), F.col("_tried")).when(F.col("_outside").isNotNull(), "external")
    best = F.coalesce("_place", "_outside", "_unit", "_land")
    out = out.withColumn("form", form).withColumn("_best", best)
    precision = F.when(F.col("_best").isNull(), "unresolved").when(F.col("form").isNotNull(), F.col("_best.precision")).when(F.col("_unit").isNotNull(), "admin1").otherwise("country")
    out = out.withColumn("precision", precision)
    answered = out.select(
        *_ASKED, "form", "ambiguous", "precision", "_best.geonames_id", F.col("_best.name").alias("resolved_name"), F.coalesce("_best.country_code", "_cc").alias("country_code"),
        F.col("_best.admin1_code").alias("admin1_code"), F.col("_best.admin2_code").alias("admin2_code"), F.col("_best.latitude").alias("latitude"), F.col("_best.longitude").alias("longitude"),
        T.geocode_confidence(F.col("precision"), F.col("form")).alias("confidence"),
    )
    same = reduce(lambda a, b: a & b, [F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _ASKED])
    return queries.alias("q").join(answered.alias("r"), same).select("q.*", *[f"r.{c}" for c in answered.columns if c not in _ASKED])


def geocoding_pass(signals: DataFrame, stored: DataFrame, resolved: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(signals, places) after a pass: resolved (signal_id and the columns of stored but for geocoding_source) replaces what
    is stored of its signals, and they are geocoded."""
    new = resolved.withColumn("geocoding_source", F.lit(source)).select(*stored.columns)
    done = resolved.select("signal_id").distinct().withColumn("status", F.lit("geocoded"))
    return K.apply_decisions(signals, done, ["signal_id"]), K.replace_children(stored, new, ["signal_id"])


def stale(signals: DataFrame, stored: DataFrame, source: str) -> DataFrame:
    """Geocoded signals any of whose places has another source, or none."""
    other = stored.where(~F.col("geocoding_source").eqNullSafe(F.lit(source))).select("signal_id").distinct()
    return signals.where("status = 'geocoded'").join(other, "signal_id", "left_semi")


def unit_positions(gazetteer: DataFrame) -> DataFrame:
    """(country_code, key, place) of first level units by code, look-up form and ASCII form; of several with one key, the
    row of least geonames_id."""
    rows = gazetteer.where("precision = 'admin1' AND admin1_code IS NOT NULL")
    keyed = rows.select("country_code", "geonames_id", F.struct("name", "latitude", "longitude").alias("place"), F.explode(F.array_distinct(F.array("admin1_code", "normalized_name", "ascii_name"))).alias("key"))
    return _first(keyed, ["country_code", "key"], F.col("place")).withColumnRenamed("_f", "place")


def mapped(events: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Events (country_code, admin1) with a place for the map: the unit by the name as it stands, by its look-up form, by
    its ASCII form, else the country's own row, else none."""
    units, out = unit_positions(gazetteer), events
    a = F.col("admin1")
    for k, key in enumerate((a, X.place_form(a), X.ascii_form(a))):
        out = out.withColumn("_key", key).join(units.select("country_code", F.col("key").alias("_key"), F.col("place").alias(f"_u{k}")), ["country_code", "_key"], "left").drop("_key")
    land = _first(gazetteer.where("precision = 'country' AND admin1_code IS NULL"), ["country_code"], F.struct("latitude", "longitude")).withColumnRenamed("_f", "_land")
    out = out.join(land, "country_code", "left").withColumn("_u", F.coalesce("_u0", "_u1", "_u2"))
    level = F.when(F.col("_u").isNotNull(), "admin1").when(F.col("_land").isNotNull(), "country")
    return out.select(*events.columns, F.coalesce("_u.name", "admin1").alias("place_name"), level.alias("map_level"), F.coalesce("_u.latitude", "_land.latitude").alias("latitude"), F.coalesce("_u.longitude", "_land.longitude").alias("longitude"))
