"""What a model says of an article: the payload's schema, the checks before it is stored, and what it then sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.functions.schema import Date, Each, Flag, Number, Object, Text, Whole, json_fault
from harrier.operators.queues import LEAST_VERSION, VERSION

#: The slots of a brief in their order, the kinds of signal and of place, and the limits of texts.
SLOTS = ("what_where", "counts", "timing", "spread", "reporting")
KINDS = ("outbreak_report", "surveillance_update", "case_report", "imported_case", "public_health_action", "vaccination_campaign", "risk_assessment", "situation_report", "research", "rumor", "unknown")
COUNTS = ("suspected_cases", "confirmed_cases", "total_cases", "deaths", "new_cases", "new_deaths")
FLAGS = ("local_transmission", "imported")
SPAN_CHARS, POINT_CHARS, TITLE_CHARS, NAME_CHARS = 300, 200, 300, 200
#: Which counts may not exceed which, in the order in which they are checked.
NOT_ABOVE = (("deaths", "total_cases"), ("new_cases", "total_cases"), ("confirmed_cases", "total_cases"), ("suspected_cases", "total_cases"), ("new_deaths", "deaths"))

_COUNT = "struct<value:bigint,source_span:string,source_index:bigint>"
_FLAG = "struct<value:boolean,source_span:string,source_index:bigint>"
PAYLOAD = (
    "struct<signal_type:string,source_language:string,title_english:string,brief:array<struct<slot:string,text:string,reported:boolean>>,"
    "disease:struct<name:string,confidence:double>,pathogen:struct<name:string,confidence:double>,"
    "locations:array<struct<role:string,country:string,admin1:string,place_name:string>>,"
    f"epidemiology:struct<{','.join(f'{c}:{_COUNT}' for c in COUNTS)}>,dates:struct<data_as_of:string,event_date:string>,"
    f"transmission:struct<{','.join(f'{c}:{_FLAG}' for c in FLAGS)}>,confidence:double,extraction_schema_version:bigint>"
)
#: The codes of languages (ISO 639-1), and the roles of places.
LANGUAGES = tuple(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
ROLES = ("primary", "exposure", "diagnosis", "travel", "reporting", "affected_area")
COUNTRY_CHARS = 100


def payload_schema(roles: tuple[str, ...] = ROLES) -> Object:
    """The closed schema of an extraction; no roles: a place may have any."""
    claim = lambda value: Object({"value": value, "source_span": Text(SPAN_CHARS), "source_index": Whole(0)}, ("value", "source_span"), ("source_index",))
    entity = Object({"name": Text(NAME_CHARS, blank=True), "confidence": Number(0, 1)}, ("name", "confidence"))
    name = lambda most: Text(most, blank=True, empty=True)
    place = Object({"role": Text(among=roles), "country": name(COUNTRY_CHARS), "admin1": name(NAME_CHARS), "place_name": name(NAME_CHARS)}, ("role",))
    point = Object({"slot": Text(among=SLOTS), "text": Text(POINT_CHARS), "reported": Flag()}, ("slot", "text", "reported"))
    fields = {
        "signal_type": Text(among=KINDS), "source_language": Text(codes=LANGUAGES), "title_english": Text(TITLE_CHARS), "brief": Each(point, ("slot", SLOTS)),
        "disease": entity, "pathogen": entity, "locations": Each(place), "epidemiology": Object({c: claim(Whole(0)) for c in COUNTS}),
        "dates": Object({"data_as_of": Date(), "event_date": Date()}), "transmission": Object({c: claim(Flag()) for c in FLAGS}), "confidence": Number(0, 1),
    }
    return Object(fields, ("signal_type", "title_english", "brief", "confidence"), ("locations", "epidemiology", "dates"))


def payload_fault(content: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The path of the first fault of an extraction as JSON text, null if it keeps to the schema."""
    return json_fault(content, payload_schema(roles))


def _any(tests: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def _impossible(p: Column) -> Column:
    v = lambda c: p["epidemiology"][c]["value"]
    return _any([*[v(a) > v(b) for a, b in NOT_ABOVE], v("confirmed_cases") + v("suspected_cases") > v("total_cases")])


def _ungrounded(p: Column, bodies: Column) -> Column:
    """Is a claim not in the article that it names, or a number not in its own words? Both sides are folded alike."""
    flat = lambda c: X.latin_fold(X.collapse(c))

    def wrong(claim: Column, number: bool) -> Column:
        i = F.coalesce(claim["source_index"], F.lit(0)).cast("int")
        body = F.get(bodies, i)
        bad = body.isNull() | ~F.contains(flat(body), flat(claim["source_span"]))
        return claim.isNotNull() & (bad | ~F.contains(claim["source_span"], claim["value"].cast("string")) if number else bad)

    return _any([*[wrong(p["epidemiology"][c], True) for c in COUNTS], *[wrong(p["transmission"][c], False) for c in FLAGS]])


def _private(p: Column) -> Column:
    shown = F.concat(F.array(p["title_english"]), F.transform(p["brief"], lambda b: b["text"]), F.coalesce(F.transform(p["locations"], lambda x: x["place_name"]), F.array().cast("array<string>")))
    return F.exists(shown, lambda t: F.coalesce(X.private_text(t), F.lit(False)))


def validate_extraction(df: DataFrame, content: str, bodies: str, least_confidence: float = 0.6, roles: tuple[str, ...] = ()) -> DataFrame:
    """reason: the first check that an answer fails (not_json, shape, arithmetic, ungrounded, privacy, low_confidence), or
    null. shape is any fault of the closed schema (payload_fault says which). bodies: array of the articles that were sent; every claim is held against the one that it names. A transmission
    without a flag is nothing said, no fault."""
    p = F.from_json(F.col(content), PAYLOAD)
    df = df.withColumn("_p", p)
    p = F.col("_p")
    reason = (
        F.when(F.json_object_keys(F.col(content)).isNull(), "not_json").when(payload_fault(F.col(content), roles).isNotNull(), "shape").when(_impossible(p), "arithmetic")
        .when(_ungrounded(p, F.col(bodies)), "ungrounded").when(_private(p), "privacy").when(p["confidence"] < least_confidence, "low_confidence")
    )
    return df.withColumn("reason", reason).drop("_p")


def batch_identity(df: DataFrame, sent: str, returned: str) -> DataFrame:
    """reason: batch_identity unless the ids that came back (array) are those that were sent, each once."""
    whole = (F.size(returned) == F.size(F.array_distinct(returned))) & (F.size(F.array_except(sent, returned)) == 0) & (F.size(F.array_except(returned, sent)) == 0)
    return df.withColumn("reason", F.when(~F.coalesce(whole, F.lit(False)), "batch_identity"))


def stored(content: Column) -> Column:
    """A stored extraction, read with tolerance: null where it is no object."""
    return F.when(F.json_object_keys(content).isNotNull(), F.from_json(content, PAYLOAD))


def presentable(p: Column) -> Column:
    """May a stored extraction be shown? A supported version, an English title and a whole brief."""
    return F.coalesce(p["extraction_schema_version"].between(LEAST_VERSION, VERSION) & (X.collapse(p["title_english"]) != "") & (F.size(p["brief"]) == len(SLOTS)), F.lit(False))


def brief_text(p: Column) -> Column:
    return F.array_join(F.transform(p["brief"], lambda b: b["text"]), "\n")


def places_of(signals: DataFrame, p: str) -> DataFrame:
    """(signal_id, position, role, country, admin1, place_name) of each place that an extraction names."""
    return signals.select("signal_id", F.posexplode(f"{p}.locations").alias("position", "l")).select("signal_id", "position", "l.role", F.col("l.country").alias("country_name"), F.col("l.admin1").alias("admin1_name"), "l.place_name")


def counts_snapshot(p: Column) -> Column:
    """The six counts as a JSON object, null where nothing is stated."""
    return F.to_json(F.struct(*[p["epidemiology"][c]["value"].alias(c) for c in COUNTS]), {"ignoreNullFields": "false"})


def record_extraction(signals: DataFrame, verdicts: DataFrame, demote: bool = True) -> DataFrame:
    """The next state of signals after verdicts (signal_id, reason, content): an accepted answer is stored with its version
    and brief; a rejected one fails the signal, unless a backfill (demote False) only tried to renew it."""
    v = verdicts.select("signal_id", F.lit(True).alias("_tried"), F.col("reason").alias("_reason"), stored(F.col("content")).alias("_p"))
    j = signals.join(v, "signal_id", "left")
    ok, bad = F.col("_tried") & F.col("_reason").isNull(), F.col("_tried") & F.col("_reason").isNotNull()
    status = F.when(F.coalesce(ok, F.lit(False)) & F.lit(demote), "extracted").when(F.coalesce(bad, F.lit(False)) & F.lit(demote), "failed").otherwise(F.col("status"))
    return j.withColumns({"status": status, "summary": F.when(ok, brief_text(F.col("_p"))).otherwise(F.col("summary")), "extraction_version": F.when(ok, VERSION).otherwise(F.col("extraction_version"))}).drop("_tried", "_reason", "_p")


def record_cluster_extraction(signals: DataFrame, members: DataFrame) -> DataFrame:
    """The next state of signals whose cluster (representative_id, signal_id) was extracted at once: the representative is
    extracted, the others are its duplicates."""
    j = signals.join(members, "signal_id", "left")
    lead = F.col("representative_id") == F.col("signal_id")
    return j.withColumns({"status": F.when(lead, "extracted").when(F.col("representative_id").isNotNull(), "duplicate").otherwise(F.col("status")), "duplicate_of": F.when(~lead, F.col("representative_id"))}).drop("representative_id")


def record_triage(signals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The next state of signals after verdicts (signal_id, valid, relevant, public_health, disease, country, admin1): an
    answer that did not validate leaves the signal to be taken again, an irrelevant one filters it. Blank and unknown
    facts are null, countries upper-case."""
    said = lambda c: F.when(~F.lower(F.btrim(c)).isin("", "unknown", "n/a", "none"), F.col(c))
    v = verdicts.select("signal_id", F.col("valid").alias("_valid"), F.col("relevant").alias("_relevant"), F.col("public_health").alias("_health"), said("disease").alias("_disease"), X.country_code(F.col("country")).alias("_country"), said("admin1").alias("_admin1"))
    j = signals.join(v, "signal_id", "left")
    ok = F.coalesce("_valid", F.lit(False))
    return j.select(
        *[F.col(c) for c in signals.columns if c not in ("status", "triage_status")],
        F.when(ok & ~F.col("_relevant"), "filtered").otherwise(F.col("status")).alias("status"),
        F.when(ok, "done").when(F.col("_valid").isNotNull(), "failed").otherwise(F.col("triage_status")).alias("triage_status"),
        F.when(ok, F.col("_health")).alias("public_health_relevant"), F.when(ok, F.col("_disease")).alias("triage_disease"), F.when(ok, F.col("_country")).alias("triage_country"), F.when(ok, F.col("_admin1")).alias("triage_admin1"),
    )


def disease_of(names: DataFrame, diseases: DataFrame, name: str = "name") -> DataFrame:
    """names with disease_id: of the disease (disease_id, canonical_name, synonyms) that is called so, without regard to
    case; null if none is or more than one."""
    d = diseases.select("disease_id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("_n")).select("disease_id", F.lower(F.btrim("_n")).alias("_n")).distinct()
    known = d.groupBy("_n").agg(F.min("disease_id").alias("disease_id"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    return names.join(known, F.lower(F.btrim(F.col(name))) == F.col("_n"), "left").drop("_n")
