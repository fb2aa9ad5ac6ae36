"""Closed schemas over JSON: the path of the first fault of a value, at any depth.

A schema is made of the kinds below. Objects are closed: a key that is not declared is a fault. Faults are looked for in
this order: the kind of a value; undeclared keys in the order of their names; declared fields in theirs, each to its full
depth; items of a list from the first on. A fault reads "$.brief[2].text: long".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrier.functions import text as X


@dataclass(frozen=True)
class Text:
    """most: characters at most; among: what it must be one of; codes: the same for the text without outer white space and
    in lower case. Blank text is a fault unless blank is allowed, empty text unless empty is."""

    most: int | None = None
    among: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    blank: bool = False
    empty: bool = False


@dataclass(frozen=True)
class Whole:
    least: int | None = None


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Date:
    pass


@dataclass(frozen=True)
class Each:
    """A list of items; column: for lists of objects, the values that one field must have, item by item."""

    item: "Kind"
    column: tuple[str, tuple[str, ...]] | None = None


@dataclass(frozen=True)
class Object:
    """fields by name; those in required must be there and not null, those in solid may be missing but not null, others may
    be either."""

    fields: dict[str, "Kind"] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    solid: tuple[str, ...] = ()


Kind = Text | Whole | Number | Flag | Date | Each | Object

def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_fault(value: Column, kind: Kind, at: Column | str = "$") -> Column:
    """The path of the first fault of a Variant and what it is, null if there is none. Words: kind, blank, long, form,
    value, range, unknown, missing, null, order."""
    at, nothing = F.lit(at) if isinstance(at, str) else at, F.lit(None).cast("string")
    get = lambda to: F.try_variant_get(value, "$", to)
    fault = lambda bad, word, where=at: F.when(F.coalesce(bad, F.lit(True)), F.concat(where, F.lit(f": {word}")))
    if isinstance(kind, Each):
        return _let(get("array<variant>"), lambda items: F.coalesce(*_item_faults(items, kind, at, fault)))
    if isinstance(kind, Object):
        return _let(get("map<string,variant>"), lambda members: F.coalesce(*_member_faults(members, kind, at, fault, nothing)))
    is_ = F.schema_of_variant(value)
    number = is_.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if isinstance(kind, Text):
        t = get("string")
        checks = [fault(is_ != "STRING", "kind")]
        checks += [fault((t if kind.blank else X.collapse(t)) == "", "blank")] if not kind.empty else []
        checks += [fault(F.length(t) > kind.most, "long")] if kind.most else []
        checks += [fault(~F.lower(F.btrim(t)).isin(*kind.codes), "value")] if kind.codes else []
        checks += [fault(~t.isin(*kind.among), "value")] if kind.among else []
        return F.coalesce(*checks)
    if isinstance(kind, Whole):
        checks = [fault(~number | (get("double") != F.floor(get("double"))), "kind")]
        return F.coalesce(*checks, *([fault(get("double") < kind.least, "range")] if kind.least is not None else []))
    if isinstance(kind, Number):
        checks = [fault(~number, "kind")]
        checks += [fault(get("double") < kind.least, "range")] if kind.least is not None else []
        checks += [fault(get("double") > kind.most, "range")] if kind.most is not None else []
        return F.coalesce(*checks)
    if isinstance(kind, Flag):
        return F.coalesce(fault(is_ != "BOOLEAN", "kind"))
    return F.coalesce(fault(is_ != "STRING", "kind"), fault(F.try_to_date(get("string"), "yyyy-MM-dd").isNull(), "form"))


def _item_faults(items: Column, kind: Each, at: Column, fault: Callable) -> list[Column]:
    inner = F.transform(items, lambda x, i: first_fault(x, kind.item, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
    checks = [fault(items.isNull(), "kind"), F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0))]
    if kind.column:
        name, wanted = kind.column
        checks.append(fault(F.transform(items, lambda x: F.try_variant_get(x, f"$.{name}", "string")) != F.array(*map(F.lit, wanted)), "order"))
    return checks


def _member_faults(members: Column, kind: Object, at: Column, fault: Callable, nothing: Column) -> list[Column]:
    strange = F.array_except(F.map_keys(members), F.array(*map(F.lit, kind.fields)).cast("array<string>"))
    checks = [fault(members.isNull(), "kind"), F.concat(at, F.lit("."), F.array_min(strange), F.lit(": unknown"))]
    for name, inner in kind.fields.items():
        where = F.concat(at, F.lit(f".{name}"))
        missing = F.concat(where, F.lit(": missing")) if name in kind.required else nothing
        null = F.concat(where, F.lit(": null")) if name in kind.required + kind.solid else nothing
        # A null member is an SQL null in the map, as a missing one is; its key tells them apart.
        absent = F.when(F.map_contains_key(members, name), null).otherwise(missing)
        checks.append(_let(F.element_at(members, name), _member(inner, where, absent)))
    return checks


def _member(kind: Kind, where: Column, absent: Column) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNull() | F.is_variant_null(x), absent).otherwise(first_fault(x, kind, where))


def json_fault(content: Column, kind: Kind) -> Column:
    """first_fault of JSON text; "$: not_json" if it is none, or if an object has a key twice."""
    return _let(F.try_parse_json(content), lambda v: F.when(v.isNull(), "$: not_json").otherwise(first_fault(v, kind)))
