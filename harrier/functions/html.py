"""HTML to text, in pandas UDFs over Arrow batches: markup needs a parser, not a pattern.

A page is read once into a list of events (open, close, text); what is wanted of it is then taken from that list.
Character references are read as a browser reads them, also without their semicolon. Where a caller names references, those
with their semicolon are read and all others stay as they are written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType, TimestampType

#: Tags that separate words, whose text is skipped, and that hold no article text.
BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "thead", "tbody", "section", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
SILENT = {"script", "style"}
ASIDE = SILENT | {"nav", "header", "footer", "aside", "form"}
#: Where a page says when it was published.
DATE_META = ("article:published_time", "og:article:published_time", "datepublished", "date", "pubdate", "publish-date", "dc.date.issued")
DATE_KEYS = ("datePublished", "dateCreated")
PAGE = StructType().add("title", StringType()).add("site_name", StringType()).add("published_at", TimestampType()).add("offset_minutes", IntegerType()).add("dates", ArrayType(StringType())).add("body", StringType())

OPEN, CLOSE, TEXT = "open", "close", "text"


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((OPEN, tag, {k.lower(): v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.seen.append((CLOSE, tag, {}))

    def handle_data(self, data):
        self.seen.append((TEXT, data, {}))


def events(html: str, written: bool = False) -> list[tuple[str, str, dict]]:
    """written: texts and attributes as they are written, references unread."""
    p = _Events()
    p.feed(html.replace("&", "&amp;") if written else html)
    p.close()
    return p.seen


def collapsed(parts: list[str], references: tuple[str, ...] | None = None) -> str:
    """references: those that are still to be read."""
    text = "".join(parts)
    if references:
        text = re.sub(f"&({'|'.join(references)});", lambda m: html5[f"{m[1]};"], text)
    return " ".join(text.split())


def _words(stream: list[tuple[str, str, dict]], references: tuple[str, ...] | None = None) -> str:
    """The text of a stretch of events, block tags as blanks, without scripts and styles."""
    out, silent = [], 0
    for kind, what, _ in stream:
        if kind == TEXT:
            if not silent:
                out.append(what)
        elif what in SILENT:
            silent = max(0, silent + (1 if kind == OPEN else -1))
        elif what in BLOCK:
            out.append(" ")
    return collapsed(out, references)


def _regions(stream: list[tuple[str, str, dict]], tag: str, attribute: str, token: str) -> Iterator[list[tuple[str, str, dict]]]:
    """The stretches inside elements of a tag whose attribute has a token; inner elements of the tag belong to them."""
    depth, first = 0, 0
    for i, (kind, what, attrs) in enumerate(stream):
        if what != tag or kind == TEXT:
            continue
        if kind == OPEN and (depth or token in attrs.get(attribute, "").split()):
            depth, first = depth + 1, first if depth else i + 1
        elif kind == CLOSE and depth:
            depth -= 1
            if not depth:
                yield stream[first:i]


def _linked_dates(x) -> Iterator[str]:
    if isinstance(x, list):
        for v in x:
            yield from _linked_dates(v)
    elif isinstance(x, dict):
        for k, v in x.items():
            if k in DATE_KEYS and isinstance(v, str):
                yield v
            else:
                yield from _linked_dates(v)


def _dates_of_json(text: str) -> list[str]:
    """Dates anywhere in a JSON document, in order; none in one that cannot be read."""
    try:
        return list(_linked_dates(json.loads(text)))
    except ValueError:
        return []


def stated_time(text: str) -> tuple[datetime, int | None] | None:
    """(time, stated offset in minutes) of an ISO time; a naive one is UTC and states none."""
    text = text.strip()
    try:
        t = datetime.fromisoformat(f"{text[:-1]}+00:00" if text[-1:] in ("Z", "z") else text)
    except ValueError:
        return None
    return (t.replace(tzinfo=UTC), None) if t.tzinfo is None else (t, int(t.utcoffset().total_seconds() // 60))


def text_of(html: str | None, references: tuple[str, ...] | None = None) -> str | None:
    return None if html is None else _words(events(html, references is not None), references)


def regions_of(html: str | None, tag: str, token: str, attribute: str = "class") -> str | None:
    """The texts of all regions, a blank line between; empty without any."""
    return None if html is None else "\n\n".join(t for t in map(_words, _regions(events(html), tag, attribute, token)) if t)


def page_of(html: str | None, references: tuple[str, ...] | None = None) -> tuple:
    """(title, site name, published, offset, candidate dates in document order, body). What stands in scripts, styles,
    navigation, headers, footers, asides and forms does not count, but for linked data. references: those that are read in
    title and site name, none then in dates and body."""
    if html is None:
        return None, None, None, None, [], None
    meta: dict[str, str] = {}
    dates, title, body, linked = [], [], [], None
    aside = paragraph = 0
    in_title = False
    written = references is not None
    for kind, what, attrs in events(html, written):
        if kind == TEXT:
            if linked is not None:
                linked.append(what)
            elif not aside:
                title += [what] if in_title else []
                body += [what] if paragraph else []
        elif what == "script" and (linked is not None if kind == CLOSE else attrs.get("type", "").lower() == "application/ld+json"):
            dates += _dates_of_json("".join(linked).replace("&amp;", "&") if written else "".join(linked)) if kind == CLOSE else []
            linked = None if kind == CLOSE else []
        elif what in ASIDE:
            aside = max(0, aside + (1 if kind == OPEN else -1))
        elif kind == CLOSE:
            in_title = in_title and what != "title"
            if what == "p" and paragraph:
                paragraph -= 1
                body.append(" ")
        elif aside:
            continue
        elif what == "meta" and attrs.get("content"):
            name = (attrs.get("property") or attrs.get("name") or "").lower()
            meta[name] = attrs["content"]
            dates += [attrs["content"]] if name in DATE_META else []
        elif what == "time":
            dates += [attrs["datetime"]] if attrs.get("datetime") else []
        elif what == "title":
            in_title = True
        elif what == "p":
            paragraph += 1
            body.append(" ")
    at, offset = next((t for t in map(stated_time, dates) if t), (None, None))
    name = lambda parts: collapsed(parts, references) or None
    return name([meta.get("og:title") or "".join(title)]), name([meta.get("og:site_name", "")]), at, offset, dates, collapsed(body)


def strip_html_reading(references: tuple[str, ...] | None):
    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: text_of(t, references))

    return run


strip_html = strip_html_reading(None)


def strip_html_within(tag: str, token: str, attribute: str = "class"):
    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: regions_of(t, tag, token, attribute))

    return run


def extract_page_reading(references: tuple[str, ...] | None):
    @pandas_udf(PAGE)
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([page_of(t, references) for t in s], columns=["title", "site_name", "published_at", "offset_minutes", "dates", "body"])
        return out.assign(published_at=pd.to_datetime(out["published_at"], utc=True), offset_minutes=out["offset_minutes"].astype("Int32"))

    return run


extract_page = extract_page_reading(None)
