"""Text expressions: hashes, URL and title forms, token sets, shingles, similarity. Native unless Unicode forms are needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

#: Tracking parameters dropped from URLs.
TRACKING_PREFIX, TRACKING_NAMES = "utm_", ("gclid", "fbclid")
#: White space as Python's str.split sees it within the Basic Latin and Latin-1 range, and the general spaces.
BLANKS = r"[\s\u0085   -     　\u001C-\u001F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a lambda's own variables are, the expressions it encloses are not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, BLANKS, " "))


def _form(kind: str | None, folded: bool):
    @pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else (lambda x: x.casefold() if folded else x)(unicodedata.normalize(kind, t) if kind else t))

    return run


def _only(c: Column, needed: Column, udf) -> Column:
    """udf of c where it is needed; other rows send it a null, not their text."""
    return F.when(needed, udf(F.when(needed, c))).otherwise(c)


def nfc(c: Column) -> Column:
    """NFC, with the UDF only where a text has a character beyond Latin-1 letters that could compose."""
    return _only(c, c.rlike(r"[̀-￿]"), _form("NFC", False))


def nfkc(c: Column) -> Column:
    """NFKC; ASCII is its own form."""
    return _only(c, c.rlike(r"[^\x00-\x7F]"), _form("NFKC", False))


@lru_cache(maxsize=1)
def _folds_apart() -> str:
    """The characters whose case folding is not their lower case, sigma and its final form among them; by rule."""
    odd = [chr(i) for i in range(0x110000) if 0xFF < i and not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i).lower()]
    return "[Σ" + re.escape("".join(odd)) + "]"


def latin_fold(c: Column) -> Column:
    """Case folding of Latin-1 text: lower case, sharp s as ss. The form for lambdas, where no UDF can stand."""
    return F.replace(F.translate(F.lower(c), "µ", "μ"), F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """Case folding: that of Latin text, and the UDF for texts with any other character that folds further."""
    odd = c.rlike(r"[^\x00-\xFF]") & c.rlike(_folds_apart())
    return F.when(odd, _form(None, True)(F.when(odd, c))).otherwise(latin_fold(c))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the normalised title and body with a unit separator between; a null body counts as empty."""
    return F.sha2(F.concat(collapse(nfc(title)), F.lit("\x1f"), collapse(nfc(F.coalesce(body, F.lit(""))))), 256)


def hash_holds(title: Column, body: Column, stored: Column) -> Column:
    return F.coalesce((stored != "") & (content_hash(title, body) == stored), F.lit(False))


def _decoded(c: Column) -> Column:
    """A query name or value without its escapes; a percent sign that begins none stays."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    """Escaped as in a form: blanks as plus, letters, digits and _.-~ as they are."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(c), "\\*", "%2A"), "%7E", "~")


def canonical_url(u: Column) -> Column:
    """Scheme and host lower-case, no fragment, no trailing slash; the query's pairs decoded, tracking ones dropped, the
    rest sorted by name and value and encoded again."""
    u = F.btrim(u)
    head = F.lower(F.regexp_extract(u, r"^([^:/?#]+://[^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)

    def pair(p: Column) -> Column:
        value = F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(value).alias("value"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["name"]), F.lit(TRACKING_PREFIX)) & ~F.lower(p["name"]).isin(*TRACKING_NAMES))
    tail = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(head, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))


def masthead_title(title: Column) -> Column:
    """A headline without the publisher's name behind a spaced separator, punctuation removed, folded."""
    t = F.regexp_replace(nfkc(title), r"\s[-|–—]\s[^-|–—]{1,40}$", "")
    return fold(collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", "")))


def title_tokens(title: Column) -> Column:
    """The set of words of a title, sorted; a tail of at most six words behind a dash is dropped."""
    t = fold(nfc(title))
    tail = F.regexp_extract(t, r"^(.*) [-–—] (.*)$", 2)
    short = (tail != "") & (F.size(F.split(collapse(tail), " ")) <= 6)
    t = F.when(short, F.regexp_extract(t, r"^(.*) [-–—] (.*)$", 1)).otherwise(t)
    words = F.split(collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def _split_words(body: Column) -> Column:
    return F.filter(F.split(collapse(fold(nfc(body))), " "), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(many)

    return let(words, of)


def shingles(body: Column, size: int = 5) -> Column:
    """Distinct word n-grams of the folded text, words being what white space separates; a shorter text is one shingle;
    none for a blank one."""
    return F.array_distinct(_grams(_split_words(body), size))


def shingle_hashes(body: Column, size: int = 5) -> Column:
    """The shingles as sorted distinct 64-bit hashes: an eighth of the bytes, and enough to compare two texts."""
    return F.array_sort(F.array_distinct(F.transform(_grams(_split_words(body), size), lambda g: F.xxhash64(g))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 times the share of characters kept by insertions and deletions only; prune by length before calling."""
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * _common_subsequence(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(ArrayType(IntegerType()))
def character_counts(t: pd.Series) -> pd.Series:
    """How many characters of a text are in each of 32 classes; an insertion or deletion changes one count by one."""
    return t.map(lambda x: None if x is None else np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32).astype(np.int32))


def near_exact_title(t1: Column, t2: Column, p1: Column, p2: Column, least: float = 92.0, hours: int = 48) -> Column:
    """Titles alike but not equal, published close together. The length bound keeps most pairs from the UDF."""
    n1, n2 = F.length(t1), F.length(t2)
    can = 200.0 * F.least(n1, n2) / (n1 + n2) >= least
    close = F.abs(F.unix_micros(p1) - F.unix_micros(p2)) <= hours * 3_600_000_000
    r = F.when(can & close & (t1 != t2), indel_ratio(t1, t2))
    return F.coalesce((r >= least) & (r < 100), F.lit(False))


def place_form(c: Column, folded: Callable[[Column], Column] = fold) -> Column:
    """A place name for look-up: punctuation and symbols blank, folded, collapsed."""
    return collapse(folded(F.regexp_replace(c, r"[\p{P}\p{S}]", " ")))


@pandas_udf(StringType())
def _unaccent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def ascii_form(c: Column) -> Column:
    p = place_form(c)
    return F.when(p.rlike(r"[^\x00-\x7F]"), _unaccent(p)).otherwise(p)


def cache_key(c: Column) -> Column:
    return F.lower(collapse(c))


def truncate_words(c: Column, limit: int) -> Column:
    """At most limit characters, cut at the last blank if there is one after the first character."""
    cut = F.substring(c, 1, limit)
    at_blank = F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(c) <= limit, c).when(at_blank != "", at_blank).otherwise(cut)


def country_code(c: Column) -> Column:
    """Two upper-case letters or null."""
    v = F.upper(F.btrim(c))
    return F.when(v.rlike("^[A-Z]{2}$"), v)


def private_text(c: Column) -> Column:
    """Does a text hold an e-mail address, a telephone number or a run of nine digits? Patterns are fixed values."""
    return c.rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+") | c.rlike(r"\+\d[\d\s().-]{7,}\d|\b\d[\d\s().-]{8,}\d\b") | c.rlike(r"\d{9,}")


def embedding_text(title: Column, body: Column, most: int = 1200) -> Column:
    """What an embedding is made of: the title and the beginning of the body."""
    return F.concat(title, F.lit("\n"), F.substring(body, 1, most))


def point_text(longitude: Column, latitude: Column) -> Column:
    """A point as well-known text, null without both coordinates."""
    return F.when(longitude.isNotNull() & latitude.isNotNull(), F.concat(F.lit("POINT("), longitude.cast("string"), F.lit(" "), latitude.cast("string"), F.lit(")")))


def listing(items: Column, line: Callable[[Column, Column], Column]) -> Column:
    """A numbered list for a prompt: line(item, number from 1) of each item of an array, one to a line."""
    return F.array_join(F.transform(items, lambda x, i: line(x, (i + 1).cast("string"))), "\n")


def spaced(c: Column) -> Column:
    """An enumeration's name for readers."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def exception_name(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"), c)


def disease_identity(disease_id: Column, disease_text: Column) -> Column:
    """id: and the id, else text: and the folded text, else null."""
    text = fold(collapse(disease_text))
    return F.coalesce(F.concat(F.lit("id:"), disease_id), F.when(text != "", F.concat(F.lit("text:"), text)))


def public_id(key: Column) -> Column:
    return F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(key, 256), 1, 8)))


def slug(key: Column) -> Column:
    return F.concat(F.lit("event-"), F.substring(F.sha2(key, 256), 1, 10))
