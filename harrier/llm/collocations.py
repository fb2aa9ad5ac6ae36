"""Phrases whose words keep together: collocations of two to four words, by language.

1. Texts of one language are packed into batches, a line each, so that a line end separates documents as it does pieces.
2. The different words of each batch are counted over all batches; words of LEAST occurrences or more get numbers (no
   phrase that is frequent enough has another), and each batch gets back those of its own words.
3. A batch becomes a row of numbers, broken at piece ends and where a word has no number. Each place gives one key of
   fixed width: the numbers of the words from there on, WORDS of them, zeros where the row breaks. Equal keys are counted
   within the batch.
4. Keys travel in blocks, cut at the bounds of ranges of equal load; a range is sorted by radix, and as phrases of every
   length are the beginnings of keys, run lengths of equal beginnings are their counts. Runs at a range's ends may go on in
   the next; those alone are summed once more.
5. What remains is joins between the counts of phrases and of their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.batches import rows_of
from harrier.llm.hashing import LOWER
from harrier.llm.prefix_trie import dense_names
from harrier.llm.shared import Scratch, documents, parts

#: Longest phrase; keys are as wide.
WORDS = 4
LEAST = 30
TOP = 2000
#: A candidate goes if a longer one around it has this share (in hundredths) of its occurrences.
SHARE = 80
UNKNOWN = "und"
BATCH_BYTES = 6 << 20
#: What ends a piece, and what separates its words.
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
#: Bits of a number; numbers stay below 2^31, so that two of them are a signed 64-bit integer.
ID_BITS = 32
#: Keys of a block, of the load of a range, and those that are merged at once; keys of a block that are shown to place bounds.
BLOCK, RANGE, MERGED, SHOWN = 1 << 16, 1 << 20, 1 << 21, 8
BATCHES = "batch long, lang string, size long, data binary"
ENTRIES = "batch long, lang string, word string, local int, n long"
BLOCKS = "keys binary, counts binary, n long, shown array<long>"
SLICES = "range int, keys binary, counts binary"
RUNS = "gram binary, size int, n long, whole boolean"


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches of about BATCH_BYTES, cut at piece ends."""
    lo = 0
    while len(text) - lo > BATCH_BYTES:
        cut = BREAK.search(text, lo + BATCH_BYTES)
        if not cut:
            break
        yield text[lo : cut.start()]
        lo = cut.end()
    yield text[lo:]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one language each. Whatever the number of languages, BATCH_BYTES are held, or the longest text."""
    number, held, size = TaskContext.get().partitionId() << 32, {}, 0

    def batch(lang: str) -> pa.RecordBatch:
        nonlocal number
        data = b"\n".join(held.pop(lang))
        row = ([number], [lang], [len(data)], [zstandard.ZstdCompressor(level=1).compress(data)])
        number += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["batch", "lang", "size", "data"])

    for rb in batches:
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1)):
            for part in _stretches(LOWER[np.frombuffer(text.as_buffer(), np.uint8)].tobytes()):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size > BATCH_BYTES:  # the language with most goes
                    most = max(held, key=lambda x: sum(map(len, held[x])))
                    size -= sum(len(p) + 1 for p in held[most])
                    yield batch(most)
    for lang in list(held):
        yield batch(lang)


class Pieces:
    """The words of a batch: which of its different words each is, and the piece that it is in."""

    def __init__(self, row: dict):
        text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=row["size"] + 1), np.uint8)
        kind = _KIND[text]
        word = np.concatenate([[0], kind == 0, [0]]).astype(np.int8)
        step = np.diff(word)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[kind == 0]))
        coded = words.dictionary_encode()
        self.local, self.different = np.asarray(coded.indices), coded.dictionary

    def keys(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of two 64-bit halves, their counts) of the places where two words with a number stand together. numbers:
        of the batch's different words, 0 for none."""
        ids = numbers[self.local]
        joined = (ids[:-1] > 0) & (ids[1:] > 0) & (self.piece[:-1] == self.piece[1:])
        at = np.flatnonzero(joined)
        padded, links = np.append(ids, np.zeros(WORDS, np.uint64)), np.append(joined, np.zeros(WORDS, bool))
        third = links[at + 1]
        fourth = third & links[at + 2]
        shift = np.uint64(ID_BITS)
        high = padded[at] << shift | padded[at + 1]
        low = np.where(third, padded[at + 2], 0) << shift | np.where(fourth, padded[at + 3], 0)
        return _summed(np.stack([high, low], 1), np.ones(len(at), np.int64))


def _radix_order(pairs: np.ndarray) -> np.ndarray:
    """The order of keys (rows of two 64-bit halves), by stable counting passes over 16 bits, the last ones first; passes
    in which all keys are alike are left out."""
    order = None
    for half in (1, 0):
        for shift in range(0, 64, 16):
            digit = ((pairs[:, half] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(pairs)) if order is None else order


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = _radix_order(pairs)
    pairs = pairs[order]
    new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])) if len(pairs) else np.empty(0, np.int64)
    return pairs[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each batch, and how often it has them."""
    for row in rows_of(batches):
        p = Pieces(row)
        n = len(p.different)
        counts = np.bincount(p.local, minlength=n) if n else np.empty(0, np.int64)
        for lo in range(0, n, 50_000):
            k = min(50_000, n - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, row["batch"])), pa.array([row["lang"]] * k), p.different.slice(lo, k).cast(pa.string()), pa.array(np.arange(lo, lo + k, dtype=np.int32)), pa.array(counts[lo : lo + k])],
                names=["batch", "lang", "word", "local", "n"],
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for i in range(rb.num_rows):
            row = {c: rb.column(c)[i].as_py() for c in ("size", "data")}
            p, own = Pieces(row), rb.column("own")[i].values
            numbers = np.zeros(max(1, len(p.different)), np.uint64)
            if own is not None and len(own):
                numbers[np.asarray(own.field("local"))] = np.asarray(own.field("id")).astype(np.uint64)
            pairs, counts = p.keys(numbers)
            for lo in range(0, len(pairs), BLOCK):
                part, n = pairs[lo : lo + BLOCK], counts[lo : lo + BLOCK]
                shown = part[(len(part) * np.arange(1, 2 * SHOWN, 2)) // (2 * SHOWN), 0].astype(np.int64)
                row = ([part.tobytes()], [n.astype("<u4").tobytes()], [len(part)], [shown.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], names=["keys", "counts", "n", "shown"])


def bounds_of(cuts: list[int], most: int) -> np.ndarray:
    """First keys of ranges after the first, from cuts of equal load by the first half of a key. Where one half takes
    several shares, its keys are cut evenly by their second half; most: the largest number of a word."""
    out = []
    for high in sorted(set(cuts)):
        share = cuts.count(high) if len(cuts) < 1000 else int(np.searchsorted(cuts, high, "right") - np.searchsorted(cuts, high))
        out += [(high, (most + 1) * i // share << ID_BITS) for i in range(share)]
    return np.array(out, np.uint64).reshape(-1, 2)


def _below(pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each bound: how many of the sorted keys are below it."""
    lo, hi = np.searchsorted(pairs[:, 0], bounds[:, 0], "left"), np.searchsorted(pairs[:, 0], bounds[:, 0], "right")
    for i in np.flatnonzero(hi > lo).tolist():
        lo[i] += np.searchsorted(pairs[lo[i] : hi[i], 1], bounds[i, 1], "left")
    return lo


def _sliced(bounds: np.ndarray):
    """Blocks of keys cut at the bounds of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            pairs = np.frombuffer(row["keys"], np.uint64).reshape(-1, 2)
            cuts = np.concatenate([[0], _below(pairs, bounds), [len(pairs)]])
            some = np.flatnonzero(np.diff(cuts))
            keys, counts = memoryview(row["keys"]), memoryview(row["counts"])
            cols = [[bytes(keys[16 * cuts[i] : 16 * cuts[i + 1]]) for i in some], [bytes(counts[4 * cuts[i] : 4 * cuts[i + 1]]) for i in some]]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["range", "keys", "counts"])

    return run


def _runs(least: int):
    """Counts of equal beginnings of each range's keys; rows are sorted by range. Keys are merged as they come, so that
    what is held is a range's different keys and MERGED others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        for rb in batches:
            for r, keys, counts in zip(rb.column("range").to_pylist(), rb.column("keys"), rb.column("counts")):
                if r != now and held:
                    yield from _beginnings(*merged(), least)
                    held, waiting = [], 0
                now = r
                held.append((np.frombuffer(keys.as_buffer(), np.uint64).reshape(-1, 2), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)))
                waiting += len(held[-1][1])
                if waiting > MERGED:
                    held, waiting = [merged()], 0
        if held:
            yield from _beginnings(*merged(), least)

    return run


def _beginnings(pairs: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of a range's different keys, in order: all of least occurrences or more, and those that the range's first or
    last key begins with, which may go on in another range."""
    for size in range(2, WORDS + 1):
        half, mask = pairs[:, 1], np.uint64(0xFFFFFFFF << ID_BITS & 0xFFFFFFFFFFFFFFFF)
        low = np.zeros_like(half) if size == 2 else half & mask if size == 3 else half
        new = np.flatnonzero(np.concatenate([[True], (pairs[1:, 0] != pairs[:-1, 0]) | (low[1:] != low[:-1])]))
        total = np.add.reduceat(n, new)
        edge = np.zeros(len(new), bool)
        edge[[0, -1]] = True
        own = low[new] & np.uint64(0xFFFFFFFF) if size == 4 else low[new] >> np.uint64(ID_BITS) if size == 3 else pairs[new, 0]
        keep = np.flatnonzero(((total >= least) | edge) & (own > 0))
        if len(keep):
            grams = np.stack([pairs[new[keep], 0], low[new[keep]]], 1).astype(">u8").tobytes()
            gram = pa.Array.from_buffers(pa.binary(16), len(keep), [None, pa.py_buffer(grams)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([gram, pa.array(np.full(len(keep), size, np.int32)), pa.array(total[keep]), pa.array(~edge[keep])], names=["gram", "size", "n", "whole"])


def counted_phrases(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, id, n; phrases: gram, size, n; totals: lang, n). words and phrases have least occurrences or
    more; gram is the numbers of a phrase's words, four bytes each, zeros behind; totals counts all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    batches = scratch.table(rows.mapInArrow(_packed, BATCHES), "batches", "none")
    entries = scratch.table(batches.mapInArrow(_entries, ENTRIES), "entries", "zstd")
    totals = scratch.table(entries.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = scratch.table(entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    words = scratch.table(dense_names(frequent, scratch).select("lang", "word", F.expr("name + 1").alias("id"), "n"), "words")
    n_words = words.count()
    if n_words >= 1 << ID_BITS - 1:
        raise ValueError(f"more words than numbers of {ID_BITS - 1} bits")
    own = entries.select("batch", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"])
    own = own.groupBy("batch").agg(F.collect_list(F.struct("local", "id")).alias("own"))
    blocks = scratch.table(batches.join(own, "batch").select("size", "data", "own").mapInArrow(_keys, BLOCKS), "keys", "zstd")
    scratch.drop(entries)
    scratch.drop(batches)
    scratch.free()
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(2 * parts(spark), -(-total // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = blocks.select(F.explode("shown").alias("h")).agg(F.percentile_approx("h", shares, max(10_000, 20 * ranges))).first()[0] or []
    sliced = blocks.mapInArrow(_sliced(bounds_of(cuts, n_words)), SLICES)
    ordered = sliced.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    runs = scratch.table(ordered.mapInArrow(_runs(least), RUNS), "runs")
    scratch.drop(blocks)
    scratch.free()
    cut = runs.where("NOT whole").groupBy("gram", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, scratch.table(runs.where("whole").select("gram", "size", "n").unionByName(cut), "phrases"), totals


def _part(first: str, size: str) -> str:
    """SQL of a part of gram: size words from word first (0: the first) on, zeros behind."""
    return f"rpad(substring(gram, 4 * ({first}) + 1, 4 * ({size})), {4 * WORDS}, X'00')"


def collocations(spark: SparkSession, docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's phrases of two to four words that keep together best: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; pieces end at [.,;:!?\\x0A-\\x0D], words at blanks and tabs. a: occurrences of the phrase within
    pieces, overlaps included, least or more; cut in two, the parts have l and r; score: 2000000 a / (l + r), rounded down,
    at the cut that makes it least (the first of such); n: words of the language. A phrase inside a longer one that has
    share hundredths of its occurrences or more is left out. Rank: by score, then a (both descending), then the bytes of
    the phrase.

    A null language is "und", as is that name itself. Null and empty texts have no words; repeated rows count as often as
    they are there; a text of any length is counted whole. An empty table, or one without frequent phrases, gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(spark, "phrases")
    words, phrases, totals = counted_phrases(spark, docs, scratch, least, text_col, lang_col)
    number = F.expr("cast(conv(hex(substring(gram, 1, 4)), 16, 10) AS long)")
    single = words.select(F.expr(f"rpad(unhex(lpad(hex(id), 8, '0')), {4 * WORDS}, X'00')").alias("gram"), "n")
    counts = single.unionByName(phrases.where(F.col("size") < WORDS).select("gram", "n"))
    # Of every cut: the counts of both parts.
    cuts = phrases.withColumnRenamed("n", "a").withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    halves = cuts.select("gram", "size", "a", "k", F.expr(_part("0", "k")).alias("x"), F.expr(_part("k", "size - k")).alias("y"))
    scored = halves.join(counts.select(F.col("gram").alias("x"), F.col("n").alias("l")), "x").join(counts.select(F.col("gram").alias("y"), F.col("n").alias("r")), "y")
    score = F.expr("cast(2000000 AS decimal(8, 0)) * cast(a AS decimal(19, 0)) DIV cast(l + r AS decimal(19, 0))").alias("score")
    scored = scored.select("gram", "size", "a", score, "k", "l", "r").groupBy("gram", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Of every phrase that lies in a longer one: the most occurrences of such.
    inner = phrases.where("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(0, size - m)")))
    around = inner.select(F.expr(_part("at", "m")).alias("gram"), "n").groupBy("gram").agg(F.max("n").alias("longer"))
    kept = scored.join(around, "gram", "left").where(F.expr(f"longer IS NULL OR 100 * longer < {share} * a"))
    placed = kept.withColumn("first", number).join(words.select(F.col("id").alias("first"), "lang"), "first").select("lang", "gram", "size", "a", "cut")
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc())
    # Those that may be among the first, ties with the last of them included; then their words.
    placed = scratch.table(placed.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= top).drop("_r"), "best")
    spelled = placed.withColumn("at", F.explode(F.expr("sequence(0, size - 1)"))).withColumn("id", F.expr("cast(conv(hex(substring(gram, 4 * at + 1, 4)), 16, 10) AS long)"))
    spelled = spelled.join(words.select("id", "word"), "id").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = placed.join(spelled, "gram").select("*", F.array_join("w.word", " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").cast("binary"))
    ranked = named.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, documents(spark, sf_dir))


#: Phrases as lists of words.
ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - s + 2), lambda i: w[i:i + s - 1])) AS g FROM p, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM g WHERE len(g) >= 2),
s AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, list_slice(g, u, u + m - 1) AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS u FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS m FROM g WHERE len(g) >= 3)) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
