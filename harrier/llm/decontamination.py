"""Benchmark decontamination: documents that hold an item of a benchmark, or nearly.

Nothing within the distance is missed. An item of m characters is cut into disjoint pieces of PIECE characters; an edit
spoils at most one of them, so of n pieces at least n - k stand unchanged in any text within k edits, and their places
differ from those in the item by amounts that lie within k of each other (each insertion or deletion shifts the rest by
one). So pieces found in a document are counted by item and by bins of that shift, 2 (k + 1) wide and overlapping by
half: first the rarest pieces of each item, sorted by bin, then all of them where those are enough. Where a bin has n - k
different pieces, the exact edit distance (bit-parallel, free ends in the document) decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.shared import documents

#: Largest edit distance, as a share of the item's characters.
EDIT_RATE = 0.15
#: Characters of a piece, and how many pieces an item should keep at least; shorter pieces for an item that would not.
PIECE = 5
KEPT = 4
#: Items (characters) that are searched for in one pass over the documents, and so broadcast; more items, more passes.
BLOCK_CHARS = 4_000_000
#: Pieces of an item that must be found by themselves, before the others are counted.
LEAST = 5
#: Counters of bins, each of which many bins share; and what is no slot.
COUNTERS, NOWHERE = 1 << 20, 0xFFFFFFFF
#: Text searched together, and pieces found at once (characters, numbers).
BATCH_CHARS = 1 << 18
HITS = 1 << 19


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_distance_within(pattern: str, text: str) -> int:
    """The least edit distance of pattern to any substring of text."""
    return _nearest(pattern, text)[0]


def _nearest(pattern: str, text: str, anchored: int | None = None) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text (Myers' bit vectors) and its first end; anchored: the
    first end of a prefix of text at that distance."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    if anchored == m:
        return m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | (anchored is not None)) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
        if score == anchored:
            return score, j
    return best, end


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of each run of size characters. Equal runs have equal hashes; a clash only adds a candidate."""
    n = max(0, len(codes) - size + 1)
    spread, x = codes * np.uint32(0x9E3779B1), np.zeros(n, np.uint32)
    for j in range(size):
        x = x * np.uint32(0x01000193) + spread[j : j + n]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


def piece_size(length: int, limit: int) -> int:
    """The longest piece, PIECE at most, of which an item within limit edits must keep KEPT, or else one."""
    sizes = range(PIECE, 1, -1)
    return next((q for kept in (KEPT, 1) for q in sizes if length // q - limit >= kept), 1)


class Pieces:
    """Items whose pieces are of one size: which items have a piece, and where.

    k edits spoil k pieces at most. So of the k + c rarest pieces of an item, c stand wherever it stands, and only these
    are looked for everywhere; all are counted where those have been found. How rare a piece is, the first texts that are
    searched tell: it decides how much is looked up, not what is found.
    """

    def __init__(self, size: int, items: list[int], texts: list[str], limits: list[int]):
        self.size, self.items = size, np.array(items)
        n = np.array([len(texts[i]) // size for i in items])
        self.limit, self.chars = np.array([limits[i] for i in items]), np.array([len(texts[i]) for i in items])
        self.need = n - self.limit
        self.least = np.minimum(self.need, LEAST)
        self.shift = 32 - min(22, max(10, int(64 * n.sum()).bit_length()))
        self.slot = np.concatenate([piece_hashes(codes_of(texts[i]), size)[::size] for i in items]) >> np.uint32(self.shift)
        self.owner = np.repeat(np.arange(len(items)), n)
        self.place = np.concatenate([np.arange(0, k * size, size) for k in n.tolist()])
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.first: np.ndarray | None = None

    def _choose(self, slot: np.ndarray) -> None:
        """The rarest pieces of each item, as lists by slot."""
        slots = 1 << (32 - self.shift)
        often = np.bincount(slot, minlength=slots)[self.slot]
        order = np.lexsort((often, self.owner))
        rank = np.arange(len(order)) - self.start[self.owner[order]]
        rare = order[rank < (self.limit + self.least)[self.owner[order]]]
        rare = rare[np.argsort(self.slot[rare], kind="stable")]
        self.rare = self.owner[rare]
        self.lead, self.width = (self.chars[self.rare] - self.place[rare]).astype(np.int32), (self.limit[self.rare] + 1).astype(np.int32)
        self.first = np.zeros(slots + 1, np.int32)
        np.cumsum(np.bincount(self.slot[rare], minlength=slots), out=self.first[1:])
        self.some = np.diff(self.first) > 0

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): the stretches of a text in which alone an item can stand within its limit."""
        slot = piece_hashes(codes, self.size) >> np.uint32(self.shift)
        if self.first is None:
            self._choose(slot)
        at = np.flatnonzero(self.some[slot]).astype(np.int32)
        begin = self.first[slot[at]]
        count = self.first[slot[at] + np.uint32(1)] - begin
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        # Bins of a shift are numbered from -chars on; before and after an item's bins one stays empty.
        base = np.concatenate([[0], np.cumsum((len(codes) + self.chars) // (self.limit + 1) + 4)])
        first_bin = base[self.rare] + 1
        found = []
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + HITS, "right")) - 1)
            c = count[lo:hi]
            entry = np.repeat(begin[lo:hi] - (total[lo:hi] - total[lo]).astype(np.int32), c) + np.arange(total[hi] - total[lo], dtype=np.int32)
            found.append((first_bin[entry] + (np.repeat(at[lo:hi], c) + self.lead[entry]) // self.width[entry], entry))
            lo = hi
        if not found:
            return []
        # Most bins have too few pieces even together with all that share their counters; the others are sorted. A piece
        # that stands several times in a bin counts once.
        bins, entry = (np.concatenate(x) for x in zip(*found))
        cell = bins % COUNTERS
        n = np.bincount(cell, minlength=COUNTERS)
        some = (n + np.maximum(np.roll(n, 1), np.roll(n, -1)) >= self.least.min())[cell]
        keys = np.sort(bins[some] * len(self.rare) + entry[some])
        if not len(keys):
            return []
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] // len(self.rare)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        bins, n = keys[new], np.diff(np.append(new, len(keys)))
        # Of two neighbouring bins with enough pieces together, one has half of them.
        half = n >= (int(self.least.min()) + 1) // 2
        bins_near = np.unique(np.concatenate([bins[half], bins[half] - 1]))
        own = np.searchsorted(base, bins_near, "right") - 1

        def held(x: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(bins, x), len(bins) - 1)
            return np.where(bins[i] == x, n[i], 0)

        enough = held(bins_near) + held(bins_near + 1) >= self.least[own]
        own, bins_near = own[enough], bins_near[enough]
        k, m = self.limit[own], self.chars[own]
        shift = (bins_near - base[own] - 1) * (k + 1) - m
        out: list[tuple[int, int, int]] = []
        for i, s, lo, hi in zip(own.tolist(), shift.tolist(), (shift - k).tolist(), (shift + 3 * k + 2 + m).tolist()):
            if self._stand(slot, i, s) < self.need[i]:
                continue
            if out and out[-1][0] == i and lo <= out[-1][2]:
                out[-1] = (i, out[-1][1], hi)
            else:
                out.append((i, lo, hi))
        return [(int(self.items[i]), lo, hi) for i, lo, hi in out]

    def _stand(self, slot: np.ndarray, i: int, shift: int) -> int:
        """How many of all pieces of an item stand in a text with a shift in the two bins from shift on."""
        own, width = self.slot[self.start[i] : self.start[i + 1]], 2 * (int(self.limit[i]) + 1)
        # Of each piece a row of the text, from its place on; what lies outside the text is no piece's slot.
        lo, hi = shift, shift + self.size * (len(own) - 1) + width
        text = np.full(hi - lo, NOWHERE, np.uint32)
        inside = slot[max(0, lo) : max(0, hi)]
        text[max(0, -lo) : max(0, -lo) + len(inside)] = inside
        rows = np.lib.stride_tricks.as_strided(text, (len(own), width), (self.size * text.itemsize, text.itemsize))
        return int((rows == own[:, None]).any(1).sum())


def best_place(pattern: str, text: str) -> tuple[int, int]:
    """(distance, start) of the substring of text nearest to pattern: the first end, then the nearest start."""
    distance, end = _nearest(pattern, text)
    _, back = _nearest(pattern[::-1], text[:end][::-1], distance)
    return distance, end - back


class Index:
    """A block of items, by the size of their pieces."""

    def __init__(self, ids: list[int], texts: list[str], rate: float):
        self.ids, self.texts = ids, texts
        self.limits = [int(rate * len(t)) for t in texts]
        self.reach = max((len(t) + k for t, k in zip(texts, self.limits)), default=0)
        own: dict[int, list[int]] = defaultdict(list)
        for i, (t, k) in enumerate(zip(texts, self.limits)):
            own[piece_size(len(t), k)].append(i)
        self.groups = [Pieces(size, items, texts, self.limits) for size, items in sorted(own.items())]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, distance) of each pair within the edit rate, at its best place."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        whole, starts = "\n".join(texts), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        codes = codes_of(whole)
        for lo in range(0, len(whole), BATCH_CHARS):  # each place within reach of a segment's start lies in it
            for g in self.groups:
                for i, a, b in g.candidates(codes[lo : lo + BATCH_CHARS + self.reach]):
                    self._decide(i, max(0, lo + a), min(len(whole), lo + b), texts, starts, best)
        return [(d, i, texts[d].count(" ", 0, s) + (texts[d][s : s + 1] == " "), e) for (d, i), (e, s) in sorted(best.items())]

    def _decide(self, i: int, lo: int, hi: int, texts: list[str], starts: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        pattern, limit = self.texts[i], self.limits[i]
        for d in range(max(0, int(np.searchsorted(starts, lo, "right")) - 1), min(len(texts), int(np.searchsorted(starts, hi)))):
            s = int(starts[d])
            a, b = max(0, lo - s), min(len(texts[d]), hi - s)
            if b - a < len(pattern) - limit:
                continue
            distance, at = best_place(pattern, texts[d][a:b])
            if distance <= limit and (distance, a + at) < best.get((d, i), (limit + 1, 0)):
                best[d, i] = distance, a + at


#: Ids and texts of items, and the edit rate.
Block = tuple[list[int], list[str], float]
FOUND = "doc_id long, item_id long, first_word long, distance int, item_chars int"


def _gathered(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and normal texts, some BATCH_CHARS characters together."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(column):
        rows.append(i)
        texts.append(normal(t.as_py()))
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _search(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*block)
        for rb in batches:
            for rows, texts in _gathered(rb.column(1)):
                got = index.search(texts)
                if got:
                    ids = rb.column(0).take(pa.array([rows[d] for d, *_ in got])).to_pylist()
                    cols = [ids, [index.ids[i] for _, i, *_ in got], [w for *_, w, _ in got], [e for *_, e in got], [len(index.texts[i]) for _, i, *_ in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "first_word", "distance", "item_chars"])

    return run


def blocks(items: DataFrame, rate: float, item_col: str = "item_id", item_text: str = "text") -> Iterator[Block]:
    """The items in blocks of BLOCK_CHARS characters, so what is broadcast is bounded; more items make more blocks. Tasks
    make their index of a block."""
    listed = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.trim("text") != "")
    ids, texts, size = [], [], 0
    for r in listed.orderBy("item_id", "text").toLocalIterator():
        t = normal(r.text)
        if ids and size + len(t) > BLOCK_CHARS:
            yield ids, texts, rate
            ids, texts, size = [], [], 0
        if t:
            ids.append(r.item_id)
            texts.append(t)
            size += len(t)
    yield ids, texts, rate


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, distance, item_chars) of the items that documents hold within rate * item length
    edits, after lower-casing and joining words by one space; one row per pair, its best place.

    Items without words are left out; those of the same text are each reported. Null or empty texts hold nothing; texts of
    any length are searched whole. Documents without id are searched, too, and rows of the same id each. Of places that are
    equally near, the first counts. Other columns are ignored; an empty table, or one without items, gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_search(block), FOUND) for block in blocks(items, rate, item_col, item_text)])


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, text_col: str = "text") -> DataFrame:
    """The rows of a table whose own text holds no item within rate * item length edits, all columns as they are. Each row
    is judged by itself: null and repeated ids make no difference."""
    at = docs.columns.index(text_col)

    def clean(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*block)
            for rb in batches:
                keep = np.ones(rb.num_rows, bool)
                for rows, texts in _gathered(rb.column(at)):
                    keep[[rows[d] for d, *_ in index.search(texts)]] = False
                yield rb.filter(pa.array(keep))

        return run

    for block in blocks(items, rate):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
