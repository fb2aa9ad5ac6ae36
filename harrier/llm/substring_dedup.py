"""Substring deduplication over words, by level-wise doubling.

Windows of a short length that only one document has are dropped; where two neighbouring windows survive, the window of
(up to) twice the length that they make up is the next level's candidate, until the wanted length is reached. The first
levels count 32-bit keys in an exchange (a false survivor costs a little work), the last one compares 96-bit hashes and
the least document id that has each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.batches import ENTRY_SCHEMA, NO_ID, Keys, batches_of, buckets_of, count_keys, each, entries_table, unpack, with_answers
from harrier.llm.hashing import Bag
from harrier.llm.shared import Scratch, documents, text_rows

WINDOW = 13
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,words:int>>"


def levels_to(window: int, first: int = 7) -> list[int]:
    """Two lengths or more up to window, each at most twice the one before; the first is first words or fewer."""
    out = [window]
    while len(out) < 2 or out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _level_keys(bag: Bag, size: int, alive: np.ndarray, known: np.ndarray, buckets: int) -> tuple[np.ndarray, Keys]:
    """The windows of a level whose first word is alive, and their keys."""
    at, doc, h = bag.windows(size)
    keep = alive[at] & known[doc]
    at, doc, h = at[keep], doc[keep], h[keep]
    return at, Keys(h, doc, buckets)


def _extend(alive: np.ndarray, have: int, want: int) -> np.ndarray:
    """First words of windows of want words both of whose end windows of have words are alive."""
    out = np.zeros_like(alive)
    shift = want - have
    if len(alive) > shift:
        out[: len(alive) - shift] = alive[: len(alive) - shift] & alive[shift:]
    return out


def _alive_after(bag: Bag, known: np.ndarray, levels: list[int], answers: list[bytes], state: bytes | None, buckets: int) -> np.ndarray:
    """First words of the candidate windows that the counts in answers leave at the level that they belong to."""
    words = int(bag.counts.sum())
    size = levels[0]
    start = np.ones(words, bool) if state is None else np.unpackbits(np.frombuffer(state, np.uint8), count=words).astype(bool)
    at, keys = _level_keys(bag, size, start, known, buckets)
    total = np.frombuffer(b"".join(answers), np.uint8)
    alive = np.zeros(words, bool)
    if len(at):
        alive[at] = total[keys.inverse] >= 2
    return _extend(alive, size, levels[1])


def _first_entries(size: int, buckets: int):
    def run(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = unpack(row["ids"], row["lens"], row["data"])
        bag = Bag(texts)
        _, keys = _level_keys(bag, size, np.ones(int(bag.counts.sum()), bool), ids != NO_ID, buckets)
        yield entries_table([(row["batch"], b, k, c) for b, k, c in keys.blobs()])

    return each(run)


def _next_entries(levels: list[int], buckets: int):
    """From one counted level to the next: its candidates (bucket -1: their bits), and their keys."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = unpack(row["ids"], row["lens"], row["data"])
        bag, known = Bag(texts, seeds=(0, 1)), ids != NO_ID
        alive = _alive_after(bag, known, levels, row["answers"] or [], row.get("state"), buckets)
        found = [(row["batch"], -1, np.packbits(alive).tobytes(), b"")]
        if len(levels) > 2:
            _, keys = _level_keys(bag, levels[1], alive, known, buckets)
            found += [(row["batch"], b, k, c) for b, k, c in keys.blobs()]
        else:
            last = Final(bag, levels[1], alive, known, ids, buckets)
            found += [(row["batch"], b, k, c) for b, k, c in last.blobs()]
        yield entries_table(found)

    return each(run)


class Final:
    """The candidate windows of the last level: 96-bit keys, and for each key the least id of this batch that has it."""

    def __init__(self, bag: Bag, size: int, alive: np.ndarray, known: np.ndarray, ids: np.ndarray, buckets: int):
        at, doc, h = bag.windows(size)
        keep = alive[at] & known[doc]
        self.at, doc, h = at[keep], doc[keep], h[keep]
        more = bag.windows(size, 1)[2][keep] if len(at) else h
        self.id = ids[doc]
        self.bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((self.id, more, h, self.bucket))
        new = np.ones(len(order), bool)
        a, b = h[order], more[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        first = order[new]
        self.key, self.key2, self.least, self.buckets = h[first], (more[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.id[first], self.bucket[first]

    def blobs(self) -> Iterator[tuple[int, bytes, bytes]]:
        cuts = [0, *(np.flatnonzero(np.diff(self.buckets)) + 1).tolist(), len(self.buckets)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                yield int(self.buckets[lo]), self.key[lo:hi].tobytes() + self.key2[lo:hi].tobytes(), self.least[lo:hi].tobytes()

    def repeated(self, answers: list[bytes]) -> np.ndarray:
        """Which candidate windows also start in a document with a smaller id."""
        earlier = np.frombuffer(b"".join(answers), np.uint8).astype(bool)
        return (self.id > self.least[self.inverse]) | earlier[self.inverse] if len(self.at) else np.empty(0, bool)


def _first_of_bucket(t: pa.Table) -> pa.Table:
    """For each key of each batch: does another batch have it with a smaller id?"""
    n = [len(x.as_buffer()) // 8 for x in t.column("counts")]
    blobs = [x.as_buffer() for x in t.column("keys")]
    k1 = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, n)])
    k2 = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(blobs, n)])
    least = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts")])
    order = np.lexsort((least, k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    best = least[order][new][np.cumsum(new) - 1]
    earlier = np.empty(len(order), np.uint8)
    earlier[order] = best < least[order]
    cuts = np.cumsum([0, *n])
    return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "answer": pa.array([earlier[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _results(window: int, buckets: int):
    def run(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = unpack(row["ids"], row["lens"], row["data"])
        bag, known = Bag(texts, seeds=(0, 1)), ids != NO_ID
        words = int(bag.counts.sum())
        alive = np.unpackbits(np.frombuffer(row["state"], np.uint8), count=words).astype(bool)
        last = Final(bag, window, alive, known, ids, buckets)
        hit = last.at[last.repeated(row["answers"] or [])]
        cover = np.zeros(words + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans")}
        removed = np.concatenate([[0], np.cumsum(gone)])
        for i, text in enumerate(texts):
            lo, hi = int(bag.offsets[i]), int(bag.offsets[i + 1])
            k = int(removed[hi] - removed[lo])
            kept = text.split()
            spans = []
            if k:
                g = gone[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                kept = [w for w, x in zip(kept, g.tolist()) if not x]
            out["doc_id"].append(None if ids[i] == NO_ID else int(ids[i]))
            out["n_words"].append(hi - lo)
            out["n_removed"].append(k)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            out["spans"].append(spans)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return each(run)


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, the words covered by a window that also starts in a document with a smaller id, where
    those words are (spans), and the digest of the words left, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+. Null texts have no words. A document without id is returned whole and makes no
    other's words repeated; rows of the same id do not remove each other's words. Documents of fewer words than the
    window keep them all. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark, "substrings")
    buckets, levels = buckets_of(spark), levels_to(window)
    batches = scratch.table(batches_of(text_rows(docs, id_col, text_col)), "batches", "none")
    answers = scratch.table(count_keys(batches.mapInArrow(_first_entries(levels[0], buckets), ENTRY_SCHEMA)), "level")
    scratch.free()
    state = None
    while len(levels) > 1:
        rows = with_answers(batches, answers)
        if state is not None:
            rows = rows.join(state, "batch", "left")
        found = scratch.table(rows.mapInArrow(_next_entries(levels, buckets), ENTRY_SCHEMA), "candidates", "lz4")
        state = found.where("bucket = -1").select("batch", F.col("keys").alias("state"))
        entries = found.where("bucket >= 0")
        last = len(levels) == 2
        answers = scratch.table(entries.groupBy("bucket").applyInArrow(_first_of_bucket, "batch long, bucket int, answer binary") if last else count_keys(entries), "level")
        scratch.free()
        levels = levels[1:]
    return with_answers(batches, answers).join(state, "batch", "left").mapInArrow(_results(window, buckets), RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
