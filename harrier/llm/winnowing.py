"""Document fingerprints by winnowing.

Every k consecutive code points are hashed; of every w consecutive hashes the least is kept, the rightmost of equal ones,
with its position. Two texts that share w + k - 1 code points in a row share a kept hash, at positions that line up.
A text with fewer than w hashes is one window; one shorter than k code points is a single gram; an empty text has no hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.hashing import between, mix, prefix
from harrier.llm.shared import Scratch, documents, parts, text_rows

GRAM = 8
WINDOW = 16
#: Code points hashed at once; positions within take 24 bits of a comparison value, hashes 40.
CHUNK = 1 << 18
_POS = np.uint64((1 << 24) - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """40-bit hashes of all runs of k code points (of the whole if it is shorter)."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    sums, at = prefix(mix(points.astype(np.uint64), 3), 5), np.arange(n - k + 1)
    return mix(between(sums, at, at + k, 5), k) >> np.uint64(24)


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        v, have = np.minimum(v[:-have], v[have:]), 2 * have
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if w > have else v


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, their positions), by position. A long text is worked off in pieces of CHUNK windows; a piece has all
    grams of its windows."""
    points = code_points(text)
    if len(points) <= CHUNK:
        return _winnow(points, k, w)
    hashes, places = [], []
    for lo in range(0, max(1, len(points) - k - w + 2), CHUNK):
        h, p = _winnow(points[lo : lo + CHUNK + k + w - 2], k, w)
        hashes.append(h)
        places.append(p + lo)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def _winnow(points: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hashes(points, k)
    if not len(h):
        return h, np.empty(0, np.int64)
    least = _sliding_least((h << np.uint64(24)) | (_POS - np.arange(len(h), dtype=np.uint64)), min(w, len(h)))
    place = np.unique(_POS - (least & _POS)).astype(np.int64)
    return h[place], place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes(), digest_size=16).hexdigest()


def _fingerprints(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 256):
                part = rb.slice(lo, 256)
                found = [winnow(t.as_py() or "", k, w) for t in part.column(1)]
                hashes, places = (pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), hashes, places], names=["doc_id", "hashes", "positions"])

    return run


def fingerprint_documents(docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the kept hashes and their positions (code points), by position. Null texts count as empty."""
    return text_rows(docs, id_col, text_col).mapInArrow(_fingerprints(k, w), "doc_id long, hashes array<long>, positions array<long>")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"
_STAGED = COMPARED + ", kind string, part int, text string"


def _compare(doc_id: int | None, text: str, own: tuple, following: str, next_own: tuple, k: int, w: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = winnow(edited, k, w)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(*own), digest(*changed), likeness(own[0], changed[0]), likeness(own[0], next_own[0]), len(own[0]))


def _batch(rows: list[tuple], kind: str = "done", part: int = 0, text: str | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [c.split()[0] for c in _STAGED.split(", ")]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    n = len(rows)
    return pa.RecordBatch.from_arrays([*cols, pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())], names=names)


def _along(k: int, w: int):
    """Compare each document of a sorted partition with the next; the last one waits for the next partition's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, out, blank = TaskContext.get().partitionId(), None, [], (None,) * 8
        for rb in batches:
            for i, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                text = t.as_py() or ""
                own = winnow(text, k, w)
                if held is None:
                    yield _batch([blank], "head", part, text)
                else:
                    out.append(_compare(*held, text, own, k, w))
                held = (i, text, own)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)
        if held is not None:
            yield _batch([(held[0], *blank[1:])], "tail", part, held[1])

    return run


def _across(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                pair = r["text"], r["following"]
                yield _batch([_compare(r["doc_id"], pair[0], winnow(pair[0], k, w), pair[1], winnow(pair[1], k, w), k, w)])

    return run


def compare_neighbours(spark: SparkSession, docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: digests of its fingerprint and of its edited text's, and likenesses (Jaccard of kept hashes).

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document's, in
    ascending id order (rows without id first, rows of the same id by text; after the last: the first). Null texts count
    as empty; a text of any length is fingerprinted whole, in pieces. One range shuffle orders the texts; only partitions' first and last documents are met by a join.
    """
    scratch = Scratch(spark, "winnowing")
    order = [F.col("id").asc_nulls_first(), F.coalesce("text", F.lit("")).asc()]
    ordered = text_rows(docs, id_col, text_col).repartitionByRange(2 * parts(spark), order[0]).sortWithinPartitions(*order)
    staged = scratch.table(ordered.mapInArrow(_along(k, w), _STAGED), "staged")
    heads = staged.where("kind = 'head'").select("part", F.col("text").alias("following"))
    turn = heads.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.expr("max(part) OVER ()")).alias("before"))
    tails = staged.where("kind = 'tail'").select(F.col("part").alias("before"), "doc_id", "text")
    pairs = tails.join(turn, "before").join(heads, "part").select("doc_id", "text", "following")
    rest = pairs.mapInArrow(_across(k, w), _STAGED)
    return staged.where("kind = 'done'").unionByName(rest).drop("kind", "part", "text")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark, documents(spark, sf_dir))
