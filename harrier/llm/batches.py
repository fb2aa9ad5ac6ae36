"""Documents packed into batches, and an exchange that counts hashed keys over all batches.

A batch is one row: the ids of its documents and their texts, compressed. Whatever a batch contributes to an exchange is
computed from its row alone, so a later step recomputes the same keys in the same order and needs only the answers back:
one byte for each distinct key. A batch sends a key once however many of its documents have it, so a key that a third of
all documents share reaches its bucket once per batch, not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.shared import parts

BATCH_BYTES = 2 << 20
SCHEMA = "batch long, ids binary, lens binary, data binary"
#: A document without id takes this value inside a batch; it takes part in nothing.
NO_ID = np.iinfo(np.int64).min


def _pack(batch: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
    row = (np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), data)
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["batch", "ids", "lens", "data"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for rb in batches:
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1)):
            t = (t.as_py() or "").encode()
            if ids and held + len(t) > BATCH_BYTES:
                yield _pack(number, ids, texts)
                number, held, ids, texts = number + 1, 0, [], []
            ids.append(NO_ID if i is None else i)
            texts.append(t)
            held += len(t) + 16
    if ids:
        yield _pack(number, ids, texts)


def batches_of(rows: DataFrame) -> DataFrame:
    """rows: (id long, text string). Write the result to a table before using it: batch numbers hold for one writing."""
    return rows.mapInArrow(_packed, SCHEMA)


def unpack(ids: bytes, lens: bytes, data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = np.frombuffer(lens, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(n.sum()) + 1)
    ends = np.cumsum(n).tolist()
    return np.frombuffer(ids, np.int64), [raw[e - k : e] for e, k in zip(ends, n.tolist())]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one at a time, so that one row's buffers are held as Python objects at once."""
    for rb in batches:
        names = rb.schema.names
        for i in range(rb.num_rows):
            yield {k: rb.column(j)[i].as_py() for j, k in enumerate(names)}


def buckets_of(spark: SparkSession) -> int:
    """More buckets than shuffle partitions, so that a partition's share of them is even."""
    return max(64, 4 * parts(spark))


class Keys:
    """The distinct keys of a batch, ascending by (bucket, remainder), and where each came from.

    keys: one 64-bit hash per occurrence; owner: the document of each. A key is cut to 32 bits within its bucket, which
    is enough to choose candidates; what is decided by them is checked exactly later.
    """

    def __init__(self, keys: np.ndarray, owner: np.ndarray, buckets: int):
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cut = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(cut, kind="stable")
        s = cut[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.cumsum(new) - 1
        self.inverse = np.empty(len(s), np.int64)
        self.inverse[order] = at
        self.distinct = s[new]
        o = owner[order]
        other = new.copy()
        other[1:] |= o[1:] != o[:-1]
        self.owners = np.bincount(at[other], minlength=len(self.distinct)) if len(s) else np.empty(0, np.int64)

    def slices(self) -> Iterator[tuple[int, slice]]:
        b = (self.distinct >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(b)) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(b)]:
            if hi > lo:
                yield int(b[lo]), slice(lo, hi)
            lo = hi

    def blobs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, remainders, how many of the batch's documents have each, 255 at most)"""
        low, n = (self.distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(self.owners, 255).astype(np.uint8)
        for b, s in self.slices():
            yield b, low[s].tobytes(), n[s].tobytes()


ENTRY_SCHEMA = "batch long, bucket int, keys binary, counts binary"
ANSWER_SCHEMA = "batch long, bucket int, answer binary"


def entries_table(found: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["batch", "bucket", "keys", "counts"])


def _count_bucket(t: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("counts")])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(inverse, weights=counts), 255).astype(np.uint8)[inverse]
    cuts = np.cumsum([0, *map(len, keys)])
    answers = [total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "answer": pa.array(answers, pa.binary())})


def count_keys(entries: DataFrame) -> DataFrame:
    """For every key of every batch: in how many documents it is, over all batches, 255 at most."""
    return entries.groupBy("bucket").applyInArrow(_count_bucket, ANSWER_SCHEMA)


def with_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Each batch with its answers in bucket order; a batch without keys has none."""
    got = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("got"))
    return batches.join(got.select("batch", F.col("got.answer").alias("answers")), "batch", "left")


def each(fn: Callable[[dict], Iterator[pa.RecordBatch] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one of a batch row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from fn(row) or ()

    return run
