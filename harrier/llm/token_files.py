"""Token ids in flat binary files.

Each part is a file of unsigned little-endian ids (16 bits if the vocabulary fits, else 32) and a file of 64-bit offsets,
one more than it has documents; parts follow each other in ascending document id, and prefix sums over the parts' counts
give every part its base. Both files can be memory-mapped.

    <path>/part-00000.bin   ids of the part's documents
    <path>/part-00000.idx   uint64 offsets of the documents in it, in ids
    <path>/part-00000.ids   int64 document ids (the least value: none)
    <path>/manifest         a table: part, base, n_docs, n_tokens, width
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.batches import NO_ID
from harrier.llm.shared import Scratch, documents, parts, text_rows

END = 0
#: Pieces remembered by a worker in each of two generations: about 100 MB.
REMEMBERED = 500_000
#: New pieces that are encoded together.
TOGETHER = 4000
#: Characters that are cut into pieces at once; a longer text is cut at blanks.
CHUNK = 1 << 22
LONE = re.compile(r"\S(?= \S)")
#: White space besides the blank, as character classes of such vocabularies have it, and characters that some count to it.
WHITE = r"[\t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: How a byte-level vocabulary writes a blank (a fixed value of such vocabularies).
BLANK = "\u0120"
#: Punctuation that such a vocabulary never joins to a letter or digit before it.
TAIL = ".,;:!?"
MANIFEST = "part int, n_docs long, n_tokens long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


class Encoder:
    """A tokenizer behind a memory of pieces.

    A byte-level vocabulary begins a token at a blank that has no white space on one side at least, so texts are cut
    there, and each different piece is looked up once for many texts. The cutting, the numbering of the pieces and the
    copying of their ids are Arrow's and numpy's work; the tokenizer sees new pieces only. What the cut does not hold for
    (blanks between white space of any kind, special tokens) goes through whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blank = np.zeros(max(1 << 16, self.tokenizer.get_vocab_size(with_added_tokens=True) + 1), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.blank[i] = self.cuts and BLANK in token

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenized(self, pieces: list[str]) -> None:
        """Remember pieces that a blank precedes. Many are encoded as one text: in it, too, every blank begins a token, and
        no other token has one, so the tokens with a blank tell where pieces begin."""
        for lo in range(0, len(pieces), TOGETHER):
            part = pieces[lo : lo + TOGETHER]
            (raw,) = self._ids([" " + " ".join(part)])
            starts = np.flatnonzero(self.blank[np.frombuffer(raw, self.kind)])
            if len(starts) != len(part) or starts[0] != 0:
                self.known.update(zip(part, self._ids([" " + p for p in part])))
                continue
            cuts = [*(starts * self.width).tolist(), len(raw)]
            self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))))

    def _learn(self, missing: list[str]) -> None:
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        again = [p for p in missing if p in older]
        known.update(zip(again, map(older.__getitem__, again)))
        new, tailed = [], []
        for p in missing:
            if p in known:
                continue
            stem = p.rstrip(TAIL)
            if len(stem) < len(p) and stem and stem[-1].isalnum():
                tailed.append((p, stem))
            else:
                new.append(p)
        stems = {x for _, x in tailed}
        known.update((x, older[x]) for x in stems if x not in known and x in older)
        self._tokenized([*new, *(x for x in stems.difference(new) if x not in known)])
        tails = {p[len(x) :] for p, x in tailed}
        ends = dict(zip(tails, self._ids(list(tails))))
        known.update((p, known[x] + ends[p[len(x) :]]) for p, x in tailed)

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each), texts of some CHUNK characters together."""
        column = pa.array(texts, pa.large_string())
        lists = pc.split_pattern(column, " ")
        first = np.asarray(lists.offsets)[:-1].astype(np.int64)
        coded = lists.values.dictionary_encode()
        index, pieces = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(column, s))
        if "" in pieces:
            void = index == pieces.index("")
            void[first] = False
            whole |= np.add.reduceat(void.astype(np.int64), first) > 0
        opens, closes = (np.asarray(pc.match_substring_regex(coded.dictionary, x).to_numpy(zero_copy_only=False), bool) for x in (f"^{WHITE}", f"{WHITE}$"))
        if opens.any() and closes.any():
            between = opens[index]
            between[first] = False
            between[1:] &= closes[index[:-1]]
            whole |= np.add.reduceat(between.astype(np.int64), first) > 0
        missing = [p for p in pieces if p not in self.known and p]
        if missing:
            self._learn(missing)
        # A text's first piece has no blank before it; a text that goes through whole takes its place, the others none.
        heads = self._ids([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole.tolist())])
        known, older = self.known, self.older  # after a new generation has begun, some are in the old one only
        found = [(known.get(p) or older[p]) if p else b"" for p in pieces] + heads + [b""]
        index[np.repeat(whole, np.diff(np.append(first, len(index))))] = len(found) - 1
        index[first] = len(pieces) + np.arange(len(texts))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat, at = np.frombuffer(b"".join(found), self.kind), np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[index]
        ids = flat[np.repeat(at[index] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return ids, np.add.reduceat(n, first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many of each)."""
        if not self.cuts:
            raw = self._ids(texts)
            return np.frombuffer(b"".join(raw), self.kind), np.array([len(x) // self.width for x in raw], np.int64)
        owner, held, size, ids, counts = [], [], 0, [], np.zeros(len(texts), np.int64)

        def flush() -> None:
            if held:
                found, n = self._pieced(held)
                ids.append(found)
                np.add.at(counts, owner, n)

        for i, text in enumerate(texts):
            for chunk in chunks(text):
                if held and size + len(chunk) > CHUNK:
                    flush()
                    owner, held, size = [], [], 0
                owner.append(i)
                held.append(chunk)
                size += len(chunk)
        flush()
        return np.concatenate(ids) if ids else np.empty(0, self.kind), counts


def chunks(text: str) -> Iterator[str]:
    """A text in stretches of about CHUNK characters, cut before a blank that stands alone between two other characters;
    one without such a blank stays whole."""
    lo = 0
    while len(text) - lo > CHUNK:
        cut = LONE.search(text, lo + CHUNK)
        if not cut:
            break
        yield text[lo : cut.start() + 1]
        lo = cut.start() + 1
    if text:
        yield text[lo:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(disk: fs.FileSystem, mine: str, name: str) -> None:
    """Move a finished file into its place. A try before this one may have put the same file there already; some file
    systems refuse to move onto a file."""
    if disk.get_file_info(name).type == fs.FileType.File:
        if disk.get_file_info(name).size == disk.get_file_info(mine).size:
            disk.delete_file(mine)
            return
        disk.delete_file(name)
    disk.move(mine, name)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of rows, some CHUNK characters together."""
    numbers, texts, size = [], [], 0
    for rb in batches:
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1)):
            text = t.as_py() or ""
            numbers.append(NO_ID if i is None else i)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield numbers, texts
                numbers, texts, size = [], [], 0
    if numbers:
        yield numbers, texts


def _writer(path: str, vocabulary: str, end: int):
    """Write the sorted rows of a partition as one part. The files are put in place at their end, so that a task that is
    tried again or runs twice leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(vocabulary), TaskContext.get()
        part = ctx.partitionId()
        disk, root = _open(path)
        disk.create_dir(root, recursive=True)
        stem, mine = f"{root}/part-{part:05d}", f".{ctx.taskAttemptId()}.tmp"
        n_docs = n_tokens = 0
        names = [f"{stem}.{k}" for k in ("bin", "idx", "ids")]
        files = [disk.open_output_stream(n + mine) for n in names]
        files[1].write(np.array([0], "<u8").tobytes())
        for numbers, texts in _gathered(batches):
            ids, counts = enc.encode(texts)
            ends = np.cumsum(counts)
            files[0].write(np.insert(ids, ends, end).astype(enc.kind, copy=False).tobytes())
            files[1].write((n_tokens + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
            files[2].write(np.array(numbers, "<i8").tobytes())
            n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids) + len(counts)
        for f, n in zip(files, names):
            f.close()
            _put(disk, n + mine, n)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_tokens]), pa.array([enc.width], pa.int32())], names=["part", "n_docs", "n_tokens", "width"])

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append the end id, write all in ascending id order; returns the manifest.

    Null texts count as empty and have the end id alone. Rows without id come first, rows of the same id in the order
    of their texts, equal rows one after the other. A text of any length is encoded whole. An empty table has no part with
    documents. Other columns, whatever their names, are ignored.
    """
    rows = text_rows(docs, id_col, text_col)
    ordered = rows.repartitionByRange(2 * parts(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    counted = Scratch(spark, "tokens").table(ordered.mapInArrow(_writer(path, vocabulary, end), MANIFEST), "counts")
    # One row for each part: the sums run over the parts, not over documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.where("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(based.schema).parquet(f"{path}/manifest")


class Part:
    """A part's files, mapped into memory where the path is a file system's, else read."""

    def __init__(self, path: str, part: int, width: int):
        disk, root = _open(path)
        local = isinstance(disk, fs.LocalFileSystem)

        def load(suffix: str, kind: str) -> np.ndarray:
            at = f"{root}/part-{part:05d}.{suffix}"
            if local:
                return np.memmap(at, kind, "r") if os.path.getsize(at) else np.empty(0, kind)
            with disk.open_input_stream(at) as f:
                return np.frombuffer(f.read(), kind)

        self.tokens, self.offsets, self.ids = load("bin", f"<u{width}"), load("idx", "<u8"), load("ids", "<i8")

    def document(self, i: int) -> np.ndarray:
        return self.tokens[int(self.offsets[i]) : int(self.offsets[i + 1])]


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for m in rb.to_pylist():
                p = Part(path, m["part"], m["width"])
                for lo in range(0, m["n_docs"], 10_000):
                    at = range(lo, min(lo + 10_000, m["n_docs"]))
                    ids = p.ids[lo : at.stop]
                    bounds = p.offsets[lo : at.stop + 1].astype(np.int64)
                    crc = [zlib.crc32(p.document(i).astype("<u4").tobytes()) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=ids == NO_ID), pa.array(bounds[:-1] + m["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([m["part"]] * len(at), pa.int32())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: its first position in the whole, its ids and their crc32 as 32-bit integers."""
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.repartitionByRange(2 * parts(spark), "part").mapInArrow(_reader(path), ROWS)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'files').path}/tokens"
    write_tokens(spark, documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
