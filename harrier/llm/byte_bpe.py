"""Byte-level BPE by a finite-state transducer, and decoding by a UTF-8 state machine.

Encoding. A row of tokens is what the merges make of its bytes exactly if every token is what they make of its own bytes
and no two neighbours would have been merged across their border. So each prefix of a piece ends in one token only, and
reading a byte extends, for every start that is still open, a token begun there. A state of the transducer is the set of
open starts: (token before the start, bytes since it, tokens not yet written). What all open starts have in common is
written. A start stays open for as long as some token begins with its bytes, so a token is written after the length of
the longest token at most. States and their steps are made when a text first needs them (lazy determinisation) and kept
up to a number.

Decoding. The bytes of a character may be spread over tokens. A state machine over bytes knows how much of a character
is open; for each token and state its outcome is a table, so a stream of ids is walked token by token, and only where a
character is open.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm import token_files
from harrier.llm.shared import Scratch, documents, text_rows
from harrier.llm.token_files import TAIL

#: States of the transducer, and pieces whose ids are remembered in each of two generations, in a worker.
STATES = 200_000
REMEMBERED = 500_000
#: Ids decoded together.
IDS_TOGETHER = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank. The rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Transducer:
    """From the bytes of a piece to its ids. Merges are those of the ranks: of two neighbours, those whose joined bytes
    have the least rank merge first, the first of equal ones. All single bytes must be tokens, and a token must have a
    later rank than the two that merge to it, as the merges of a vocabulary do (check; ValueError)."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.token = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        #: Beginnings of tokens: a proper beginning of some token, or not.
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._borders: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop the states; they are made again when needed."""
        if len(self._borders) > self.most:
            self._borders = {}
        self.names: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        #: From state * 256 + byte to the next state and what is written.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._name(((-1, b"", ()),))

    def _name(self, config: tuple) -> int:
        name = self.names.setdefault(config, len(self.configs))
        if name == len(self.configs):
            self.configs.append(config)
        return name

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges as they are defined, for the short bytes of one token, its own merge left out."""
        out = [piece[i : i + 1] for i in range(len(piece))]
        while len(out) > 2:
            rank, at = min((self.ranks.get(a + b, len(self.token) + 1 << 32), i) for i, (a, b) in enumerate(zip(out, out[1:])))
            if out[at] + out[at + 1] not in self.ranks:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a single byte; None if its bytes do not merge to it."""
        if token not in self._halves:
            parts = self.merged(self.token[token])
            two = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
            if two and max(x if len(p) > 1 else -1 for x, p in zip(two, parts)) >= token:
                raise ValueError(f"token {token} comes before one that merges to it")
            self._halves[token] = (-1, -1) if len(parts) == 1 else two
        return self._halves[token]

    def check(self) -> "Transducer":
        """ValueError if the ranks of any token are not in the order of merges."""
        for t in self.token:
            self.halves(t)
        return self

    def border(self, left: int, right: int) -> bool:
        """Do the merges leave the border between two tokens? Their last merges are undone, the latest first: at each
        moment the two tokens at the border may merge only if that would have come before the merge that was undone."""
        found = self._borders[left, right] = self.halves(right) is not None and (left < 0 or self._kept_apart(left, right))
        return found

    def _kept_apart(self, left: int, right: int) -> bool:
        token, ranks, before = self.token, self.ranks, len(self.token) + 1 << 32
        while True:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and joined < before:
                return False
            single = len(token[left]) == 1, len(token[right]) == 1
            if all(single):
                return True
            # A merge on the left comes before one of the same rank on the right, and so does one at the border.
            if single[1] or not single[0] and left > right:
                before, left = left, self.halves(left)[1]
            else:
                before, right = right + 1, self.halves(right)[0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the step from a state by a byte: the next state, and what is written."""
        following, reached, more = [], None, bytes([byte])
        for last, begun, waiting in self.configs[state]:
            grown = begun + more
            if grown in self.open:
                following.append((last, grown, waiting))
            if reached is None:  # only one row of tokens ends here
                token = self.ranks.get(grown)
                if token is not None:
                    apart = self._borders.get((last, token))
                    if self.border(last, token) if apart is None else apart:
                        reached = (token, b"", (*waiting, token))
        following.append(reached)
        first = following[0][2]
        common = len(first)
        for *_, waiting in following[1:]:
            common = min(common, len(waiting))
            while waiting[:common] != first[:common]:
                common -= 1
        out = self.steps[state << 8 | byte] = self._name(tuple((last, begun, w[common:]) for last, begun, w in following)), first[:common]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece. A piece that is a token is that token, whether its bytes merge to it or not."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.configs) > self.most:
            self._forget()
        state, out, steps = 0, [], self.steps
        for i, byte in enumerate(piece):
            state, written = steps.get(state << 8 | byte) or self._step(state, byte)
            if written:
                out += written
            if not i & 0xFFFF and len(self.configs) > self.most:  # a piece without end goes on from its state alone
                config = self.configs[state]
                self._forget()
                state, steps = self._name(config), self.steps
        out += self.configs[state][-1][2]
        return out


class Encoder(token_files.Encoder):
    """Texts to ids: a pattern splits them, and the transducer reads what is not remembered. Where the pattern is known to
    begin a piece at each blank that has no white space on one side, texts are cut there and numbered as in token_files;
    texts go through whole under any other pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cuts: bool = False):
        self.transducer, self.pattern, self.cuts = Transducer(ranks), regex.compile(pattern), cuts
        self.width, self.kind, self.special = 4, np.dtype("<u4"), []
        self.known, self.older = {}, {}

    def pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.transducer.encode(piece.encode())
        return out

    def _of(self, text: str) -> bytes:
        return array("I", self.pieces(text)).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return list(map(self._of, texts))

    def _learn(self, missing: list[str]) -> None:
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, self.older = {}, self.known
        # In order, so that words of one beginning take the same steps; punctuation behind a word is a piece of its own.
        for p in sorted(missing):
            ids = self.known.get(p) or self.older.get(p)
            if ids is None:
                stem = p.rstrip(TAIL)
                if len(stem) < len(p) and stem and stem[-1].isalnum():
                    ids = self.known.get(stem) or self.older.get(stem)
                    if ids is None:
                        ids = self.known[stem] = self._of(" " + stem)
                    ids += self._of(p[len(stem) :])
                else:
                    ids = self._of(" " + p)
            self.known[p] = ids


def _next_state(state: int, byte: int) -> int:
    """The UTF-8 state machine. 0: between characters; 1, 2, 3: so many bytes of a character to come; 4-7: the next byte
    is bounded, so that no form is overlong, a surrogate or past the last code point. A byte that cannot follow breaks
    off the open character and is read anew; one that cannot begin a character is by itself."""
    if state:
        low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
        if low <= byte <= high:
            return then
    return 1 if 0xC2 <= byte <= 0xDF else {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(byte, 2 if 0xE1 <= byte <= 0xEF else 3 if 0xF1 <= byte <= 0xF3 else 0)


BETWEEN, MACHINE = 0, 8


class Decoder:
    """Ids to bytes and text as they come: what push returns ends between characters; what is open waits, three bytes at
    most. Bytes that are not UTF-8 are returned as they are, and as U+FFFD in text."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        step = [[_next_state(s, b) for b in range(256)] for s in range(MACHINE)]
        self.after = np.empty((MACHINE, len(tokens)), np.int8)
        for i, t in enumerate(tokens):
            for s in range(MACHINE):
                x = s
                for b in t:
                    x = step[x][b]
                self.after[s, i] = x
        self.tokens = pa.array(tokens, pa.large_binary())
        #: Tokens that do not lead from between characters to between characters.
        self.partial = self.after[BETWEEN] != BETWEEN
        self.state, self.held = BETWEEN, b""

    def bytes_of(self, ids: np.ndarray) -> bytes:
        _, _, data = self.tokens.take(pa.array(ids)).buffers()
        return data.to_pybytes() if data else b""

    def _walk(self, ids: np.ndarray) -> int:
        state, at = self.state, 0
        odd = np.flatnonzero(self.partial[ids]).tolist()
        following = iter([*odd, len(ids)])
        i = next(following) if state == BETWEEN else 0
        while i < len(ids):
            state, at = int(self.after[state, ids[i]]), i + 1
            i = at if state != BETWEEN else next((x for x in following if x >= at), len(ids))
        return state

    def push(self, ids: Iterable[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        data, self.state, self.held = self.held + self.bytes_of(ids), self._walk(ids), b""
        if self.state != BETWEEN:
            waits = next((k for k in (1, 2, 3) if data[-k:][:1] >= b"\xc0"), 0)
            data, self.held = data[: len(data) - waits], data[len(data) - waits :]
        return data

    def push_text(self, ids: Iterable[int] | np.ndarray) -> str:
        return self.push(ids).decode("utf-8", "replace")

    def finish(self) -> bytes:
        """What is left when the ids end: the bytes of an open character."""
        out, self.state, self.held = self.held, BETWEEN, b""
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """All bytes of a document, from stretches of its ids."""
        out = [self.push(ids[lo : lo + IDS_TOGETHER]) for lo in range(0, len(ids), IDS_TOGETHER)]
        return b"".join([*out, self.finish()])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, cuts: bool) -> Encoder:
    return Encoder(read_ranks(path), pattern, cuts)


@lru_cache(maxsize=2)
def _checked(path: str) -> None:
    Transducer(read_ranks(path)).check()


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


ENCODED = "doc_id long, ids array<int>"


def _encoded(path: str, pattern: str, cuts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, cuts)
        for rb in batches:
            ids, counts = enc.encode([t.as_py() or "" for t in rb.column(1)])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for rb in batches:
            column = rb.column("ids")
            ids, ends = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            data = [dec.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(data, pa.binary())], names=[*rb.schema.names, "data"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, cuts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, each match of the pattern by itself, without special tokens.

    cuts: the pattern begins a piece at each blank that has no white space on one side. Null and empty texts have no
    ids. Rows without id and rows of the same id are each encoded; a text of any length is, in stretches of some million
    characters if cuts holds. Other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    _checked(path)
    return text_rows(docs, id_col, text_col).mapInArrow(_encoded(path, pattern, cuts), ENCODED)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that ids stand for. No ids (or null): no bytes. Any ids have bytes, which need not
    be UTF-8; cast data to a string, or use Decoder.push_text on a stream, for text. An id that is no token is a fault."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(path), ENCODED + ", data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, cuts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode_documents of encode_documents, by one worker for both."""
    _checked(path)
    encode, decode = _encoded(path, pattern, cuts), _decoded(path)
    return text_rows(docs, id_col, text_col).mapInArrow(lambda batches: decode(encode(batches)), ENCODED + ", data binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    Scratch(spark, "bpe")  # for the size of its Arrow batches
    both = round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN, cuts=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
