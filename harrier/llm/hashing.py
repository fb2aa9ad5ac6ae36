"""Vectorised hashes of words, word windows and character n-grams.

All hashes are polynomials modulo 2**64 with an odd base over randomised symbols, taken as differences of prefix sums,
so the hash of any window costs two look-ups; a finaliser spreads the result over all bits. Modulo 2**64, long strings of
two symbols exist that are equal under every odd base (Thue-Morse words, from about a thousand symbols), so words of more
than LONG bytes are hashed by blake2b instead. A window has few words, by far too few for such a pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Bytes hashed at once; eight-byte work arrays of this length are all that a long text needs besides itself.
CHUNK = 1 << 19
#: Bytes of the longest word that is hashed as a polynomial.
LONG = 64

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser of x + seed: a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _base(seed: int) -> tuple[int, int]:
    b = int(mix(np.array([1000 + seed], U64))[0]) | 5
    return b, pow(b, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in _base(seed):
        p = np.full(n, b, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; at least n of them, cached by size."""
    return _powers(1 << max(16, int(n - 1).bit_length() if n > 1 else 1), seed)


@lru_cache(maxsize=4)
def symbols(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U64), 77 + seed)


def prefix(values: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values), seed)[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[hi] - sums[lo]) * powers(len(sums), seed)[1][lo]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~SPACE[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; memory beyond the result is bounded by CHUNK or the longest word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        part = symbols(seed)[buf[lo : int(ends[j - 1])]]
        s, e = starts[i:j] - lo, ends[i:j] - lo
        with np.errstate(over="ignore"):
            out[i:j] = mix(between(prefix(part, seed), s, e, seed) + (e - s).astype(U64))
        i = j
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of that many consecutive words, windows over document ends included."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    sums, at = prefix(words, 2 + seed), np.arange(n)
    return mix(between(sums, at, at + size, 2 + seed), 5 + size)


class Bag:
    """The words of a few documents, as hashes, with the documents' bounds.

    texts: UTF-8 bytes of each document. offsets[i]:offsets[i+1] are document i's words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, seeds: tuple[int, ...] = (0,)):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = LOWER[buf]
        self.buf, (self.starts, self.ends) = buf, word_spans(buf)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.offsets = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.offsets)
        self.hashes = [word_hashes(buf, self.starts, self.ends, s) for s in seeds]

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, document, hash) of every window that lies in one document."""
        h = window_hashes(self.hashes[which], size, which)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        if not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64), h
        at = np.flatnonzero(doc[: len(h)] == doc[size - 1 :])
        return at, doc[at], h[at]
