"""Classifiers of hashed subword embeddings: vectors of words and character n-grams, averaged, into a linear softmax.

Embeddings and softmax are trained jointly, in numpy, on the driver, over a bounded sample. To score, the product of the
two is one number per bucket, so a text costs look-ups and sums only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.hashing import between, mix, prefix
from harrier.llm.shared import Scratch

BITS = 18
GRAMS = (3, 4, 5)
#: Code points worked on at once.
CHUNK = 1 << 18
#: Labelled documents of each class that a model is fitted on, and their characters, together. Scoring has no limit.
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 24_000_000


@lru_cache(maxsize=1)
def alnum() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str) -> Iterator[str]:
    """A long text, cut at blanks into pieces of about CHUNK characters."""
    lo = 0
    while len(text) - lo > CHUNK:
        hi = text.rfind(" ", lo + CHUNK // 2, lo + CHUNK)
        hi = lo + CHUNK if hi < 0 else hi + 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def groups(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces) of about CHUNK characters; the pieces of one text may be in several groups."""
    who, held, size = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(t):
            if held and size + len(p) > CHUNK:
                yield who, held
                who, held, size = [], [], 0
            who.append(i)
            held.append(p)
            size += len(p)
    if held:
        yield who, held


class Words:
    """The words of a few texts as spans of code points, blanks around each text.

    letters: words are runs of letters and digits (with @ $ * between two of them); else runs of anything but blanks.
    """

    def __init__(self, texts: list[str], letters: bool):
        p = points_of(" " + " ".join(texts) + " ")
        if letters:
            own = alnum()[p]
            mark = (p == 64) | (p == 36) | (p == 42)
            own[1:-1] |= mark[1:-1] & own[:-2] & own[2:]
        else:
            own = (p > 32) & (p != 0xA0) & (p != 0x3000)
        self.points = np.where(own, p, np.uint32(32))
        step = np.diff(own.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        at = np.cumsum([1, *(len(points_of(t)) + 1 for t in texts)])
        self.offsets = np.searchsorted(self.starts, at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.offsets))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n: the bucket of every position's n-gram, and the first and end positions of each word's n-grams;
        a word's n-grams may hold the blank before or after it."""
        c = self.points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = c
        with np.errstate(over="ignore"):
            for n in range(2, max(GRAMS) + 1):
                h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[n - 1 :]
                if n in GRAMS:
                    bucket = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32)
                    lo = np.minimum(self.starts - 1, len(bucket))
                    yield bucket, lo, np.minimum(np.maximum(self.ends - n + 2, lo), len(bucket))

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        return mix(between(prefix(mix(self.points.astype(np.uint64), 1), 7), self.starts, self.ends, 7), 3)

    def word_features(self, pairs: bool) -> list[np.ndarray]:
        """Buckets with one value per word: the word and, on request, the word with the one before it. A word that
        repeats the one before has a bucket that all repeats share; a text's first word has another."""
        h = self.whole()
        out = [(mix(h, 41) >> np.uint64(64 - BITS)).astype(np.int32)]
        if pairs and len(h):
            two = np.empty(len(h), np.uint64)
            with np.errstate(over="ignore"):
                two[1:] = h[:-1] * np.uint64(3) + h[1:]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            two[same] = 17
            two[self.offsets[:-1][self.offsets[:-1] < len(h)]] = 19
            out.append((mix(two, 43) >> np.uint64(64 - BITS)).astype(np.int32))
        return out

    def sums(self, table: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the sum of its features' values in table, and their number."""
        total, count = np.zeros(len(self.starts)), np.zeros(len(self.starts), np.int64)
        for f in self.word_features(pairs):
            total += table[f]
            count += 1
        for bucket, lo, hi in self.grams():
            run = np.zeros(len(bucket) + 1)
            np.cumsum(table[bucket], out=run[1:])
            total += run[hi] - run[lo]
            count += hi - lo
        return total, count

    def features(self, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of all features."""
        own = self.word_features(pairs)
        ids, words = list(own), [np.arange(len(self.starts))] * len(own)
        for bucket, lo, hi in self.grams():
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            ids.append(bucket[at])
            words.append(np.repeat(np.arange(len(n)), n))
        return np.concatenate(ids), np.concatenate(words)


@dataclass
class Model:
    """table: one value per bucket; a bag's logit of class 1 is the mean of its features' values plus bias."""

    table: np.ndarray
    bias: float


Draw = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def fit(draw: Draw, target: np.ndarray, weight: np.ndarray, visits: np.ndarray, *, dim: int = 8, epochs: int = 6, rate: float = 0.4, batch: int = 256, keep: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent (with per-row step sizes) on the cross entropy of soft targets; the vectors of all
    buckets and the softmax above their average are trained together.

    draw(bags) gives (features of these bags one after the other, how often each occurs, how many rows each bag has).
    visits: the bags that an epoch visits, some more than once. keep: share of a bag's features that a step sees, so that
    no single one is relied on.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias, seen = np.zeros(2, np.float32), np.full(1 << BITS, 1e-8, np.float32)
    seen_w, seen_b = np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        for part in np.array_split(rng.permutation(visits), max(1, len(visits) // batch)):
            if not len(part):
                continue
            flat, often, n = draw(part)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            if keep < 1:
                stay = rng.random(len(flat)) < keep
                stay[first] = True
                flat, often, n = flat[stay], often[stay], np.add.reduceat(stay.astype(np.int64), first)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
            share = (often / np.repeat(np.add.reduceat(often, first), n)).astype(np.float32)
            rows = table[flat]
            rows *= share[:, None]
            x = np.add.reduceat(rows, first)
            del rows  # of a batch of long texts one such array at a time
            z = x @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.stack([1 - target[part], target[part]], 1)
            g = ((p - y) * weight[part][:, None] / weight[part].mean()).astype(np.float32)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate([[True], np.diff(flat[order]) != 0])
            rows = flat[order][new]
            back = np.repeat(g @ soft.T, n, axis=0)
            back *= share[:, None]
            back = back[order]
            by_row = np.add.reduceat(back, np.flatnonzero(new))
            del back
            seen[rows] += (by_row**2).mean(1)
            table[rows] -= step * by_row / np.sqrt(seen[rows])[:, None]
            gw, gb = x.T @ g / len(part), g.mean(0)
            seen_w += gw**2
            seen_b += gb**2
            soft -= step * gw / np.sqrt(seen_w)
            bias -= step * gb / np.sqrt(seen_b)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] numbers), then those from begin[1] on, and so forth."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the last: intercept) of a logistic regression, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * np.append(w[:-1], 0)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo of; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def bounded_rows(found: DataFrame, per_class: int, chars: int, scratch: Scratch) -> list[tuple[int, str, Any]]:
    """(doc_id, text, y) of a bounded sample of rows (doc_id, text, y, h), ascending by id: of each class those of least h,
    per_class of them at most and chars characters together, a row that would go beyond that being passed over. Rows of
    one id count as one, of the least text. found: not many more rows than that."""
    rows = scratch.table(found.groupBy("doc_id").agg(F.min(F.struct("text", "y", "h")).alias("r")).select("doc_id", "r.*"), "sample")
    left: dict[Any, list[int]] = {}
    chosen = []
    for r in sorted(rows.select("y", "h", "doc_id", F.length("text").alias("n")).collect()):
        room = left.setdefault(r.y, [per_class, chars])
        if room[0] > 0 and (r.n or 0) <= room[1]:
            room[0], room[1] = room[0] - 1, room[1] - (r.n or 0)
            chosen.append((r.doc_id,))
    # As many ids as the sample has rows.
    ids = F.broadcast(rows.sparkSession.createDataFrame(chosen, "doc_id long"))
    return sorted((r.doc_id, r.text or "", r.y) for r in rows.join(ids, "doc_id").select("doc_id", "text", "y").collect())


def hash_below(id_col: str, salt: int, share: Column | float) -> tuple[Column, Column]:
    """(a hash of the id in [0, 1), whether it is below share)."""
    h = F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return h, h < share


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, docs_per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(texts, labels, weights, folds) of at most docs_per_class labelled rows of each class outside the held-out fold, and
    of chars characters.

    Rows are taken in the order of a hash of their id; the weights restore the classes' shares. A document with several
    labels has the greatest, rows of the same id are one document, and labels without a document are passed over.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(fold("doc_id", of) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return [], np.empty(0), np.empty(0), np.empty(0, int)
    # A little more than is wanted, as hashes and labels without documents vary: about 2.6 * docs_per_class ids at most.
    share = F.create_map(*[F.lit(x) for y, n in shares.items() for x in (y, min(1.0, (1.2 * docs_per_class + 100) / n))])
    h, drawn = hash_below("doc_id", of, share[F.col("y")])
    picked = F.broadcast(known.where(drawn).withColumn("h", h))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = bounded_rows(rows.join(picked, "doc_id"), docs_per_class, chars, Scratch(docs.sparkSession, "sample"))
    y = np.array([r[2] for r in got], float)
    weight = np.ones(len(got))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = shares[c] / (y == c).sum()
    folds = mix(np.array([r[0] for r in got], np.int64).view(np.uint64), 99) % np.uint64(5) if got else np.empty(0, np.uint64)
    return [r[1] for r in got], y, weight / weight.mean() if len(got) else weight, folds.astype(int)
