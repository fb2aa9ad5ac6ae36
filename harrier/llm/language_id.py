"""Language identification by n-gram filters with one bit per language.

A bit-sliced Bloom filter: every slot is a mask of languages, an n-gram's masks at its slots are joined by AND, and the
result says which languages have the n-gram. A text's set bits are counted per language and corrected for the filter's
false positives, whose rate is the share of a language's bits that are set, to the power of the slots per n-gram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.hashing import mix
from harrier.llm.shared import Scratch, documents
from harrier.llm.subwords import bounded_rows, fold, groups, hash_below, points_of

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
GRAMS = (3, 4)
SLOTS_PER_GRAM = 2
#: Documents of each language that filters are filled from at most, and their characters, together.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 6_000_000
#: An n-gram enters a language's filter if at least so many documents have it, and if it is at least so often in the
#: language as in the one that has it most.
LEAST_DOCS, LEAST_SHARE = 3, 0.1


@lru_cache(maxsize=1)
def alphabetic() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the lower-case texts with anything but letters blank, is it a letter, owner of each)"""
    texts = [t.lower() for t in texts]
    p = points_of(" " + " ".join(texts) + " ")
    is_letter = alphabetic()[p]
    owner = np.repeat(np.arange(len(texts)), [len(points_of(t)) + 1 for t in texts])
    return np.where(is_letter, p, np.uint32(32)), is_letter, np.concatenate([[0], owner])[: len(p)]


def gram_hashes(points: np.ndarray, is_letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the n-grams whose inner characters are letters; a blank may begin or end them."""
    c = mix(points.astype(np.uint64), 2)
    h = c
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[n - 1 :]
            if n in GRAMS and len(h):
                inner = np.ones(len(h), bool)
                for k in range(1, n - 1):
                    inner &= is_letter[k : k + len(h)]
                at = np.flatnonzero(inner)
                yield at, mix(h[at], n)


@dataclass
class Filters:
    """masks: for each slot, bytes of language bits; rates: false positive rate of each language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    usual: str

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(SLOTS_PER_GRAM):
            yield (mix(h, 60 + k) % np.uint64(len(self.masks))).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram."""
        a, *rest = (self.masks[s] for s in self.slots(h))
        for b in rest:
            a = a & b
        return a


def build_filters(texts: list[str], langs: list[str]) -> Filters | None:
    names = sorted(set(langs))
    if not names:
        return None
    docs: dict[str, Counter] = {n: Counter() for n in names}
    for t, n in zip(texts, langs):
        for _, held in groups([t]):
            p, own, _ = _letters(held)
            found = [h for _, h in gram_hashes(p, own)]
            if found:
                docs[n].update(np.unique(np.concatenate(found)).tolist())
    size = Counter(langs)
    most: dict[int, float] = {}
    for n in names:
        for g, k in docs[n].items():
            most[g] = max(most.get(g, 0.0), k / size[n])
    chosen = {n: [g for g, k in docs[n].items() if k >= min(LEAST_DOCS, size[n]) and k / size[n] >= LEAST_SHARE * most[g]] for n in names}
    slots = 1 << max(10, int(8 * max(map(len, chosen.values()))).bit_length())
    out = Filters(names, np.zeros((slots, -(-len(names) // 8)), np.uint8), np.zeros(len(names)), max(names, key=lambda n: (size[n], n)))
    for i, n in enumerate(names):
        for s in out.slots(np.array(chosen[n], np.uint64)):
            np.bitwise_or.at(out.masks[:, i // 8], s, np.uint8(1 << i % 8))
        out.rates[i] = np.mean(out.masks[:, i // 8] >> (i % 8) & 1) ** SLOTS_PER_GRAM
    return out


def train_language(docs: DataFrame, per_language: int = SAMPLE_DOCS, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters | None:
    """Filters from at most per_language documents of each language outside the held-out fold, those of least hash of the
    id, and of SAMPLE_CHARS characters; None without such rows. Rows of the same id are one document."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("y"))
    known = known.where(F.col("y").isNotNull() & (fold("doc_id", folds) != held_out) & F.col("text").isNotNull())
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for n, k in counts.items() for x in (n, min(1.0, (1.2 * per_language + 100) / k))])
    h, drawn = hash_below("doc_id", folds, share[F.col("y")])
    rows = bounded_rows(known.where(drawn).withColumn("h", h), per_language, SAMPLE_CHARS, Scratch(docs.sparkSession, "languages"))
    return build_filters([t for _, t, _ in rows], [n for *_, n in rows])


def identify(texts: list[str], filters: Filters | None) -> tuple[list[str], np.ndarray]:
    if filters is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    hits, total, letters = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for who, held in groups(texts):
        p, own, owner = _letters(held)
        text = np.array(who)[owner]
        letters[np.unique(text[own])] = True
        for at, h in gram_hashes(p, own):
            of = text[np.minimum(at + 1, len(text) - 1)]
            total += np.bincount(of, minlength=len(texts))
            masks = filters.lookup(h)
            for i in range(len(filters.languages)):
                hits[:, i] += np.bincount(of, masks[:, i // 8] >> (i % 8) & 1, len(texts))
    right = np.maximum(0, (hits - total[:, None] * filters.rates) / (1 - np.minimum(filters.rates, 0.999)))
    best, sums = right.argmax(1), right.sum(1)
    score = np.where(sums > 0, right.max(1) / np.maximum(sums, 1e-12), 0.0)
    names = [filters.languages[b] if s > 0 else filters.usual for b, s in zip(best, sums)]
    return [n if x else UNKNOWN for n, x in zip(names, letters)], np.where(letters, score, 0.0)


def _predict(filters: Filters | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                lang, score = identify([t or "" for t in part.column(1).to_pylist()], filters)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, filters: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts. Texts without a letter, null and empty ones too, are `und` with score
    0; texts none of whose n-grams any language has get the language learned from most, with score 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(filters), "doc_id long, lang_pred string, score double")


def classify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. A row without id is neither learned from nor held out. Rows of
    the same id are each predicted; equal texts get equal predictions, languages in a tie the first by name; texts of any
    length are read whole; other columns are ignored, and an empty table gives an empty result."""
    got = predict_language(docs, train_language(docs))
    return got.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_language(documents(spark, sf_dir))
