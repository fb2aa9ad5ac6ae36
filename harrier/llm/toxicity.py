"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A bag is a passage of PASSAGE words: the vectors of its words and of their character n-grams, averaged, so a misspelling
never seen before is near the word that it shares most n-grams with. A document is as toxic as its most toxic passage: a
few insults in a long text would vanish in an average over all of it.

Documents are labelled, passages are not. A first fit takes every passage of a toxic document for toxic: what clean
documents have, too, it learns to give no weight. A second fit takes from each toxic document the passages that the first
one tells from nearly all clean ones, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.shared import documents
from harrier.llm.subwords import SAMPLE_DOCS, Model, Words, fit, fold, groups, labelled_sample, logistic, runs, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Words of a passage, and the share of clean passages that a toxic one must stand above after the first fit.
PASSAGE, CLEAN_SHARE = 5, 0.999


def _words(text: str) -> list[str]:
    out: list[str] = []
    for _, held in groups([text.lower()]):
        out += Words(held, letters=True).points.tobytes().decode("utf-32-le", "surrogatepass").split()
    return out


class _Passages:
    """Passages of a sample of texts, by the features of their words; a word's features are kept once."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        docs = [np.fromiter((number.setdefault(w, len(number)) for w in _words(t)), np.int32) for t in texts]
        ids, sizes = [], []
        everything = list(number)
        for lo in range(0, len(everything), 20_000):
            part = everything[lo : lo + 20_000]
            f, owner = Words(part, letters=True).features(pairs=False)
            ids.append(f[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        self.ids, self.size = np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate(sizes or [np.empty(0, np.int64)])
        self.at = np.cumsum(self.size) - self.size
        self.words = np.concatenate(docs or [np.empty(0, np.int32)])
        counts = np.array([len(d) for d in docs], np.int64)
        # A text's passages follow each other; its last one is what is left.
        per = -(-counts // PASSAGE)
        self.doc = np.repeat(np.arange(len(texts)), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.first = np.repeat(np.cumsum(counts) - counts, per) + k * PASSAGE
        self.n = np.minimum(PASSAGE, np.repeat(counts, per) - k * PASSAGE)

    def __call__(self, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.words[runs(self.first[bags], self.n[bags])]
        sizes = self.size[w]
        flat = self.ids[runs(self.at[w], sizes)]
        n = np.add.reduceat(sizes, np.cumsum(self.n[bags]) - self.n[bags])
        return flat, np.ones(len(flat), np.float32), n

    def logits(self, model: Model) -> np.ndarray:
        """Of each passage."""
        value = np.add.reduceat(model.table[self.ids], self.at) if len(self.ids) else np.empty(0)
        sums, sizes = (np.concatenate([[0.0], np.cumsum(x[self.words])]) for x in (value, self.size))
        end = self.first + self.n
        return (sums[end] - sums[self.first]) / np.maximum(sizes[end] - sizes[self.first], 1) + model.bias


def document_logits(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(the greatest logit of any PASSAGE consecutive words, or of all if there are fewer, and the number of words)."""
    sums, sizes = [[] for _ in texts], [[] for _ in texts]
    for who, held in groups([t.lower() for t in texts]):
        w = Words(held, letters=True)
        s, k = w.sums(model.table, pairs=False)
        for i, lo, hi in zip(who, w.offsets[:-1], w.offsets[1:]):
            sums[i].append(s[lo:hi])
            sizes[i].append(k[lo:hi])
    best, words = np.full(len(texts), -30.0), np.zeros(len(texts))
    for i, (s, k) in enumerate(zip(sums, sizes)):
        s, k = np.concatenate([[0.0], *s]), np.concatenate([[0], *k])
        words[i] = len(s) - 1
        if words[i]:
            s, k, w = np.cumsum(s), np.cumsum(k), min(PASSAGE, len(s) - 1)
            best[i] = ((s[w:] - s[:-w]) / np.maximum(k[w:] - k[:-w], 1)).max() + model.bias
    return best, words


def _visits(target: np.ndarray, share: float) -> np.ndarray:
    """All passages, the toxic ones so often that they make up about that share."""
    toxic, clean = np.flatnonzero(target > 0.5), np.flatnonzero(target <= 0.5)
    return np.concatenate([clean, np.tile(toxic, max(1, round(share / (1 - share) * len(clean) / max(1, len(toxic)))))])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE_DOCS) -> tuple[Model, np.ndarray]:
    """The passage model, and the coefficients that make a document's greatest logit a probability; these are fitted on a
    fifth of the sample that the model has not seen. Without labels of both classes, every text gets the share of label 1
    (one half if there are none)."""
    texts, y, weight, part = labelled_sample(docs, labels, label, folds, held_out, sample)
    if len(set(y.tolist())) < 2:
        p = np.clip((y * weight).mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(np.zeros(1 << 18, np.float32), 0.0), np.array([0.0, np.log(p / (1 - p))])
    own = part > 0 if len(set(y[part > 0].tolist())) == 2 else np.ones(len(y), bool)
    p = _Passages([t for t, o in zip(texts, own) if o])
    target = y[own][p.doc]
    even = np.ones(len(target), np.float32)
    z = p.logits(fit(p, target, even, _visits(target, 0.3), epochs=2, batch=1024, keep=0.5))
    clean = z[target == 0]
    named = (target == 1) & (z > (np.quantile(clean, CLEAN_SHARE) if len(clean) else -np.inf))
    if named.any():
        target = named.astype(float)
        model = fit(p, target, even, _visits(target, 0.2), epochs=3, batch=1024, keep=0.5, seed=2)
    else:  # too few documents to tell passages apart
        model = fit(p, target, even, _visits(target, 0.3), epochs=4, batch=64)
    rest = part == 0 if len(set(y[part == 0].tolist())) == 2 else np.ones(len(y), bool)
    f, n = document_logits([t for t, r in zip(texts, rest) if r], model)
    return model, logistic(f[n > 0][:, None], y[rest][n > 0], weight[rest][n > 0])


def _score(model: Model, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                z, words = document_logits([t or "" for t in part.column(1).to_pylist()], model)
                score = np.where(words > 0, sigmoid(z * scale[0] + scale[1]), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, scale: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of whole texts. A text without words, null and empty ones too, scores 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model, scale), "doc_id long, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A row without id is neither learned from nor held out. Rows of
    the same id are each scored; equal texts score alike; texts of any length are scored whole; other columns are ignored,
    and an empty table gives an empty result."""
    model, scale = train_toxicity(docs, labels)
    scored = score_toxicity(docs, model, scale)
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
