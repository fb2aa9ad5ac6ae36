"""A quality classifier: hashed word, word-pair and character n-gram vectors, averaged per document, into a softmax."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.shared import documents
from harrier.llm.subwords import SAMPLE_DOCS, Model, Words, fit, fold, groups, labelled_sample, logistic, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def document_logits(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(mean value of the features, how many words) of each text; a text without words has the mean 0."""
    total, count, words = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for who, held in groups(texts):
        w = Words(held, letters=False)
        s, n = w.sums(model.table, pairs=True)
        owner = np.array(who)[w.text]
        total += np.bincount(owner, s, len(texts))
        count += np.bincount(owner, n, len(texts))
        words += np.bincount(owner, minlength=len(texts))
    return total / np.maximum(count, 1) + model.bias, words


class _Bags:
    """All features of whole texts, each once with how often a text has it. They take several times the memory of the texts,
    so they lie in a file in the driver's temporary folder, of which a step of the training reads what it needs."""

    ROW = np.dtype([("id", np.int32), ("often", np.uint32)])

    def __init__(self, texts: list[str]):
        n = []
        with tempfile.TemporaryFile(prefix="harrier-bags-") as file:
            for t in texts:
                own, k = np.empty(0, np.int32), np.empty(0, np.int64)
                for _, held in groups([t]) if t else ():
                    f, often = np.unique(Words(held, letters=False).features(pairs=True)[0], return_counts=True)
                    both, at = np.unique(np.concatenate([own, f]), return_inverse=True)
                    own, k = both, np.bincount(at, np.concatenate([k, often]), len(both)).astype(np.int64)
                rows = np.empty(len(own), self.ROW)
                rows["id"], rows["often"] = own, k
                file.write(rows.tobytes())
                n.append(len(own))
            file.flush()
            self.n = np.array(n, np.int64)
            self.ends = np.cumsum(self.n)
            self.rows = np.asarray(np.memmap(file, self.ROW, "r")) if self.n.sum() else np.empty(0, self.ROW)

    def __call__(self, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n[bags]
        rows = np.concatenate([self.rows[hi - k : hi] for hi, k in zip(self.ends[bags].tolist(), n.tolist())])
        return np.ascontiguousarray(rows["id"]), rows["often"].astype(np.float32), n


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE_DOCS) -> tuple[Model, np.ndarray]:
    """The model and the coefficients that make its logits probabilities; these are fitted on a fifth of the sample that
    the model has not seen. Without labels of both classes, every text gets the share of label 1 (one half if none)."""
    texts, y, weight, part = labelled_sample(docs, labels, label, folds, held_out, sample)
    if len(set(y.tolist())) < 2:
        p = np.clip((y * weight).mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(np.zeros(1 << 18, np.float32), 0.0), np.array([0.0, np.log(p / (1 - p))])
    own = part > 0
    bags = _Bags([t for t, o in zip(texts, own) if o])
    rest = ~own if len(set(y[~own].tolist())) == 2 else np.ones(len(y), bool)
    texts = [t for t, r in zip(texts, rest) if r]  # the others are in the bags
    balance = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    model = fit(bags, y[own], balance[own], np.flatnonzero(bags.n), epochs=8, batch=64)
    z, n = document_logits(texts, model)
    return model, logistic(z[n > 0][:, None], y[rest][n > 0], weight[rest][n > 0])


def _score(model: Model, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                z, words = document_logits([t or "" for t in part.column(1).to_pylist()], model)
                score = np.where(words > 0, sigmoid(z * scale[0] + scale[1]), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, scale: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of whole texts. A text without words, null and empty ones too, scores 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model, scale), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, scale: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of a table whose own text scores threshold or more, all columns as they are. Each row is judged by itself:
    null and repeated ids make no difference, a null or empty text goes."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                part = rb.slice(lo, 500)
                z, words = document_logits([t or "" for t in part.column(at).to_pylist()], model)
                yield part.filter(pa.array((words > 0) & (sigmoid(z * scale[0] + scale[1]) >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A row without id is neither learned from nor held out. Rows of
    the same id are each scored; equal texts score alike; texts of any length are scored whole; other columns are ignored,
    and an empty table gives an empty result."""
    model, scale = train_quality(docs, labels)
    scored = score_quality(docs, model, scale)
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
