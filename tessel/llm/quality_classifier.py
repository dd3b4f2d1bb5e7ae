"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader.

Training rows are labelled rows that aren't held out (crc32 of the id as text, modulo 3, is 1), the
MAX_TRAIN with the least hash of their id: a bounded sample, so the fit has a bounded size. Each is a
sparse vector of hashed unigrams and bigrams; FTRL-proximal takes them one at a time, and its weights
are mostly exact zeros. All documents are scored by sparse dot products in Arrow batches; the weights
that aren't zero are broadcast, 2^BITS at most.

Defined results: null or empty text has no features and scores the bias; labels that are null or of
unknown documents don't count; a document of contradicting labels trains with each of them; without
training rows all scores are 0.5; rows of equal doc_id are scored each on its own; label, language,
source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table
from .features import BITS, hashed

MAX_TRAIN, EPOCHS = 8000, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.0


class Ftrl:
    """FTRL-proximal with one learning rate for each coordinate; coordinate -1 is the bias, without penalty."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w = np.where(np.abs(z) <= L1, 0.0, w)
        bias = index == len(self.z) - 1
        w[bias] = (-z / ((BETA + np.sqrt(n)) / ALPHA))[bias]
        return w

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        self.z[index] += g - (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / ALPHA * w
        self.n[index] += g * g


def held_out(doc_id) -> F.col:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (2^BITS) and bias from labelled rows that aren't held out."""
    ids = labels.where(F.col(label).isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)  # at most max_train ids
    known: dict[str, int] = {}

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, y, text in it:
            index, value = hashed(text, known=known)
            yield doc, y, index.tolist(), value.tolist()

    taken = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    vectors = map_rows(taken, ["doc_id", "label", "text"], "doc_id long, label int, i array<int>, v array<float>", rows).toArrow()
    order = sorted(range(vectors.num_rows), key=lambda k: ((vectors["doc_id"][k].as_py() or 0) * 2654435761 % 4294967291, vectors["doc_id"][k].as_py() or 0, vectors["label"][k].as_py()))
    model = Ftrl()
    index, value, label_of = vectors["i"].combine_chunks(), vectors["v"].combine_chunks(), vectors["label"].to_pylist()
    for _ in range(epochs):
        for k in order:
            model.learn(index[k].values.to_numpy().astype(np.int64), value[k].values.to_numpy().astype(float), label_of[k])
    w = model.weights(np.arange(len(model.z)))
    return w[:-1], float(w[-1])


def score(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score (0 to 1)."""
    at = np.flatnonzero(weights)
    held = documents.sparkSession.sparkContext.broadcast((at, weights[at], bias))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        dense = np.zeros(1 << BITS)
        dense[held.value[0]] = held.value[1]
        known: dict[str, int] = {}
        for doc, text in it:
            index, value = hashed(text, known=known)
            yield doc, float(1 / (1 + np.exp(-np.clip(dense[index] @ value + held.value[2], -35, 35))))

    return map_rows(documents, ["doc_id", "text"], "doc_id long, score double", rows)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, *fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
