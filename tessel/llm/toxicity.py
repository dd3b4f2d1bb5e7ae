"""Toxicity: cumulative-link (proportional odds) regression on sparse text features.

Grades 0 to 3 come from binary labels: 0 is a clean document; toxic ones are graded by how much of
their text is telling, by tertiles of the summed log-odds of their telling words. One weight vector is
shared by all grades, and ordered thresholds t1 < t2 < t3 part them: P(grade >= k) = sigmoid(x.w - t_k).
The expected severity is the sum of these three, and a document is rejected from REJECT up.

The fit takes at most MAX_TRAIN labelled rows (clean, toxic), those of the least hash of their id; all
documents are scored in Arrow batches with the broadcast weights that aren't zero (2^BITS at most).

Features are presence of words and of word beginnings of five characters (invented or inflected forms
of an insult share them), hashed, each scaled by its log-odds among the training rows. Only features that
toxic rows have significantly more often take part, with weights of at least 0: one insult in a long text
counts as much as in a short one, and nothing else in the text makes up for it.

Defined results: null or empty text has no features and the severity of the intercept alone; null labels
don't count; without a toxic or a clean training row the severity is 0 and nothing is rejected; rows of
equal doc_id are scored each on its own; only doc_id and text are inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_texts, map_rows, table
from .features import tokens

MAX_TRAIN, BITS, STEM, GRADES, REJECT = (12_000, 4000), 22, 5, 3, 0.5
STEPS, RATE, PENALTY, LEAST_DOCS, SURE = 1500, 0.5, 1e-6, 3, 2.7
KEPT_WORDS = 100_000
MODEL_COLUMNS = "doc_id long, severity double, grade int, rejected boolean"


def _packed(w: str) -> int:
    """Index of a word, and above it that of its beginning (of the word again where it is no longer)."""
    a, b = (zlib.crc32(p.encode("utf-8", "replace")) * 2654435761 % (1 << 32) >> (32 - BITS) for p in (w, "^" + w[:STEM] if len(w) > STEM else w))
    return b << 32 | a


def present(text: str | None, known: dict[str, int] | None = None) -> np.ndarray:
    """Indices of a text's words and of their first STEM characters, each once. known: keeps words, KEPT_WORDS at most."""
    known = {} if known is None else known
    words = set(tokens(text))
    if len(known) > KEPT_WORDS:
        known.clear()
    packed = np.fromiter((x if (x := known.get(w)) is not None else known.setdefault(w, _packed(w)) for w in words), np.int64, len(words))
    return np.unique(np.concatenate([packed & 0xFFFFFFFF, packed >> 32]))


class CumulativeLink:
    """index: ascending features that have a weight; weights: theirs, shared by all grades; cuts: ascending thresholds."""

    def __init__(self, index: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.index, self.weights, self.cuts = index, weights, cuts

    def above(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1, 2, ..."""
        total = self.weights[np.isin(self.index, found, assume_unique=True)].sum() if len(self.index) < len(found) else 0.0
        if len(self.index) >= len(found) > 0:
            at = np.minimum(np.searchsorted(self.index, found), len(self.index) - 1)
            total = self.weights[at[self.index[at] == found]].sum()
        return 1 / (1 + np.exp(-np.clip(total - self.cuts, -35, 35)))


def grade(odds: np.ndarray, toxic: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """0 for clean rows; toxic ones by tertiles of the sum of the log-odds of their telling features."""
    load = np.array([odds[x].sum() for x in rows])
    bounds = np.quantile(load[toxic == 1], [1 / GRADES, 2 / GRADES])
    return np.where(toxic == 1, 1 + np.searchsorted(bounds, load, "left"), 0)


def train(rows: list[np.ndarray], toxic: np.ndarray) -> CumulativeLink:
    """Penalised maximum likelihood by projected gradient steps (Adagrad)."""
    n = 1 << BITS
    if not len(rows) or toxic.min() == toxic.max():
        return CumulativeLink(np.empty(0, np.int64), np.empty(0), np.full(GRADES, 35.0))
    df = [np.bincount(np.concatenate([x for x, y in zip(rows, toxic, strict=True) if y == k] or [np.empty(0, np.int64)]), minlength=n) for k in (0, 1)]
    odds = np.log((df[1] + 0.5) / ((toxic == 1).sum() + 1)) - np.log((df[0] + 0.5) / ((toxic == 0).sum() + 1))
    sure = odds / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    odds[(df[1] < LEAST_DOCS) | (sure < SURE)] = 0  # what is left are words that toxic rows have; no word makes a text cleaner
    y = grade(odds, toxic, rows)
    telling = np.flatnonzero(odds)
    place = np.full(n, -1)
    place[telling] = np.arange(len(telling))
    rows = [place[x][place[x] >= 0] for x in rows]
    index, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    scale = odds[telling] / odds[telling].max(initial=1)
    w, cuts = np.ones(len(telling)), np.arange(1.0, GRADES + 1)
    seen_w, seen_c, own = np.full(len(w), 1e-8), np.full(GRADES, 1e-8), np.arange(len(y))
    for _ in range(STEPS):
        x = np.bincount(owner, (w * scale)[index], minlength=len(rows))
        p = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -35, 35))), np.zeros(len(y))])
        like = np.maximum(p[own, y] - p[own, y + 1], 1e-4)
        slope = p * (1 - p)
        d = 1 - p[own, y] - p[own, y + 1]  # of the log likelihood by x
        g = np.bincount(index, d[owner], minlength=len(w)) * scale / len(y) - PENALTY * w
        c = np.array([np.clip(((y == k - 1) * 1.0 - (y == k)) * slope[:, k] / like, -5, 5).mean() for k in range(1, GRADES + 1)])
        seen_w += g * g
        seen_c += c * c
        w = np.maximum(w + RATE * g / np.sqrt(seen_w), 0)
        cuts = np.maximum.accumulate(cuts + RATE * c / np.sqrt(seen_c) + np.arange(GRADES) * 1e-9)
    return CumulativeLink(telling[w > 0], (w * scale)[w > 0], cuts)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_train: tuple[int, int] = MAX_TRAIN) -> CumulativeLink:
    """From at most max_train labelled rows, clean and toxic."""
    ids = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = None
    for k in (0, 1):
        part = ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train[k])
        chosen = part if chosen is None else chosen.unionAll(part)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        known: dict = {}
        for doc, y, text in it:
            yield doc, y, present(text, known).tolist()

    taken = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    found = map_rows(taken, ["doc_id", "label", "text"], "doc_id long, label int, i array<int>", rows).toArrow()
    index, toxic = found["i"].combine_chunks(), found["label"].to_numpy()
    return train([index[k].values.to_numpy().astype(np.int64) for k in range(len(index))], toxic)


def severity(documents: DataFrame, model: CumulativeLink, reject: float = REJECT) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES), grade (likeliest), rejected."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        own, known = held.value, {}
        for doc, text in it:
            p = own.above(present(text, known))
            expected = float(p.sum())
            yield doc, expected, int(np.argmax(-np.diff([1.0, *p, 0.0]))), expected >= reject

    return map_rows(documents, ["doc_id", "text"], MODEL_COLUMNS, rows)


def keep_clean(documents: DataFrame, model: CumulativeLink, reject: float = REJECT) -> DataFrame:
    """The documents, all their columns, without the rejected ones."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep() -> Callable[[str | None], bool]:
        own, known = held.value, {}
        return lambda text: float(own.above(present(text, known)).sum()) < reject

    return filter_texts(documents, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return severity(documents, fit(documents, table(spark, sf_dir, "labels")))
