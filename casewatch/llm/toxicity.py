"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the character n-grams of its words, present or not.
Each is scaled by the logarithm of the ratio of its smoothed shares in toxic and
in other training documents; a logistic regression with an L2 penalty is trained
on the scaled features. Scoring adds, for each distinct n-gram of a text, ratio
times weight: one number a hash bucket is broadcast, whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import numbered
from .grams import Vocabulary, word_grams
from .quality import REMEMBERED, training_rows


@dataclass
class RatioModel:
    #: Chosen with the penalty on training folds alone: shorter n-grams are shared by too many words of invented prose.
    bits: int = 20
    sizes: tuple[int, ...] = (5, 7, 9)
    smoothing: float = 1.0
    #: Training documents that must hold an n-gram for it to count: one seen more seldom says nothing of new texts.
    least: int = 3
    penalty: float = 1e-2
    epochs: int = 8
    rate: float = 0.05
    seed: int = 11
    weights: np.ndarray = field(default=None, repr=False)
    bias: float = 0.0

    def features(self, text: bytes) -> np.ndarray:
        words = list(dict.fromkeys(text.lower().split()))
        return np.unique(word_grams(words, self.bits, self.sizes, False)[1]) if words else np.zeros(0, np.int64)

    def fit(self, texts: list[bytes], labels: list[int]) -> RatioModel:
        data = [self.features(t) for t in texts]
        y = np.array(labels, float)
        size = 1 << self.bits
        share = []
        for c in (1, 0):
            n = np.full(size, self.smoothing)
            for x in (x for x, k in zip(data, labels) if k == c):
                n[x] += 1
            share.append(n / (self.smoothing * 2 + sum(k == c for k in labels)))
        ratio = np.log(share[0] / share[1])
        seen = np.zeros(size)
        for x in data:
            seen[x] += 1
        ratio[seen < self.least] = 0
        rng, w, self.bias = np.random.default_rng(self.seed), np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        square = np.full(size, 1e-8)
        for _ in range(self.epochs):
            for i in rng.permutation(len(data)):
                x = data[i]
                x = x[ratio[x] != 0]
                r = ratio[x]
                g = 1 / (1 + np.exp(-np.clip(self.bias + w[x] @ r, -30, 30))) - y[i]
                step = g * r + self.penalty * w[x]
                square[x] += step * step
                w[x] -= self.rate * step / np.sqrt(square[x])
                self.bias -= 0.02 * g
        self.weights = ratio * w
        return self


class Scorer:
    """Scores batches of texts; remembers the buckets of the words it has seen."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int, sizes: tuple[int, ...]) -> None:
        self.weights, self.bias, self.bits, self.sizes = weights, bias, bits, sizes
        self.stamp = np.zeros(len(weights), np.int64)
        self.forget()

    def forget(self) -> None:
        self.words, self.known = Vocabulary(), 0
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self) -> None:
        new = list(self.words)[self.known :]
        if new:
            own, buckets = word_grams(new, self.bits, self.sizes, False)
            said = self.weights[buckets] != 0
            own, buckets = own[said], buckets[said]
            self.flat = np.concatenate([self.flat, buckets[np.argsort(own, kind="stable")]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(own, minlength=len(new)))])
            self.known = len(self.words)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a in range(0, len(texts), 256):
            if len(self.words) > REMEMBERED:
                self.forget()
            ids = [self.words.ids(list(set(t.lower().split()))) for t in texts[a : a + 256]]
            self.learn()
            for k, i in enumerate(ids):
                first, n = self.ends[i], self.ends[i + 1] - self.ends[i]
                total = int(n.sum())
                if total:
                    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
                    b = self.flat[at]
                    # The last place of each bucket stands for it: every n-gram counts once.
                    self.stamp[b] = np.arange(total)
                    out[a + k] += self.weights[np.sort(b[self.stamp[b] == np.arange(total)])].sum()
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score(docs: DataFrame, model: RatioModel) -> DataFrame:
    """``docs`` with a column ``score``: the probability of label 1, for whole texts.

    Null and empty texts have the probability that the intercept gives. Rows and
    columns stay as they are, a column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, bits, sizes = model.bias, model.bits, model.sizes
    docs, names = numbered(docs, "score")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias, bits, sizes)
        for b in batches:
            found = scorer.scores([t.as_py() or b"" for t in b.column(at).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)])).toDF(*names, "score")


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", rows: int = 4000, **options) -> RatioModel:
    """Train on at most ``rows`` labelled rows for which ``allowed`` holds; without any, all scores are 0.5."""
    data = training_rows(docs, labels, label, allowed, rows)
    return RatioModel(**options).fit([t for t, _ in data], [y for _, y in data])
