"""Quality classifier on supervised subword embeddings.

Each word, each character n-gram of a word and each pair of neighbouring words
has a learned vector, found by hashing; a document is the average of the
vectors of its features, and a softmax layer turns it into probabilities. The
vectors and the layer are trained by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. As the layer is linear in the average, scoring
first multiplies every vector by the layer: what is broadcast is one number a
bucket, whatever the data's size.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered
from .grams import Vocabulary, pairs, whole_words, word_grams

#: Words a worker remembers before it starts afresh.
REMEMBERED = 200_000


@dataclass
class SubwordModel:
    bits: int = 18
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    epochs: int = 5
    rate: float = 1.0
    seed: int = 7
    vectors: np.ndarray = field(default=None, repr=False)
    layer: np.ndarray = field(default=None, repr=False)

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of a text, the weights summing to 1; bucket 0 is the end of the text."""
        v = Vocabulary()
        ids = v.ids(text.split())
        found = [np.zeros(1, np.int64)]
        if len(ids):
            own, buckets = word_grams(list(v), self.bits, self.sizes, True)
            times = np.bincount(ids)
            found += [np.repeat(buckets, times[own])]
            h = whole_words(list(v))[ids]
            found += [pairs(h[:-1], h[1:], self.bits)]
        buckets, n = np.unique(np.concatenate(found), return_counts=True)
        return buckets, (n / n.sum()).astype(np.float32)

    def fit(self, texts: list[bytes], labels: list[int]) -> SubwordModel:
        rng = np.random.default_rng(self.seed)
        self.vectors = ((rng.random((1 << self.bits, self.dim), np.float32) - 0.5) / self.dim).astype(np.float32)
        self.layer = np.zeros((self.dim, 2), np.float32)
        # All texts' features lie end to end: the memory of two large arrays goes back to the system, that of thousands of small ones does not.
        features, shares, ends = array("i"), array("f"), [0]
        for t in texts:
            buckets, weights = self.features(t)
            features.frombytes(buckets.astype(np.int32).tobytes())
            shares.frombytes(weights.tobytes())
            ends.append(len(features))
        steps, done = self.epochs * len(texts), 0
        for _ in range(self.epochs):
            for i in rng.permutation(len(texts)):
                buckets, weights = (np.frombuffer(x, kind)[ends[i] : ends[i + 1]] for x, kind in ((features, np.int32), (shares, np.float32)))
                rate = self.rate * (1 - done / steps)
                hidden = weights @ self.vectors[buckets]
                z = hidden @ self.layer
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.layer @ p
                self.layer -= rate * np.outer(hidden, p)
                # The gradient of a vector is its weight in the average; divided by the weights' norm, long texts move as far as short ones.
                self.vectors[buckets] -= rate * (weights / np.sqrt(weights @ weights))[:, None] * back
                done += 1
        return self

    def margins(self) -> np.ndarray:
        """log-odds of label 1 that a whole document of one bucket's feature would have."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


class Scorer:
    """Scores batches of texts with a table of margins; remembers words it has seen."""

    def __init__(self, margins: np.ndarray, bits: int, sizes: tuple[int, ...]) -> None:
        self.table, self.bits, self.sizes = margins, bits, sizes
        self.forget()

    def forget(self) -> None:
        self.words, self.known = Vocabulary(), 0
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def learn(self) -> None:
        new = list(self.words)[self.known :]
        if new:
            own, buckets = word_grams(new, self.bits, self.sizes, True)
            self.sums = np.concatenate([self.sums, np.bincount(own, self.table[buckets], len(new))])
            self.counts = np.concatenate([self.counts, np.bincount(own, minlength=len(new))])
            self.hashes = np.concatenate([self.hashes, whole_words(new)])
            self.known = len(self.words)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a in range(0, len(texts), 256):
            if len(self.words) > REMEMBERED:
                self.forget()
            ids = [self.words.ids(t.split()) for t in texts[a : a + 256]]
            self.learn()
            for k, i in enumerate(ids):
                h = self.hashes[i]
                linked = pairs(h[:-1], h[1:], self.bits)
                total = self.table[0] + self.sums[i].sum() + self.table[linked].sum()
                out[a + k] = total / (1 + self.counts[i].sum() + len(linked))
        return 1 / (1 + np.exp(-out))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts, the same on every run: those whose id hashes lowest, then the text.

    ``allowed`` is a condition on doc_id. Labels other than 0 and 1 are left out;
    an id with both labels gives both. The sample is taken on ids first, so that
    texts of its ids alone are read, and again on the rows that repeat them.
    """
    picked = labels.where(F.col(label).isin(0, 1) & allowed).select("doc_id", F.col(label).cast("int").alias("label_")).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id", "label_"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text_")).join(F.broadcast(picked), "doc_id")
    lowest = found.orderBy(F.xxhash64("doc_id", "label_"), "doc_id", F.xxhash64("text_"), F.xxhash64(F.lit(1), "text_")).limit(rows)
    return [(bytes(r.text_), r.label_) for r in lowest.collect()]


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """``docs`` with a column ``score``: the probability of label 1, for whole texts.

    Null and empty texts have the score of the end-of-text feature alone. Rows
    and columns stay as they are, a column named score is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.margins().astype(np.float32))
    bits, sizes = model.bits, model.sizes
    docs, names = numbered(docs, "score")
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.astype(np.float64), bits, sizes)
        for b in batches:
            found = scorer.scores([t.as_py() or b"" for t in b.column(at).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "score"])

    return docs.mapInArrow(run, schema).toDF(*names, "score")


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", rows: int = 2500, **options) -> SubwordModel:
    """Train on at most ``rows`` labelled rows for which ``allowed`` holds.

    Without any such row the model is untrained and scores 0.5 throughout.
    """
    data = training_rows(docs, labels, label, allowed, rows)
    return SubwordModel(**options).fit([t for t, _ in data], [y for _, y in data])
