"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: the root, one for each coarse class of the word before, and one for
each fine class of it; a fine class's parent is the coarse class it belongs to,
whose parent is the root, whose base is uniform over the known words and one
unknown. A class is a function of a word's bytes (its ending and, finer, the
whole of a short word), so the number of restaurants is bounded and no
vocabulary is broadcast; every table at which a word is served lies with that
word, whatever the restaurant.

Seating is sampled by Gibbs sweeps. A sweep reseats all customers of every
restaurant given the parents' current predictive and the restaurants' numbers
of tables after the sweep before; each table sends a customer to the parent.
After the burn-in, predictive probabilities are averaged over the sweeps.

Tokens are gathered once, by word: a row carries, for one batch of documents,
the occurrences of the words of one bucket (the class before, the document).
Numbers of tables, a bounded vector, are all that is summed between sweeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .grams import Vocabulary

COARSE, FINER = 64, 32
FINE = COARSE * FINER
#: The end of a text: no token can be a space. Tokens of a row are joined by line ends.
END = b" "
#: Tokens of a batch of documents; characters of texts to a bucket, and buckets at least.
BATCH_TOKENS, BUCKET_CHARS, LEAST_BUCKETS = 4_000_000, 16_000_000, 48
#: Customers of a dish seated one by one; beyond, in blocks of an eighth of those seated.
ONE_BY_ONE = 24


def context_class(word: bytes) -> int:
    """The fine class of a word; its remainder by COARSE is the coarse class. 0 stands for the start of a text."""
    coarse = zlib.crc32(word[-2:]) % (COARSE - 1) + 1
    return coarse + COARSE * (zlib.crc32(word[-4:], 7) % FINER)


def _batches(records: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for b in records:
        for i, text, train in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
            t = text.as_py()
            rows.append((i, t, train))
            size += len(t) // 5
            if size > BATCH_TOKENS or len(rows) == 60_000:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


ROWS = "bucket int, batch long, tokens binary, counts binary, classes binary, places binary, train binary, ids array<bigint>"


def occurrences(docs: DataFrame, train: Column, buckets: int) -> DataFrame:
    """Rows of ROWS: for each batch of documents and bucket of words, who follows which class in which document."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_batches(records)):
            yield _pack(rows, (task << 24) + number, buckets)

    given = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    return given.mapInArrow(run, ROWS)


def _pack(rows: list[tuple], batch: int, buckets: int) -> pa.RecordBatch:
    vocabulary = Vocabulary()
    end = vocabulary[END]
    parts = [np.append(vocabulary.ids(t.lower().split()), end).astype(np.int32) for _, t, _ in rows]
    tokens = list(vocabulary)
    classes = np.fromiter(map(context_class, tokens), np.uint16, len(tokens))
    bucket = np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens)) % buckets
    order = np.argsort(bucket, kind="stable")  # tokens by bucket
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    flat = np.concatenate(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    before = np.zeros(len(flat), np.uint16)
    before[1:] = classes[flat[:-1]]
    before[np.cumsum(lens)[:-1]] = 0
    place = np.repeat(np.arange(len(parts), dtype=np.uint16), lens)
    ranks = rank[flat]
    by = np.argsort(ranks, kind="stable")
    before, place = before[by], place[by]
    times = np.bincount(ranks, minlength=len(order))
    ends = np.concatenate([[0], np.cumsum(times)])
    ids = [i for i, _, _ in rows]
    train = np.array([bool(t) for _, _, t in rows]).tobytes()
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        a, z = cuts[b], cuts[b + 1]
        # Every document has an end, so its id goes along with that alone.
        ends_here = a <= rank[end] < z
        out.append((int(b), batch, b"\n".join([tokens[i] for i in order[a:z]]), times[a:z].astype(np.uint32).tobytes(), before[ends[a] : ends[z]].tobytes(), place[ends[a] : ends[z]].tobytes(), train, ids if ends_here else None))
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


class Bucket:
    """All occurrences of a bucket's words: ``key`` the distinct (word, class), ``count`` of each in training.

    With ``scores`` the keys of other documents are there too, with no count,
    and ``which`` of the keys each occurrence is, ``row`` its document. Seats
    are drawn for keys with customers, in order, so they are the same either way.
    """

    def __init__(self, number: int, rows: list[dict], scores: bool) -> None:
        self.number = number
        vocabulary = Vocabulary()
        keys, places, self.docs = [], [], []
        first = 0
        for r in sorted(rows, key=lambda r: r["batch"]):
            words = vocabulary.ids(r["tokens"].split(b"\n"))
            times = np.frombuffer(r["counts"], np.uint32)
            keys.append(np.repeat(words, times) * FINE + np.frombuffer(r["classes"], np.uint16))
            places.append(np.frombuffer(r["places"], np.uint16).astype(np.int64) + first)
            self.docs.append((r["batch"], np.frombuffer(r["train"], bool), r["ids"]))
            first += len(self.docs[-1][1])
        self.words = list(vocabulary)
        key, self.row = np.concatenate(keys), np.concatenate(places)
        self.train = np.concatenate([t for _, t, _ in self.docs])
        learns = self.train[self.row]
        if scores:
            self.key, self.which = np.unique(key, return_inverse=True)
            self.count = np.bincount(self.which[learns], minlength=len(self.key))
        else:
            self.key, self.count = np.unique(key[learns], return_counts=True)
        self.word, self.fine = self.key // FINE, self.key % FINE
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)


@dataclass
class Totals:
    """What is known of all buckets after a sweep: customers and tables of each restaurant, words, discounts."""

    customers: list[np.ndarray]  # fine, coarse, root
    tables: list[np.ndarray]
    words: int
    tokens: int
    discounts: tuple[float, float, float]
    concentration: float = 1.0


def _seat(rng: np.random.Generator, count: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes with ``count`` customers; weight: (concentration + discount * tables of all) * parent's predictive.

    The k-th customer of a dish opens a table with probability
    weight / (weight + k - discount * tables of the dish).
    """
    tables = np.minimum(count, 1).astype(np.int64)
    live = np.flatnonzero(count > 1)
    seated = 1
    while len(live):
        block = 1 if seated < ONE_BY_ONE else seated // 8
        n = np.minimum(block, count[live] - seated)
        p = weight[live] / (weight[live] + seated - discount * tables[live])
        opened = rng.random(len(live)) < p if block == 1 else rng.binomial(n, np.clip(p, 0, 1))
        tables[live] += opened
        seated += block
        live = live[count[live] > seated]
    return tables


def _sweeps(b: Bucket, history: list[Totals], seed: int) -> Iterator[tuple[list[np.ndarray], Totals]]:
    """State after each sweep, as ((tables by (word, class), by (word, coarse)), by word), predictives), for sweeps 1, 2, ...

    The seats are drawn anew from the same seeds wherever a bucket is visited, so they needn't be kept.
    """
    coarse_key, up = np.unique(b.word * COARSE + b.fine % COARSE, return_inverse=True)
    word_up, coarse = coarse_key // COARSE, coarse_key % COARSE
    n_words = len(b.words)
    t_fine = np.minimum(b.count, 1)
    t_coarse = np.minimum(np.bincount(up, t_fine, len(coarse_key)), 1).astype(np.int64)
    t_root = np.minimum(np.bincount(word_up, t_coarse, n_words), 1).astype(np.int64)
    for s, now in enumerate(history):
        rng = np.random.default_rng([seed, b.number, s])
        p_root, p_coarse, _ = predictive(b, now, (t_fine, t_coarse, t_root), up, word_up, coarse)
        weigh = lambda level, at: now.concentration + now.discounts[level] * now.tables[level][at]
        t_fine = _seat(rng, b.count, weigh(0, b.fine) * p_coarse[up], now.discounts[0])
        c_coarse = np.bincount(up, t_fine, len(coarse_key)).astype(np.int64)
        t_coarse = _seat(rng, c_coarse, weigh(1, coarse) * p_root[word_up], now.discounts[1])
        c_root = np.bincount(word_up, t_coarse, n_words).astype(np.int64)
        t_root = _seat(rng, c_root, np.full(n_words, weigh(2, 0) / (now.words + 1)), now.discounts[2])
        yield (t_fine, t_coarse, t_root), (up, word_up, coarse)


def predictive(b: Bucket, now: Totals, tables: tuple, up: np.ndarray, word_up: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the bucket's words: at the root, by (word, coarse class), by (word, class)."""
    t_fine, t_coarse, t_root = tables
    c_coarse = np.bincount(up, t_fine, len(coarse))
    c_root = np.bincount(word_up, t_coarse, len(b.words))

    def level(i: int, at, count, own, parent):
        d, total = now.discounts[i], now.customers[i][at] + now.concentration
        return (np.maximum(count - d * own, 0) + (now.concentration + d * now.tables[i][at]) * parent) / total

    p_root = level(2, 0, c_root, t_root, 1 / (now.words + 1))
    p_coarse = level(1, coarse, c_coarse, t_coarse, p_root[word_up])
    return p_root, p_coarse, level(0, b.fine, b.count, t_fine, p_coarse[up])


def _sums(b: Bucket, tables: tuple, maps: tuple) -> list[np.ndarray]:
    """Customers and tables by restaurant: fine customers and tables, coarse customers and tables, root ones."""
    (t_fine, t_coarse, t_root), (up, word_up, coarse) = tables, maps
    c_coarse, c_root = np.bincount(up, t_fine, len(coarse)), np.bincount(word_up, t_coarse, len(b.words))
    return [np.bincount(b.fine, b.count, FINE), np.bincount(b.fine, t_fine, FINE), np.bincount(coarse, c_coarse, COARSE), np.bincount(coarse, t_coarse, COARSE), np.array([c_root.sum()]), np.array([t_root.sum()])]


SIZES = (FINE, FINE, COARSE, COARSE, 1, 1)
#: After those: words, and numbers of fine, coarse and root dishes with one and two customers.
EXTRA = 7


def _totals(df: DataFrame) -> np.ndarray:
    """Sums of (place, value) rows as a vector; there are sum(SIZES) + EXTRA places."""
    out = np.zeros(sum(SIZES) + EXTRA)
    for r in df.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def _split(v: np.ndarray) -> list[np.ndarray]:
    return np.split(v[: sum(SIZES)], np.cumsum(SIZES)[:-1])


def _places(values: np.ndarray) -> pa.Table:
    at = np.flatnonzero(values)
    return pa.table({"place": pa.array(at.astype(np.int32)), "value": pa.array(values[at].astype(float))})


def per_bucket(rows: DataFrame, f, schema: str, scores: bool = False) -> DataFrame:
    """``f`` of each bucket. The partitions of ``rows`` are ordered by bucket and hold all rows of those they have, so
    nothing is shuffled again and one bucket at a time is in memory."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in records:
            for r in batch.to_pylist():
                if r["bucket"] != number and held:
                    yield from f(Bucket(number, held, scores)).to_batches()
                    held = []
                number = r["bucket"]
                held.append(r)
        if held:
            yield from f(Bucket(number, held, scores)).to_batches()

    return rows.mapInArrow(run, schema)


def _sweep_on(history: list[Totals], seed: int):
    """A function of a bucket's rows: the sums of its state after as many sweeps as ``history`` is long."""

    def sweep(b: Bucket) -> pa.Table:
        for tables, maps in _sweeps(b, history, seed):
            last = _sums(b, tables, maps)
        return _places(np.concatenate(last))

    return sweep


def score(docs: DataFrame, train: Column, burn_in: int = 2, samples: int = 3, seed: int = 5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train`` says which rows are learnt from. Texts are lower-cased (A-Z only)
    and cut at white space, an end is added to each; null counts as empty, so
    that its one token is the end. base_score is the add-one unigram log10
    probability, score that of the model. Without training rows all tokens are
    unknown and both are 0. Repeated rows are scored each by itself, and count
    each in training. Other columns are ignored; an empty table gives no rows.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    rows = checkpoint(occurrences(docs, train, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket"))

    def start(b: Bucket) -> pa.Table:
        coarse_key, up = np.unique(b.word * COARSE + b.fine % COARSE, return_inverse=True)
        t_fine = np.minimum(b.count, 1)
        c_coarse = np.bincount(up, t_fine, len(coarse_key))
        t_coarse = np.minimum(c_coarse, 1)
        c_root = np.bincount(coarse_key // COARSE, t_coarse, len(b.words))
        t_root = np.minimum(c_root, 1)
        sums = _sums(b, (t_fine, t_coarse, t_root), (up, coarse_key // COARSE, coarse_key % COARSE))
        few = [(c == n).sum() for c in (b.count, c_coarse, c_root) for n in (1, 2)]
        return _places(np.concatenate([*sums, [(b.word_count > 0).sum()], few]))

    first = _totals(per_bucket(rows, start, "place int, value double"))
    words, few = int(first[sum(SIZES)]), first[sum(SIZES) + 1 :].reshape(3, 2)
    # The usual estimate of a discount from the numbers of dishes with one and with two customers.
    discounts = tuple(float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95)) for one, two in few)
    part = _split(first)
    tokens = int(part[0].sum())
    history = [Totals([part[0], part[2], part[4]], [part[1], part[3], part[5]], words, tokens, discounts)]
    for _ in range(burn_in + samples):
        part = _split(_totals(per_bucket(rows, _sweep_on(history, seed), "place int, value double")))
        history = [*history, Totals([part[0], part[2], part[4]], [part[1], part[3], part[5]], words, tokens, discounts)]

    def finish(b: Bucket) -> pa.Table:
        mean = np.zeros(len(b.key))
        for s, (tables, maps) in enumerate(_sweeps(b, history[:-1], seed)):
            if s >= burn_in:
                mean += predictive(b, history[s + 1], tables, *maps)[2] / samples
        base = np.log10((b.word_count + 1) / (tokens + words + 1))[b.word]
        n = np.bincount(b.row, minlength=len(b.train))
        here = np.flatnonzero(n)
        add = lambda x: np.bincount(b.row, x[b.which], len(n))[here]
        sizes = [len(t) for _, t, _ in b.docs]
        ids = pa.chunked_array([pa.array(i if i is not None else [None] * k, pa.int64()) for (_, _, i), k in zip(b.docs, sizes)])
        return pa.table({
            "batch": np.repeat([x[0] for x in b.docs], sizes)[here], "place": np.concatenate([np.arange(k) for k in sizes])[here], "doc_id": ids.take(here),
            "n_tokens": n[here], "n_known": add(((b.word_count > 0)[b.word]).astype(float)).astype(np.int64), "base_score": add(base), "score": add(np.log10(mean)),
        })

    parts = per_bucket(rows, finish, "batch long, place long, doc_id long, n_tokens long, n_known long, base_score double, score double", scores=True)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("batch", "place").agg(F.max("doc_id").alias("doc_id"), *sums).select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
