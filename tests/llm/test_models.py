"""The two classifiers and the language model."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casewatch.llm import lm, quality, toxicity
from casewatch.llm.common import id_remainder

RNG = np.random.default_rng(0)
GOOD = [f"{a}{b}" for a in ("to", "re", "in", "an", "mu") for b in ("ning", "der", "lia", "ver", "s")]


def documents(n=240):
    """(doc_id, text, lang, source, n_chars, score), labels: bad ones have junk or one word again and again, toxic ones some abuse."""
    docs, labels = [], []
    for i in range(n):
        words = list(RNG.choice(GOOD, 40))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            words = [w + "###" for w in words] if i % 8 else ["again"] * 60
        if toxic:
            words[5] = "stupidity"
        docs.append((i, " ".join(words), "en", "s", 1, "x"))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "a" * 200_000), (10_004, "fine " * 50_000), (10_005, "dup"), (10_005, "dup")]
    return docs + [(i, t, None, None, None, None) for i, t in odd], labels


def frames(spark):
    docs, labels = documents()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(scored, labels, column, threshold):
    got = {r.doc_id: r.score for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and {10_000, 10_001, 10_003} <= set(got)
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    return sum((got[x[0]] >= threshold) == bool(x[column]) for x in held) / len(held)


def test_quality(spark):
    docs, labels, rows = frames(spark)
    model = quality.fit(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"] and scored.count() == docs.count()
    assert accuracy(scored, rows, 1, 0.3) > 0.95
    assert quality.score(docs.where("doc_id < 0"), model).count() == 0


def test_quality_scoring_is_the_average_of_vectors():
    model = quality.SubwordModel(bits=12).fit([b"good words here", b"bad### bad### bad###"] * 20, [1, 0] * 20)
    scorer = quality.Scorer(model.margins(), model.bits, model.sizes)
    for text in (b"good bad### here here", b"", b"x"):
        buckets, weights = model.features(text)
        z = (weights @ model.vectors[buckets]) @ model.layer
        assert abs(scorer.scores([text])[0] - 1 / (1 + math.exp(z[0] - z[1]))) < 1e-5


def test_models_without_labels(spark):
    docs, labels, _ = frames(spark)
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, labels.where("false"), F.lit(True))).collect()} == {0.5}
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"), F.lit(True))).collect()} == {0.5}


def test_columns_of_any_names(spark):
    """Dots, backticks, names that differ in case alone or appear twice; a column named score is replaced."""
    plain = spark.createDataFrame([(1, "some text", 2.0, 3, 4, 5), (2, None, None, None, None, None)], "doc_id long, text string, score double, a int, b int, c int")
    docs = plain.toDF("doc_id", "text", "score", "a.b", "`x`", "a.b")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        out = module.score(docs, module.fit(plain, labels, F.lit(True)))
        assert out.columns == ["doc_id", "text", "a.b", "`x`", "a.b", "score"]
        assert sorted(map(tuple, out.collect())) == [(1, "some text", 3, 4, 5, 0.5), (2, None, None, None, None, 0.5)]


def test_toxicity(spark):
    docs, labels, rows = frames(spark)
    model = toxicity.fit(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    assert accuracy(toxicity.score(docs, model), rows, 2, 0.5) > 0.95


def test_toxicity_scoring_is_the_sum_of_distinct_features():
    model = toxicity.RatioModel(bits=12).fit([b"kind words here", b"vile scum words"] * 20, [0, 1] * 20)
    scorer = toxicity.Scorer(model.weights, model.bias, model.bits, model.sizes)
    for text in (b"vile vile SCUM here", b"", b"kind"):
        z = model.bias + model.weights[model.features(text)].sum()
        assert abs(scorer.scores([text])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def lm_documents():
    rng = np.random.default_rng(4)
    docs = []
    for i in range(80):
        pairs = [(f"{a}x", f"{a}y") for a in rng.choice(list("abcdef"), 30)]
        docs.append((i, " ".join(w for p in pairs for w in p), "en"))
    return docs + [(900, None, None), (901, "", None), (902, "NEW É é\x0btab", None), (903, "rep", None), (903, "rep", None), (None, "none", None), (904, "ax ay " * 20_000, None)]


def test_language_model(spark):
    docs = lm_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    train = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    rows = lm.score(df, id_remainder(F.col("doc_id"), 7) != 2).collect()
    tokens = [((i, (t or "").encode().lower().split() + [b" "])) for i, t, _ in docs]
    c = Counter(w for i, ws in tokens if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 80 and not train(r.doc_id)]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in rows)


def test_language_model_predictions_are_probabilities():
    """Over all known words and the unknown one, what each context foretells sums to 1."""
    rows = [(i, f"{a}x {a}y {a}x b".encode(), True) for i, a in enumerate("aabbccdd")]
    packed = lm._pack(rows, 0, 1).to_pylist()
    b = lm.Bucket(0, packed, False)
    every = np.arange(len(b.words))
    for fine in np.unique(b.fine):
        missing = np.setdiff1d(every * lm.FINE + fine, b.key)
        b.key, b.count = np.concatenate([b.key, missing]), np.concatenate([b.count, np.zeros(len(missing), int)])
    b.word, b.fine = b.key // lm.FINE, b.key % lm.FINE
    up_key, up = np.unique(b.word * lm.COARSE + b.fine % lm.COARSE, return_inverse=True)
    start = np.minimum(b.count, 1), np.minimum(np.bincount(up, np.minimum(b.count, 1)), 1), None
    start = (*start[:2], np.minimum(np.bincount(up_key // lm.COARSE, start[1]), 1))
    sums = lm._sums(b, start, (up, up_key // lm.COARSE, up_key % lm.COARSE))
    now = lm.Totals([sums[0], sums[2], sums[4]], [sums[1], sums[3], sums[5]], len(b.words), int(sums[0].sum()), (0.7, 0.6, 0.5))
    history = [now]
    tables, maps = list(lm._sweeps(b, history, 1))[-1]
    sums = lm._sums(b, tables, maps)
    now = lm.Totals([sums[0], sums[2], sums[4]], [sums[1], sums[3], sums[5]], len(b.words), int(sums[0].sum()), (0.7, 0.6, 0.5))
    root, _, p = lm.predictive(b, now, tables, *maps)
    unknown = (now.concentration + 0.5 * now.tables[2][0]) / (now.customers[2][0] + now.concentration) / (len(b.words) + 1)
    assert abs(root.sum() + unknown - 1) < 1e-9
    for fine in np.unique(b.fine):
        w1, w2 = ((now.concentration + d * now.tables[i][at]) / (now.customers[i][at] + now.concentration) for i, d, at in ((0, 0.7, fine), (1, 0.6, fine % lm.COARSE)))
        assert abs(p[b.fine == fine].sum() + w1 * w2 * unknown - 1) < 1e-9
