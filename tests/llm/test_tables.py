"""Packing, mixing, top-k search and weighted sampling."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from casewatch.llm import cws, mixing, packing, simhash, topk

TEXTS = [(1, "a b c"), (2, None), (3, ""), (4, "w " * 5000), (5, "dup dup"), (5, "dup dup"), (None, "no id"), (7, "É é e"), *[(100 + i, "t " * (i * 37 % 900)) for i in range(150)]]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 5}" if i != 3 else None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, used long")


def test_packing_places_every_token_once(spark):
    out = packing.pack(frame(spark)).collect()
    covered, bins = defaultdict(list), defaultdict(list)
    for r in out:
        covered[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append(r)
    want = Counter()
    for i, t in TEXTS:
        want[i] += len((t or "").split()) + 1
    assert {i: sum(n for _, n in v) for i, v in covered.items()} == dict(want)
    for rows in bins.values():
        used, capacity = sum(r.length for r in rows), rows[0].capacity
        assert used == rows[0].used <= capacity and capacity == min(s for s in packing.SIZES if s >= used)
        assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert sum(r[0].used for r in bins.values()) / sum(r[0].capacity for r in bins.values()) > 0.9
    assert packing.pack(frame(spark, [])).collect() == []


def test_packing_costs_no_more_than_one_size(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 500).tolist()
    plan = packing.pack_shard(lengths)
    assert sorted(i for _, p in plan for i in p) == list(range(500))
    joint = sum(packing.cost(s) for s, _ in plan)
    assert joint <= sum(packing.cost(s) for s, _ in packing.pack_shard(lengths, (2048,)))
    assert joint >= sum(lengths)


def shares(budget, children):
    """Water filling in fractions: children are {name: (weight, cap)}."""
    out, left, open_ = {}, budget, dict(children)
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, c) in open_.items() if c * w <= x * left]
        if not full:
            return out | {k: x * left // w for k, (x, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
        left = budget - sum(out.values())
    return out


def test_mixing_follows_the_tree(spark):
    weights = ({"d0": 3, "d1": 1}, {"en": 4}, {})
    df = frame(spark)
    out = mixing.mix(df, F.when(F.col("source") == "src0", "d0").otherwise("d1"), weights, (1, 2), 2).collect()
    tokens = Counter()
    for i, t in TEXTS:
        lang, source = ("en" if (i or 0) % 2 else mixing.NONE), (f"src{(i or 0) % 5}" if i != 3 else mixing.NONE)
        tokens[("d0" if source == "src0" else "d1", lang, source)] += len((t or "").split())
    tokens = {k: v for k, v in tokens.items() if v}

    def below(prefix):
        found = defaultdict(int)
        for k, v in tokens.items():
            if k[: len(prefix)] == prefix:
                found[k[len(prefix)]] += 2 * v
        return found

    budget, want = sum(tokens.values()) // 2, {}
    tops = shares(budget, {k: (weights[0].get(k, 1), c) for k, c in below(()).items()})
    for d, b in tops.items():
        for lang, b2 in shares(b, {k: (weights[1].get(k, 1), c) for k, c in below((d,)).items()}).items():
            want |= {(d, lang, s): v for s, v in shares(b2, {k: (1, c) for k, c in below((d, lang)).items()}).items()}
    got, largest = Counter(), Counter()
    for r in out:
        got[(r.domain_, r.lang_, r.source_)] += r.n_tokens
        largest[(r.domain_, r.lang_, r.source_)] = 5000
    for k, target in want.items():
        assert target - 5000 <= got[k] <= target
    assert sum(got.values()) <= budget and not any(r.n_tokens == 0 for r in out)
    assert mixing.mix(frame(spark, []), F.lit("d"), weights).count() == 0


def test_mixing_takes_prefixes_of_a_seeded_order(spark):
    df = frame(spark, [(i, "w " * (1 + i % 7)) for i in range(2, 400, 10)])
    out = {(r.doc_id, r.epoch_) for r in mixing.mix(df, F.lit("d"), ({}, {}, {}), (3, 2), 2, seed=9).collect()}
    assert out == {(r.doc_id, r.epoch_) for r in mixing.mix(df.repartition(3), F.lit("d"), ({}, {}, {}), (3, 2), 2, seed=9).collect()}
    by = defaultdict(list)
    for i in range(2, 400, 10):
        by[f"src{i % 5}"].append((hashlib.md5(f"9:1:{i}".encode()).hexdigest(), i, 1 + i % 7))
    for rows in by.values():
        total = sum(n for *_, n in rows)
        rest, so_far = total * 3 // 2 - total, 0
        for _, i, n in sorted(rows):
            so_far += n
            assert (i, 0) in out and ((i, 1) in out) == (so_far <= rest)


def test_top_k_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(0, 700)]
    rows += [(1000 + i, rows[50][1]) for i in range(10)] + [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (None, [0.0] * 16), (3000, rows[0][1]), (3000, rows[0][1]), (50, rows[50][1]), (100, rows[7][1]), (4000, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(df)
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    kept = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for n, (q, x) in enumerate(kept):
        if q % 50 == 0:
            found = sorted((-int(x @ y), i) for m, (i, y) in enumerate(kept) if m != n and len(x) == len(y))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(want)
    # Many cells: floors go from one to the others.
    monkeypatch.setattr(topk, "ROWS", 90)
    monkeypatch.setattr(topk, "QUERIES", 4)
    assert sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()) == sorted(want)
    assert topk.top_k(v.where("vec_id < 0"), v.where("vec_id < 0"), 5).count() == 0


def test_top_k_skips_blocks():
    vectors = np.repeat(np.arange(40)[:, None], 8, axis=1).astype(float)
    found = topk.search_blocks(np.ones((1, 8)), np.array([-1]), vectors, np.arange(40), np.arange(40), 3, block=4)
    assert found == [(0, 39, 312), (0, 38, 304), (0, 37, 296)]
    assert topk.search_blocks(np.ones((1, 8)), np.array([39]), vectors, np.arange(40), np.arange(40), 3, 4, np.array([304.0])) == [(0, 38, 304)]


def test_weighted_sampling(spark):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(60)]
    texts = [(i * 3, " ".join(rng.choice(vocab, 80))) for i in range(600)] + [(5000, None), (5001, ""), (5002, "same words"), (5003, "same words"), (None, "é words"), (5004, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fingerprint string")
    out = cws.fingerprints(df).collect()
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(out) == len(rows) and len(out[0].fingerprint) == 6 * cws.SAMPLES
    got = {r.doc_id: r for r in out}
    errors = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((t, edited, r.near_edited), (t, nxt, r.near_next)):
            x, y = Counter(a.lower().split()), Counter(b.lower().split())
            union = sum((x | y).values())
            errors.append(near - (sum((x & y).values()) / union if union else 1.0))
            assert 0 <= near <= 1
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.13
    assert got[5002].fingerprint == got[5003].fingerprint and got[5002].near_next == 1.0
    assert cws.fingerprints(df.where("false")).count() == 0


def test_ids_that_are_not_numbers_count_as_none(spark):
    docs = spark.createDataFrame([("7", "one two three four five six"), ("x7", "other words are here in this one"), ("", None)], "doc_id string, text string")
    assert sorted({r.doc_id for r in packing.pack(docs).collect()}, key=str) == [7, None]
    assert sorted((r.doc_id for r in cws.with_edited(docs).where("own_").collect()), key=str) == [7, None, None]
    assert sorted((r.doc_id for r in simhash.near_duplicates(docs, shingle=3, distance=3, segments=2).collect()), key=str) == [7, None, None]
