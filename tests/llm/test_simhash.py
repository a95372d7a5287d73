"""SimHash near-duplicates against brute force."""

import numpy as np
import xxhash

from casewatch.llm import common, simhash
from casewatch.llm.common import components

SCHEMA = "doc_id long, text string, component_id string"  # a clashing name among the columns


def brute(texts, shingle, distance):
    """Component and fingerprint of each (id, text)."""

    def bits(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    ids, fps = [i for i, _ in texts], [bits(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, f"{fps[i]:016x}", least[find(i)]) for i, k in enumerate(ids))


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        words = list(rng.choice(vocab, int(rng.integers(1, 400))))
        out.append((i * 10, " ".join(words)))
        for j in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = "changed"
            out.append((i * 10 + j + 1, "\t ".join(words).upper()))
    return [*out, (9001, None), (9002, ""), (9003, " \n"), (9004, "É é"), (9005, "one"), (9005, "one"), (9006, "x " * 30_000)]


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], SCHEMA)
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert got == brute(texts, 3, 3)


def test_no_link_is_missed_at_any_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20)
    fps = {int(b) for b in base}
    for b in base:
        for n in range(6):
            x = int(b)
            for k in rng.choice(63, n, replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    df = spark.createDataFrame([(f, f, f, False, None) for f in fps], "fp long, node long, group long, many boolean, bound " + simhash.BOUND)
    for distance, segments in ((3, 2), (3, 4), (5, 3)):
        want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
        assert {tuple(r) for r in simhash.crossing_links(simhash.full_balls(df, distance, segments), distance).collect()} == want


def test_crowded_entries_lose_no_link(spark, monkeypatch):
    """With leaders drawn for entries of several rows components are those of brute force, chains among them."""
    monkeypatch.setattr(simhash, "CROWD", 1)
    texts = corpus()
    words = [f"w{i}" for i in range(120)]
    for i in range(40):  # each differs a little from the one before: the ends of the chain are no near copies
        words[3 * i] = f"chain{i}"
        texts.append((20_000 + i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], SCHEMA)
    assert sorted(tuple(r) for r in simhash.near_duplicates(df, 3, 5, 3).collect()) == brute(texts, 3, 5)


def test_empty_and_missing_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, "a b c d", ""), (5, "a b c d", ""), (None, "z", "")], SCHEMA)
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert out == {(None, 5), (5, 5), (None, None)}


def groups(spark, texts):
    """component_id of each id, by the pipeline's setting."""
    df = spark.createDataFrame([(i, t, "") for i, t in texts], SCHEMA)
    return {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}


def jaccard(a, b):
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_large_groups_of_near_copies_are_joined(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocab, 300))
    texts = []
    for i in range(300):
        words = list(base)
        for _ in range(i % 4):
            words[int(rng.integers(300))] = f"e{rng.integers(10**6)}"
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, " ".join(rng.choice(vocab, 300))) for i in range(60)]
    out = groups(spark, texts)
    assert {out[i] for i in range(300)} == {0}
    assert all(out[1000 + i] == 1000 + i for i in range(60))


def test_a_dense_cluster_below_the_limit(spark, monkeypatch):
    """Copies with edits of their own, so that most pairs are just under the limit: the same groups as by brute force."""
    monkeypatch.setattr(simhash, "CROWD", 8)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(90, 1 + i % 5, replace=False):
            words[k] = f"e{i}x{k}"
        texts.append((i, " ".join(words)))
    out = groups(spark, texts)
    root = list(range(120))
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for _, t in texts]
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [out[i] for i in range(120)] == root and len(set(root)) > 10


def test_links_are_those_of_brute_force(spark, monkeypatch):
    """Of all pairs of a corpus with edits of every kind, by range of similarity, hardly one is missed, and none below the limit is linked."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(700):
        n = int(rng.integers(9, 200))
        words = [f"g{i}w{k}" for k in range(n)]
        other = list(words)
        kind, much = i % 3, float(rng.uniform(0.0, 0.3))
        if kind == 0:
            other = words[: max(1, int(n * (1 - much)))]
        elif kind == 1:
            for k in rng.integers(0, n, max(1, int(n * much / 6))):
                other[k] = "x"
        else:
            other = [*[f"h{i}w{k}" for k in range(int(n * much / 2))], *words, *[f"i{i}w{k}" for k in range(int(n * much / 2))]]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    # One line over and over with unlike ends: the line outweighs the rest in a count, not in a set.
    texts += [(5000 + i, "again and again and so on " * 40 + " ".join(f"e{i}x{k}" for k in range(60))) for i in range(2)]
    out, by = groups(spark, texts), dict(texts)
    found = {}
    for i in range(700):
        j = jaccard(by[2 * i], by[2 * i + 1])
        found.setdefault(min(int(j * 20), 19), []).append((j, out[2 * i + 1] == 2 * i))
    assert not any(same for rows in found.values() for j, same in rows if j < 0.8)
    for at, rows in found.items():
        if at >= 16:
            assert len(rows) > 20 and sum(same for _, same in rows) >= 0.97 * len(rows), (at, len(rows))
    assert out[5001] == 5001


def test_one_row_of_each_group_survives(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long, "a"), (2, long, "b"), (2, "quite another text with the same id", "c"), (None, long, "d"), (None, "no id here", "e"), (3, None, "f"), (4, "", "g"), (7, "said twice over", "h"), (7, "said twice over", "g"), (8, long + " more", "i")]
    df = spark.createDataFrame([(i, t, "x", "y", k) for i, t, k in rows], "doc_id long, text string, root string, row string, told string")
    out = simhash.survivors(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.told) for r in out.collect()) == [("1", "a"), ("2", "c"), ("3", "f"), ("7", "g"), ("None", "e")]
    assert simhash.survivors(df.where("false")).collect() == []


def test_rows_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """Of unlike texts hardly a pair goes on to be verified, though many share a segment; near copies all do."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 40))) for i in range(3000)]
    texts += [(5000 + i, t + " more") for i, t in texts[:100]]
    seen, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    out = groups(spark, texts)
    assert all(out[5000 + i] == i for i in range(100)) and len(set(out.values())) == 3000
    assert sum(seen) < 500


def test_a_group_that_is_small_beside_the_table_makes_no_square_of_pairs(spark, monkeypatch):
    """Near copies that crowd entries are joined by leaders also where all the pairs they make are fewer than the table's rows."""
    monkeypatch.setattr(simhash, "CROWD", 8)
    rng = np.random.default_rng(8)
    texts = [(1000 + i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 20))) for i in range(4000)]
    for i in range(60):
        texts.append((i, " ".join(f"e{i}" if k == 2 * i else f"b{k}" for k in range(120))))
    seen, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    out = groups(spark, texts)
    assert {out[i] for i in range(60)} == {0} and all(out[1000 + i] == 1000 + i for i in range(4000))
    assert sum(seen) < 600  # all pairs are 1,770


def test_tables_grow_with_the_corpus():
    """Texts that share an entry by chance stay as many, a pair at the limit is as seldom missed."""
    for n in (10_000, 10**6, 10**9):
        segments, width, whole, word = simhash.sizes(n, 0.8)
        assert n / 2**width <= 4 and segments * width < 100 * 64 and word < 24 and whole < 0.28 * (segments * width + 64)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + i) for i in range(1, 40)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100, **{500 + i: 500 for i in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_and_large_graphs_have_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 1500, (1000, 2))] + [(2000 + i, 2001 + i) for i in range(40)] + [(3000, 3000 + i) for i in range(50)]
    df, sc = spark.createDataFrame(edges, "a long, b long"), spark.sparkContext
    sc.setJobGroup("components", "")
    small = sorted(tuple(r) for r in components(df).collect())
    jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    sc.setJobGroup("", "")
    monkeypatch.setattr(common, "EDGES", 600)
    assert small == sorted(tuple(r) for r in components(df).collect())
    # A round over a small graph is written once and summed up once, not step by step.
    assert jobs < 70
