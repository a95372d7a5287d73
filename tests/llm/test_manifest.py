"""The manifest against a plain tree, its descent and tampered rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from casewatch.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """(left, right) of each level below the top."""
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 :][:16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for rank, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            segments = path(trees[s], rank) + path(top, k)
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                given = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            node = sha(*map(field, given))
            for left, right in segments:
                node = sha(left, node, right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in segments)), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append(((k * 7919) % 100_003, s, None if k % 5 == 0 else "en", None if k % 7 == 0 else k, [None, "", "Été ÀB Z", f"Text {k}", "low"][k % 5]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, None: 1, "": 3}, {"b": 300, "é": 33, "Z": 1, "a": 256, None: 20}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_equals_a_plain_tree(spark, monkeypatch, sizes):
    monkeypatch.setattr(manifest, "RANGE", 50)
    rows = documents(sizes)
    want = brute(rows)
    assert got(manifest.verified(frame(spark, rows))) == want
    if len(rows) > 50:
        assert {x[-1] for x in want} == {True, False}


def test_nulls_repeats_and_columns_that_clash(spark):
    rows = documents({"a": 40, None: 5})
    rows += rows[:7] + [(None, "a", None, None, None)] * 20 + [(rows[0][0], "a", "xx", 1, "Other")] + [(1, "a", "en", 9, "T" * 300_000)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("rank", "number", "leaf", "tie", "digest", "a.b", "order", "part_")})
    assert got(manifest.verified(docs)) == brute(rows)


def test_empty(spark):
    out = manifest.verified(frame(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_some_requests(spark):
    """Requests for a few leaves, one of them twice and one that isn't there; records are found by digest alone."""
    docs = frame(spark, documents({"a": 300, "b": 1, "c": 20}))
    made = manifest.build(docs.select("source", F.col("doc_id").alias("order"), manifest.leaf(*[F.col(c) for c in manifest.FIELDS]).alias("leaf")))
    leaves = {(r.number, r.rank): r.leaf for r in made.leaves.collect()}
    asked = [(0, 0), (0, 299), (0, 299), (1, 0), (2, 17), (2, 99), (7, 0)]
    found = manifest.proofs(made, spark.createDataFrame(asked, "number long, rank long").withColumn("segments_", F.lit(1)))
    rows = found.withColumn("root_", manifest.folded(F.udf(lambda n, k: leaves[n, k])("number", "rank"), F.col("segments"))).collect()
    assert sorted((r.number, r.rank) for r in rows) == [(0, 0), (0, 299), (0, 299), (1, 0), (2, 17)]
    assert {r.root_ for r in rows} == {r.root for r in rows} and len({r.root for r in rows}) == 1
    children = {r.digest: r.children for r in made.records.collect()}
    assert all(sha(*c) == d for d, c in children.items()) and max(len(c) for c in children.values()) == 16
