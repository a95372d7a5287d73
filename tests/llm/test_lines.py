"""Line removal against a plain count of documents by line, and its two filters."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import lines

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10):
    """rows: (doc_id, text)."""
    place = lambda i: (i is None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                docs[key(line)].add(place(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(docs[key(x)]) > 1 and min(docs[key(x)]) < place(i))]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def documents():
    rng = random.Random(2)
    pool = [f"A shared line number {k}" for k in range(12)] + ["short", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "ééééééééé", "Kelvin is not kelvin", "kelvin is not kelvin", "", "   \x0b", "123456789", "1234567890"]
    way = [str, str.upper, lambda s: f"  {s}\t\r", lambda s: s + "\x0c", lambda s: " " + s]
    rows = [(k, "\n".join(rng.choice(way)(rng.choice(pool)) if rng.random() < 0.5 else f"line {rng.random()} of its own" for _ in range(rng.randrange(9)))) for k in range(80)]
    return [*rows, (None, "A shared line number 1\nanother of null ids"), (None, "another of null ids"), (81, None), (82, ""), rows[5], (7, "a second text of this id\nA shared line number 2"), (90, "\n".join(f"line {k}" * 3 for k in range(20_000)) * 2)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_a_plain_count(spark, partitions):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    want = brute(rows)
    assert got(lines.without_repeats(docs)) == want and sum(x[3] for x in want) > 50


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With a filter far too small every line is confirmed by shuffling; the result is the same."""
    rows = documents()
    monkeypatch.setattr(lines, "MOST_BITS", lines.BUCKET)
    monkeypatch.setattr(lines, "UNIT", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(lines.without_repeats(docs)) == brute(rows)
    assert lines.suspects(docs, most_bits=lines.BUCKET).count() > lines.suspects(docs, most_bits=1 << 29).count()


def test_few_lines_are_suspected_that_do_not_repeat(spark):
    docs = spark.range(0, 3000, 1, 5).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *[F.concat(F.lit("some line of text "), F.sha1(F.concat_ws("-", "id", F.lit(k)))) for k in range(10)]).alias("text"))
    assert lines.suspects(docs).count() < 0.02 * 30_000


def test_twice_seen_in_one_part_or_two():
    n = np.array([5 << 40, 5 << 40, 9 << 33 | 77 << 16 | 3], np.uint64)
    rows = {r["bucket"]: r for r in lines._filters(list(n), 1 << 13).to_pylist()}
    bucket, p, q = lines.places(n, 1 << 13)
    for b, x, y, twice in zip(bucket, p, q, (True, True, False)):
        bits = lambda s: set(np.flatnonzero(np.unpackbits(lines._bits(s), bitorder="little")))
        assert {int(x), int(y)} <= bits(rows[int(b)]["once"]) and ({int(x), int(y)} <= bits(rows[int(b)]["twice"])) == twice


def test_columns_that_clash_ids_of_other_kinds_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "the very same line", 1), ("a", "The Very Same Line\nmore", 2)], "doc_id string, text string, row int")
    more = docs.withColumns({"own": F.lit(1), "drop_": F.lit("x"), "a.b": F.lit(3), "n_lines": F.lit("old")})
    out = lines.without_repeats(more)
    assert got(out) == [("a", "The Very Same Line\nmore", 2, 0), ("b", "", 1, 1)] and set(more.columns) <= set(out.columns)
    assert lines.without_repeats(docs.limit(0)).count() == 0
