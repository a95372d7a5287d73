"""The filter audit against a plain count of each order, and its packed counters."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from casewatch.llm import audit


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", (True, 1)), place(i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": first[t] < place(i),
        }
        own = [x for x in labels if i is not None and x[0] == i]
        facts.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f[1:] for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(range(len(own)))
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if own[k][0][letter]]
                now = [k for k in left if not own[k][0][letter]]
                failing = [f for f, _, _ in own if f[letter]]
                out[part, order, step] = [len(now), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing), sum(own[k][1] for k in gone), sum(own[k][2] for k in gone)]
                shapley[letter] += len(gone)
                left = now
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def documents():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n\x0b", "ABC", "A" * 50 + " $", "é" * 200, " ".join(words[:100]), "  " + "\r\n".join(words[:99]), " ".join(words[:79] + ["w1"] * 21), " ".join(words[:80] + ["w1"] * 20)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([5, 99, 100, 140]))) + rng.choice(["", "", " #", " HELLO" * 9]) for _ in range(25)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de", "en"])) for _ in range(150)]
    return rows + rows[:9]  # repeated rows


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_plain_counts(spark):
    rows = documents()
    labels = [(i, i % 2, None if i % 3 else 1) for i in range(40)] + [(3, 1, 0), (4, None, 1), (None, 1, 1)]
    docs, marks = frames(spark, rows, labels)
    want = brute(rows, labels)
    assert rows_of(audit.audit(docs, marks)) == want and any(v[2] and v[4] and v[5] for v in want.values())


def test_columns_that_clash_and_empty_tables(spark):
    docs, marks = frames(spark, documents()[:40], [(1, 1, 1)])
    more = docs.withColumns({"mask": F.lit("x"), "n": F.lit(1), "part": F.lit("p"), "a.b": F.lit(2), "good": F.lit(True)})
    assert rows_of(audit.audit(more, marks.withColumn("id", F.lit(9)))) == rows_of(audit.audit(docs, marks))
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert rows_of(audit.audit(docs, marks.limit(0))) == brute(documents()[:40], [])


@pytest.mark.parametrize("n", [1, 2**40 + 12345, (1 << 63) - 1])
def test_fields_do_not_run_over(n):
    masks = audit.packed()
    total = n * masks[31][audit.OUTCOMES.index("removed")]
    assert [int(x) for x in audit.unpacked(total)] == [n if step == 1 else 0 for _, step in audit.STEPS]
    assert len(audit.STEPS) == 600


def test_one_text_over_many_rows(spark):
    """A long text that most rows share: the least id alone isn't a copy."""
    text = "word " * 200_000
    docs, marks = frames(spark, [(k, text, "en") for k in range(3, 60)], [])
    got = rows_of(audit.audit(docs, marks))
    assert got["en", "EABCD", 1][:3] == [1, 56, 0] and got["en", "BEACD", 2][:3] == [0, 0, 56]
