"""Audit of how filters interact: what each removes at each step of each order they can be applied in.

Of a document only its mask counts, a bit for each filter it fails. A mask
fixes the outcome of every step of every order: a step removes the document,
finds it gone already, or lets it pass. Wide packed counters hold these: each
mask maps to big integers with a field of ``FIELD`` bits for each (order, step),
1 where the outcome occurs. Spark counts the documents of each (part, mask,
labels); a part's integers, times these counts, are summed, and the fields of
the sum are the counts of all steps at once. A field's sum is at most the
number of rows, which is below 2**63, so that none runs over into the next.

The texts never move. Each is measured where it is read; copies are found by
sha256 and all later tables have a few narrow columns. A text that a third of
all rows share is counted by (part, mask, labels) before its rows meet, and an
id that many rows share by its texts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
#: Bits of a field.
FIELD = 64
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
SPACE = " \t\n\x0b\f\r"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Bits 0 to 3: what a text fails by itself; a null text is an empty one.

    A, under 100 words; B, under 80 of 100 words distinct; C, over 10 of 100
    characters in A-Z; D, any of ``#$%&*|``. An empty text fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    # A-Z are the characters that take one byte each and go.
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")
    mask = F.lit(0)
    for k, failed in enumerate(bits):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    return mask


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each (part, mask, good, toxic), counted; the mask has bit 4 where a smaller id has the same text.

    A null id is larger than all others, and null ids are equal; rows of one id
    and text are both first or both not. A null language is the part "".
    An id that several rows of ``labels`` have is good or toxic if one says so.
    """
    own = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    own = own.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where("(quality = 1 OR toxic = 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    own = own.join(marks, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no), "order": F.struct(F.col("id").isNull().alias("none"), "id")})
    # Rows of a text by what else counts of them: their number, the first id, and the number of rows that have it.
    own = own.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("order").alias("order"), F.min(F.struct("order", "n")).alias("first"))
    own = own.withColumn("least", F.min("order").over(Window.partitionBy("digest")))
    firsts = F.when(F.col("order") == F.col("least"), F.col("first.n")).otherwise(0)
    both = own.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), firsts.alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("n") - firsts).alias("n")))).alias("x"))
    return both.where("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.copy")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def outcome(mask: int, order: str, step: int) -> tuple[bool, bool, bool, bool]:
    """Of a document with this mask after a step: is it kept, was it removed here, does it fail but was gone, does it fail this filter alone."""
    fails = [bool(mask >> FILTERS.index(f) & 1) for f in order[:step]]
    gone = any(fails[:-1])
    return not any(fails), fails[-1] and not gone, fails[-1] and gone, mask == 1 << FILTERS.index(order[step - 1])


def packed() -> list[tuple[int, ...]]:
    """For each mask, an integer for each of ``OUTCOMES``; the field of the k-th of ``STEPS`` begins at bit k * FIELD."""
    out = []
    for mask in range(1 << len(FILTERS)):
        sums = [0] * len(OUTCOMES)
        for k, (order, step) in enumerate(STEPS):
            for i, occurs in enumerate(outcome(mask, order, step)):
                sums[i] |= int(occurs) << FIELD * k
        out.append(tuple(sums))
    return out


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum, in the order of ``STEPS``."""
    return np.frombuffer(total.to_bytes(len(STEPS) * FIELD // 8, "little"), "<i8")


def report(counts: pd.DataFrame, masks: list[tuple[int, ...]]) -> pd.DataFrame:
    """All steps of one part, from its counts by mask and labels."""
    totals, lost = [0] * len(OUTCOMES), {"good": 0, "toxic": 0}
    removed = OUTCOMES.index("removed")
    for mask, good, toxic, n in zip(counts["mask"], counts["good"], counts["toxic"], counts["n"]):
        totals = [t + int(n) * x for t, x in zip(totals, masks[mask])]
        lost["good"] += int(n) * masks[mask][removed] * bool(good)
        lost["toxic"] += int(n) * masks[mask][removed] * bool(toxic)
    out = pd.DataFrame({"part": counts["part"].iloc[0], "filter_order": [o for o, _ in STEPS], "step": np.array([s for _, s in STEPS], np.int32)})
    for name, total in zip(OUTCOMES, totals):
        out[name] = unpacked(total)
    out["good_lost"], out["toxic_lost"] = unpacked(lost["good"]), unpacked(lost["toxic"])
    letter = np.array([o[s - 1] for o, s in STEPS])
    out["shapley"] = out["removed"].groupby(letter).transform("sum")
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with zeros: 600 a part.

    Counts are of rows: repeated rows count each. Null and empty texts are
    copies of each other; empty tables give no rows, documents without labels
    are neither good nor toxic. Other columns are not read, whatever their names.
    """
    masks = packed()
    # At most four rows for each mask of a part.
    return masked(docs, labels).groupBy("part").applyInPandas(lambda counts: report(counts, masks), RESULT)
