"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree of domain, language and source. At each node
children share in proportion to their weights; a child that hasn't as many
tokens (times the permitted epochs) gets what it has, and what is lacking goes
to its siblings, in proportion again, before it goes back to the node's own
siblings. Each leaf then yields whole epochs of its documents and, of one more,
the prefix that fits, in an order drawn from seed, epoch and id. Where a leaf's
prefix ends is found by narrowing: sums over 256 ranges of the order tell the one
range that holds the end, sums over 256 parts of that range the next, until few
rows are left; a leaf with any share of the rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_words, small_side, text_key

LEVELS = ("domain_", "lang_", "source_")
#: Hex digits by which the order is narrowed at a time, and the rows of a range that are put in line at last.
DIGITS, LINE = 2, 4_096
NONE = "(none)"


def _weight(name: str, weights: Mapping[str, int], other: int) -> Column:
    w = F.lit(other)
    for value, n in weights.items():
        w = F.when(F.col(name) == value, n).otherwise(w)
    return w.cast("long")


def share_out(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """``nodes`` (parents, weight, cap, budget of the parent) with ``part``, each child's share.

    Children are taken in order of cap / weight; one is filled if its cap is at
    most its share of what the ones before leave. All in integers, shares
    rounded down; no child gets more than its cap.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    line = group.orderBy((F.col("cap") / F.col("weight")), "weight", "cap").rowsBetween(Window.unboundedPreceding, -1)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, gone = F.coalesce(F.sum("cap").over(line), F.lit(0)), F.coalesce(F.sum("weight").over(line), F.lit(0))
    nodes = nodes.withColumn("before_", before).withColumn("weight_left", F.sum("weight").over(whole) - gone)
    nodes = nodes.withColumn("full_", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("budget") - F.col("before_")))
    nodes = nodes.withColumn("left_", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full_"), F.col("cap"))).over(whole), F.lit(0)))
    nodes = nodes.withColumn("sharing_", F.sum(F.when(~F.col("full_"), F.col("weight"))).over(whole))
    part = F.when(F.col("full_"), F.col("cap")).otherwise(F.expr("greatest(0L, weight * left_ div sharing_)"))
    return nodes.withColumn("part", part).drop("before_", "weight_left", "full_", "left_", "sharing_")


def plan(leaves: DataFrame, budget: Column, epochs: int, weights: tuple[Mapping[str, int], ...], other: int = 1) -> DataFrame:
    """(domain_, lang_, source_, tokens, part): the tokens each leaf shall yield; ``leaves`` has its tokens.

    ``budget`` is an aggregate over leaves. Weights are whole numbers above 0;
    names not listed weigh ``other``.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    top = leaves.groupBy().agg(budget.cast("long").alias("budget"), F.sum("cap").alias("cap")).select(F.least("budget", "cap").alias("budget"))
    for depth in range(1, 4):
        names, parents = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        level = leaves.groupBy(*names).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(names[-1], weights[depth - 1], other))
        level = level.join(top, parents) if parents else level.join(F.broadcast(top))  # the latter has one row
        top = share_out(level, parents).select(*names, "tokens", "cap", F.col("part")) if depth == 3 else share_out(level, parents).select(*names, F.col("part").alias("budget"))
    return top.select(*LEVELS, "tokens", "part")


def _ends(placed: DataFrame) -> DataFrame:
    """(domain_, lang_, source_, end): of each leaf the last place of its prefix, all of which sum to ``rest_`` at most.

    ``placed`` has (leaf, rest_, n_tokens, place), place being a struct that
    starts with hex digits. Leaves whose prefix is empty have no row.
    """
    depth, within = 0, placed.withColumn("from_", F.lit(0).cast("long"))
    before, found = Window.partitionBy(*LEVELS).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1), None
    while True:
        depth += DIGITS
        ranges = within.withColumn("range_", F.left("place.digits", F.lit(depth))).groupBy(*LEVELS, "rest_", "from_", "range_")
        ranges = ranges.agg(F.sum("n_tokens").alias("sum_"), F.count("*").alias("rows_"), F.max("place").alias("last"))
        ranges = checkpoint(ranges.withColumn("from_", F.col("from_") + F.coalesce(F.sum("sum_").over(before), F.lit(0))))
        whole = ranges.where("from_ + sum_ <= rest_").groupBy(*LEVELS).agg(F.max("last").alias("end"))
        found = whole if found is None else found.union(whole)
        # The range in which the prefix ends: one a leaf at most.
        cut = small_side(ranges.where("from_ < rest_ and from_ + sum_ > rest_").select(*LEVELS, "range_", "from_", "rows_"))
        most = cut.agg(F.max("rows_")).first()[0] or 0
        within = within.drop("from_").withColumn("range_", F.left("place.digits", F.lit(depth))).join(cut.drop("rows_"), [*LEVELS, "range_"]).drop("range_")
        if most <= LINE or depth + DIGITS > 32:
            break
        within = checkpoint(within)
    line = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = within.withColumn("to_", F.col("from_") + F.sum("n_tokens").over(line)).where("to_ <= rest_").groupBy(*LEVELS).agg(F.max("place").alias("end"))
    return found.union(last).groupBy(*LEVELS).agg(F.max("end").alias("end"))


def mix(docs: DataFrame, domain: Column, weights: tuple[Mapping[str, int], ...], fraction: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """The chosen rows of ``docs``, with domain_, lang_, source_, n_tokens and epoch_ (from 0) added.

    The budget is ``fraction`` of all tokens, in words; a leaf is used ``epochs``
    times at most. Null languages and sources are leaves of their own. Documents
    without words are never chosen. Rows that repeat an id are ordered by a hash
    of their text; rows that repeat both are taken together or not at all where
    the prefix ends. A row chosen in several epochs appears once for each. The
    columns that are added replace any of the same name, all others stay.
    """
    leaf = [domain.alias("domain_"), F.coalesce("lang", F.lit(NONE)).alias("lang_"), F.coalesce("source", F.lit(NONE)).alias("source_")]
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*LEVELS, "n_tokens", "epoch_")])
    narrow = docs.select(F.col("doc_id").cast("string").alias("id"), text_key(F.col("text")).alias("told"), *leaf, n_words(F.col("text")).cast("long").alias("n_tokens"))
    narrow = checkpoint(narrow.where("n_tokens > 0"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = F.expr(f"sum(tokens) * {fraction[0]} div {fraction[1]}")
    leaves = plan(leaves, budget, epochs, weights).select(*LEVELS, F.expr("part div tokens").cast("int").alias("whole_"), F.expr("part % tokens").alias("rest_"))
    leaves = small_side(leaves.where("whole_ > 0 or rest_ > 0"))
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), "whole_", F.coalesce("id", F.lit(NONE))))
    place = F.struct(digits.alias("digits"), F.col("id").alias("id"), F.col("told").alias("told"))
    placed = narrow.join(leaves.where("rest_ > 0"), list(LEVELS)).select(*LEVELS, "rest_", "n_tokens", place.alias("place"))
    # Rows that repeat id and text have one place: they are one step of the order.
    ends = _ends(placed.groupBy(*LEVELS, "rest_", "place").agg(F.sum("n_tokens").alias("n_tokens")))
    facts = small_side(leaves.join(ends, list(LEVELS), "left").select(*LEVELS, "whole_", "end"))
    rows = docs.select(kept.alias("row"), F.col("doc_id").cast("string").alias("id"), text_key(F.col("text")).alias("told"), *leaf, F.col("text").alias("said"))
    rows = rows.where(F.col("said").rlike(r"[^\x20\x09-\x0D]")).join(facts, list(LEVELS))
    times = F.col("whole_") + F.when(F.col("end").isNotNull() & (place <= F.col("end")), 1).otherwise(0)
    rows = rows.withColumn("times_", times).where("times_ > 0")
    out = rows.select("row", *LEVELS, n_words(F.col("said")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("times_") - 1)).alias("epoch_"))
    return out.select("row.*", *LEVELS, "n_tokens", "epoch_")
