"""Trigram similarity of names and a set-similarity join over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def trgm(c: Column) -> Column:
    """The set of trigrams of a text: words of letters and digits, lower-cased, two spaces before and one after each."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    x, y = trgm(a), trgm(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


#: Names with one trigram in their prefix from which its list is split.
LIST = 2_000


#: Words of 64 bits that a set's trigrams are marked in.
MARKS = [f"m{i}" for i in range(4)]


def _prefixes(sets: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """(name, n, r, t) for each trigram t of a name's prefix, its place r from 1 and the set's size, and the set's marks: a bit for each trigram by its hash."""
    each = sets.select("name", F.size("g").alias("n"), F.explode("g").alias("t")).join(often, "t")
    line = each.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    bit = f"if(pmod(h, {len(MARKS)}) = %d, m | shiftleft(1L, cast(pmod(shiftright(h, 8), 64) as int)), m)"
    line = line.select("*", F.expr("transform(o, x -> xxhash64(x.t))").alias("h_")).select("*", *[F.expr(f"aggregate(h_, 0L, (m, h) -> {bit % i})").alias(m) for i, m in enumerate(MARKS)])
    length = F.expr(f"n - (n * {percent} + 99) div 100 + 1").cast("int")
    line = line.select("name", "n", *MARKS, F.slice(F.transform("o", lambda x: x["t"]), F.lit(1), length).alias("pre"))
    return line.select("name", "n", *MARKS, F.posexplode("pre").alias("r", "t")).withColumn("r", F.col("r") + 1)


def _split(rows: DataFrame, parts: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of a long list dealt over its parts by their names, once for each part of the other side's list."""
    j = rows.join(parts, "t", "left")
    n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
    return j.withColumn(f"{own}_", F.pmod(F.xxhash64("id"), n)).withColumn(f"{other}_", F.explode(F.sequence(F.lit(0).cast("long"), m - 1))).drop(own, other)


def candidates(left: DataFrame, right: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """(left_name, right_name), each once: pairs of names that may have, or if ``exact`` have, a similarity of ``percent`` / 100.

    With trigrams in one order, from rare to common, the first that two
    similar sets share stands within the first n - ceil(t * n) + 1 of both
    (prefix filter), and what follows it in the shorter rest is long enough for
    the overlap that the similarity asks for (positional filter). Marks that
    differ tell of as many trigrams at least that only one of the sets has, so
    that nearly all pairs which share a trigram by chance are ruled out by a few
    numbers; rows of the lists have no texts, which are fetched for the pairs that are
    left. Lists of names with a common
    trigram are split into parts on both sides; each part meets each.
    """
    # Written once each: names are then told by numbers, and lists of trigrams aren't made again to count them.
    sets = []
    for df in (left, right):
        s = checkpointed(df.select("name").where("name is not null").distinct().withColumn("id", F.monotonically_increasing_id())).withColumn("g", trgm(F.col("name")))
        sets.append(s.where(F.size("g") > 0))
    often = sets[0].select(F.explode("g").alias("t")).union(sets[1].select(F.explode("g").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))
    a, b = (checkpointed(_prefixes(s.select(F.col("id").alias("name"), "g"), often, percent).select("t", F.col("name").alias("id"), "n", "r", *MARKS)) for s in sets)
    count = a.select("t", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("t", F.lit(0), F.lit(1))).groupBy("t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    parts = count.where(F.greatest("x", "y") > LIST).select("t", *[F.greatest(F.ceil(F.col(c) / LIST), F.lit(1)).alias(p) for c, p in (("x", "p"), ("y", "q"))])
    a, b = _split(a, parts, "p", "q").alias("a"), _split(b, parts, "q", "p").alias("b")
    x, y = F.col("a.n"), F.col("b.n")
    near = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    room = (1 + F.least(x - F.col("a.r"), y - F.col("b.r"))) * (100 + percent) >= percent * (x + y)
    apart = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in MARKS[1:]), F.bit_count(F.col(f"a.{MARKS[0]}").bitwiseXOR(F.col(f"b.{MARKS[0]}"))))
    alike = apart * (100 + percent) <= (x + y) * (100 - percent)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "p_", "q_")]
    # One expression, so that what costs most is asked last, and of few pairs.
    met = a.join(b, [*same, F.when(near & room, alike).otherwise(F.lit(False))]).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    named = [s.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("g").alias(f"{side}_g")) for s, side in zip(sets, ("left", "right"))]
    pairs = met.join(named[0], "left_id").join(named[1], "right_id")
    if exact:
        shared = F.size(F.array_intersect("left_g", "right_g"))
        pairs = pairs.where(shared * (100 + percent) >= percent * (F.size("left_g") + F.size("right_g")))
    return pairs.select("left_name", "right_name")


def similarity_join(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(left_name, right_name) of distinct names with similarity of ``percent`` / 100 or more; both sides have one column, ``name``.

    ``candidates``, then the exact sets, in integers.
    """
    return candidates(left, right, percent, exact=True)
