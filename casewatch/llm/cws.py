"""Document fingerprints by improved consistent weighted sampling.

A document is a weighted set: its lower-cased words with their numbers of
occurrences. For sample k and term t, two gamma(2, 1) variables r and c and a
uniform b are drawn from a hash of (t, k). With weight S,

    step = floor(ln S / r + b),    ln a = ln c - r * (step - b + 1)

and the sample is the (t, step) of least a. Two documents have the same k-th
sample with probability equal to their generalised Jaccard similarity,
sum(min) / sum(max), so the share of equal samples estimates it. The least is
found as a long: ln a in its upper 40 bits, a hash of (t, step) in the lower 24,
which are what the fingerprint keeps. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, small_side

#: Samples of a fingerprint. The standard error of a likeness p is sqrt(p * (1 - p) / SAMPLES).
SAMPLES = 48
#: Samples that are taken together.
CHUNK = 8
#: Runs of rows without an id, at most; characters of texts to a partition.
NAMELESS, PART_CHARS = 1 << 20, 4_000_000
#: Of a sample that has no term.
EMPTY = -1
_HALF = float(1 << 32)


def _uniforms(seed: Column, n: Column) -> tuple[Column, Column]:
    """Two uniform numbers, above 0 and below 1, from the n-th hash of a term."""
    h = F.xxhash64(seed, n)
    low = h.bitwiseAND(F.lit((1 << 32) - 1))
    return (low + 0.5) / _HALF, (F.shiftrightunsigned(h, 32) + 0.5) / _HALF


def _draw(term: Column, k: Column) -> Column:
    """What the k-th sample draws for a term, whatever its weight: r, ln c and b."""
    u1, u2 = _uniforms(term, 3 * k)
    u3, u4 = _uniforms(term, 3 * k + 1)
    b, _ = _uniforms(term, 3 * k + 2)
    return F.struct((-F.ln(u1 * u2)).alias("r"), F.ln(-F.ln(u3 * u4)).alias("c"), b.alias("b"))


def _sample(term: Column, log_weight: Column, draw: Column) -> Column:
    """A sample of a term as a long, the less the sooner it is chosen; null where the weight is."""
    step = F.floor(log_weight / draw["r"] + draw["b"])
    least = draw["c"] - draw["r"] * (step - draw["b"] + 1)
    return F.shiftleft(F.floor(least * (1 << 28)), 24).bitwiseOR(F.xxhash64(term, step).bitwiseAND(F.lit((1 << 24) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, as arrays; two without any term are alike."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _code(least: Column) -> Column:
    return F.coalesce(least.bitwiseAND(F.lit((1 << 24) - 1)), F.lit(EMPTY))


def _hex(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.when(c == EMPTY, "------").otherwise(F.lpad(F.lower(F.hex(c)), 6, "0"))), "")


def _heads(rows: DataFrame) -> DataFrame:
    """(run_, head, into): the least id of each run, and the run before, after whose rows it comes next.

    Runs are put in line by ranges, each in its own task; only the ranges' ends meet in one.
    """
    heads = rows.groupBy("run_").agg(F.min("doc_id").alias("head"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = checkpoint(heads.repartitionByRange(parts, "run_").withColumn("part", F.spark_partition_id()))
    line, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = heads.groupBy("part").agg(F.max("run_").alias("last"))
    ends = ends.select("part", F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("prior"))
    before = F.lag("run_").over(Window.partitionBy("part").orderBy("run_"))
    return heads.withColumn("before", before).join(F.broadcast(ends), "part").select("run_", "head", F.coalesce("before", "prior").alias("into"))


def with_edited(docs: DataFrame, run: int = 256) -> DataFrame:
    """(run_, place, own_, doc_id, text, edited) of every row, dealt by runs of consecutive ids.

    edited is the text whose last half is replaced by the start of the next
    document in order of id, then text; rows without an id come first, in order
    of a hash of their texts, by which they are dealt to runs too. So that the
    next one is at hand, the first row of each run is copied to the end of the
    run before it, the very first to the end of the last; copies have own_ false.
    """
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    nameless = F.pmod(F.xxhash64("text"), F.lit(NAMELESS)) - (1 << 62)
    rows = rows.withColumn("run_", F.coalesce(F.floor(F.col("doc_id") / run), nameless))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    heads = small_side(_heads(rows.select("doc_id", "run_")))
    copies = rows.join(heads, "run_").where(F.col("doc_id").eqNullSafe(F.col("head")))
    copies = copies.groupBy("into", "doc_id").agg(F.min("text").alias("text")).select(F.lit(False).alias("own_"), F.col("into").alias("run_"), "doc_id", "text")
    line = Window.partitionBy("run_").orderBy(F.desc("own_"), "doc_id", "text")
    all_rows = rows.select(F.lit(True).alias("own_"), "run_", "doc_id", "text").union(copies)
    # As many partitions as keep the terms of one in memory.
    all_rows = all_rows.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_CHARS), "run_")
    all_rows = all_rows.select("*", F.row_number().over(line).alias("place"), F.lead("text").over(line).alias("next_"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.when(F.col("own_"), F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("next_", "text"), half)))
    return all_rows.select("run_", "place", "own_", "doc_id", "text", edited.alias("edited"))


def signatures(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(run_, place, a, b): codes of each row's text and edited text.

    Samples are taken a few at a time, so that what is compiled for them stays
    small; all is grouped within runs, by which the rows are dealt already.
    """
    both = F.array(F.struct(F.lit(True).alias("first"), F.col("text").alias("t")), F.struct(F.lit(False).alias("first"), F.col("edited").alias("t")))
    texts = rows.select("run_", "place", F.explode(both).alias("x"))
    # A text without words gives one empty word, which weighs nothing: its row stays.
    words = texts.select("run_", "place", "x.first", F.explode(F.split(F.lower("x.t"), SPACES)).alias("word"))
    one = lambda c: F.sum(F.when(c & (F.col("word") != ""), 1).otherwise(0))
    terms = words.groupBy("run_", "place", F.xxhash64("word").alias("term")).agg(one(F.col("first")).alias("in_a"), one(~F.col("first")).alias("in_b"))
    logs = [F.when(F.col(c) > 0, F.ln(c)).alias(c) for c in ("in_a", "in_b")]
    chunks = terms.select("run_", "place", "term", *logs, F.explode(F.sequence(F.lit(0), F.lit(samples // CHUNK - 1))).alias("chunk"))
    drawn = chunks.select("run_", "place", "chunk", "term", "in_a", "in_b", *[_draw(F.col("term"), F.col("chunk") * CHUNK + j).alias(f"d{j}") for j in range(CHUNK)])
    least = [F.min(_sample(F.col("term"), F.col(side), F.col(f"d{j}"))).alias(f"{side}{j}") for side in ("in_a", "in_b") for j in range(CHUNK)]
    found = drawn.groupBy("run_", "place", "chunk").agg(*least)
    codes = lambda side: F.array(*[_code(F.col(f"{side}{j}")) for j in range(CHUNK)])
    parts = found.groupBy("run_", "place").agg(F.array_sort(F.collect_list(F.struct("chunk", codes("in_a").alias("a"), codes("in_b").alias("b")))).alias("parts"))
    return parts.select("run_", "place", F.flatten(F.transform("parts", lambda p: p["a"])).alias("a"), F.flatten(F.transform("parts", lambda p: p["b"])).alias("b"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every row of ``docs``, of its edited text and its likeness to that and to the next row.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (six
    hex digits a sample; dashes where a text has no word), near_edited and
    near_next. Null texts count as empty; two texts without words are alike.
    Repeated rows are each other's next and have equal fingerprints. Other
    columns are ignored; an empty table gives an empty result. ``samples`` is a
    multiple of CHUNK.
    """
    rows = with_edited(docs)
    facts = rows.select("run_", "place", "own_", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = signatures(rows, samples).join(facts, ["run_", "place"])
    both = both.withColumn("next_", F.lead("a").over(Window.partitionBy("run_").orderBy("place"))).where("own_")
    return both.select("doc_id", "n_chars", "edited_sha256", _hex(F.col("a")).alias("fingerprint"), _hex(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_")).alias("near_next"))
