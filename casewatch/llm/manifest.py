"""Merkle manifest of a dataset, and proofs that a row belongs to it.

Leaves are digests of rows; per source, runs of ``FANOUT`` of them become one
node, level by level, to a subroot; subroots become the root likewise. The tree
is kept content-addressed: a table of records from a node's digest to those of
its children, and nothing about who its parent is. Proofs come from descent of
that graph: requests are leaf ranks, whose digits in base ``FANOUT`` name the
child to take at each node from the root down; what isn't taken is collected
as the path's segment of that level, and the segments are reversed at the end.

Requests that share leading digits go down together, one row for each node that
any of them passes, so that the root is looked up once and not by every leaf.
Ranks are given without sorting in one task: rows are dealt by ranges of
(source, order), numbered where they lie, and shifted by the counts of the
ranges before. A source with a third of all rows is spread over a third of the
ranges. Texts are read once, for the leaves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_side

FANOUT = 16
#: Rows to a range, and most ranges: beyond, they get longer.
RANGE, RANGES = 20_000, 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """What ``build`` makes.

    leaves: number (the source's, in order), rank, leaf, and the columns of the rows' table that ``build`` was told to keep.
    records: digest, children (its children's digests, in order), each digest once.
    sources: number, source, n (leaves), height, subroot, root.
    """

    leaves: DataFrame
    records: DataFrame
    sources: DataFrame


def field(value: Column) -> Column:
    """A field as it enters a leaf's digest: ``-`` for null, else its length in bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, from 0, of each row among those of equal ``by``, in ``order`` (nulls first). ``order`` must be total.

    No task sorts more than a range of rows. The ranges' counts, a row for each
    range and each group in it, are summed by group.
    """
    parts = min(max(1, -(-df.count() // RANGE)), RANGES)
    lying = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    lying = checkpoint(lying.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    counts = lying.groupBy("part_", *by).agg(F.min("at_").alias("from_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(F.col("part_").alias("p_"), *[F.col(c).alias(f"{c}_k") for c in by], (before - F.col("from_")).alias("shift_"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in by]
    return lying.join(small_side(shift), [F.col("part_") == F.col("p_"), *same]).withColumn("rank", F.col("at_") + F.col("shift_")).drop("part_", "at_", "p_", "shift_", *[f"{c}_k" for c in by])


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes one level up, with their children: (number, n, rank, digest, children)."""
    above = F.ceil(F.col("n") / FANOUT).alias("n"), F.expr(f"rank div {FANOUT}").alias("rank")
    runs = nodes.groupBy("number", *above).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), "digest"))).alias("run"))
    runs = runs.select("number", "n", "rank", F.transform("run", lambda x: x["digest"]).alias("children"))
    return runs.select("number", "n", "rank", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def _grown(nodes: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Records of the trees over leaves (number, n, rank, digest), and (number, digest) of their roots.

    n is the number of leaves of a tree, ``most`` at most. A tree that has one node left doesn't go further up.
    """
    records, roots = [], []
    for _ in range(_height(most)):
        roots.append(nodes.where("n = 1").select("number", "digest"))
        nodes = checkpoint(_above(nodes.where("n > 1")))
        records.append(nodes.select("digest", "children"))
    return _union(records), _union([*roots, nodes.where("n = 1").select("number", "digest")])


def _union(tables: list[DataFrame]) -> DataFrame | None:
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows (source, order, leaf, ...): leaves of a source ascend by ``order``, null first, ties by leaf.

    Rows that are equal in all three are leaves each. Sources ascend by their
    bytes, null first. An empty table has no leaves, no records and no sources.
    """
    rows = checkpoint(rows.withColumn("tie", F.monotonically_increasing_id()))
    leaves = ranked(rows, ["source"], ["order", "leaf", "tie"])
    sizes = checkpoint(rows.groupBy("source").agg(F.count("*").alias("n")))
    sources = checkpoint(ranked(sizes, [], ["source"]).withColumnRenamed("rank", "number"))
    key = sources.select("number", "n", F.col("source").alias("s_"))
    leaves = checkpoint(leaves.join(small_side(key), F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "tie"))
    most, n_sources = sources.agg(F.max("n"), F.count("*")).first()
    spark = rows.sparkSession
    if not n_sources:
        none = spark.createDataFrame([], "digest string, children array<string>")
        return Manifest(leaves, none, sources.select("number", "source", "n", F.lit(0).alias("height"), F.lit("").alias("subroot"), F.lit("").alias("root")))
    nodes = leaves.select("number", "n", "rank", F.col("leaf").alias("digest"))
    records, subroots = _grown(nodes, most)
    subroots = checkpoint(subroots)
    top = subroots.select(F.lit(0).cast("long").alias("number"), F.lit(n_sources).cast("long").alias("n"), F.col("number").alias("rank"), "digest")
    upper, roots = _grown(top, n_sources)
    records = _union([r for r in (records, upper) if r is not None])
    records = spark.createDataFrame([], "digest string, children array<string>") if records is None else records
    root = roots.first()["digest"]
    heights = F.lit(0)
    for h in range(_height(most)):
        heights = heights + F.when(F.col("n") > FANOUT**h, 1).otherwise(0)
    sources = sources.join(subroots.withColumnRenamed("digest", "subroot"), "number").select("number", "source", "n", heights.alias("height"), "subroot", F.lit(root).alias("root"))
    # A node's digest follows from its children: what repeats is the same record.
    return Manifest(leaves, checkpoint(records.dropDuplicates(["digest"])), checkpoint(sources))


def _segment(children: Column, digit: Column) -> Column:
    """The unselected children to the left and to the right of the one taken, joined."""
    digit = digit.cast("int")
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, digit + 2, F.size(children)), "").alias("right"))


def _down(passing: DataFrame, records: DataFrame) -> DataFrame:
    """One level down from nodes (keys, rank, digest, segments): each child with its rank and the path's segments."""
    below = passing.join(records, "digest").select("number", "height", "rank", "segments", F.posexplode("children").alias("digit", "digest"), "children")
    return below.select("number", "height", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), "digest", F.concat("segments", F.array(_segment(F.col("children"), F.col("digit")))).alias("segments"))


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (number, rank, ...) with ``subroot``, ``root`` and ``segments``, the siblings on the way up.

    A segment is what stands left and right of the path at one level, from the
    leaf's to that below the root. Requests for leaves that the manifest hasn't
    got have no row; repeated requests have one each.
    """
    spark = requests.sparkSession
    wanted = requests.join(small_side(manifest.sources.select("number", F.col("height").alias("h_"))), "number")
    # Nodes above the leaves that any request passes, by (number, height above the leaves, rank).
    n_sources, most, root = manifest.sources.agg(F.count("*"), F.max("height"), F.max("root")).first()
    none = "array<struct<left:string,right:string>>"
    if not n_sources:
        return requests.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(none).alias("segments")).limit(0)
    passed = {1: checkpoint(wanted.where("h_ > 0").select("number", F.expr(f"rank div {FANOUT}").alias("rank"), "h_").distinct())}
    for level in range(2, most + 1):
        passed[level] = passed[level - 1].where(F.col("h_") >= level).select("number", F.expr(f"rank div {FANOUT}").alias("rank"), "h_").distinct()
    # From the root to the subroots, whose ranks are the sources' numbers.
    upper = _height(n_sources)
    asked = checkpoint(wanted.select(F.col("number").alias("rank")).distinct())
    at = spark.range(1).select(F.lit(0).cast("long").alias("number"), F.lit(0).alias("height"), F.lit(0).cast("long").alias("rank"), F.lit(root).alias("digest"), F.array().cast(none).alias("segments"))
    for level in range(upper - 1, -1, -1):
        at = checkpoint(_down(at, manifest.records).join(asked.select(F.expr(f"rank div {FANOUT**level}").alias("rank")).distinct(), "rank", "left_semi"))
    at = at.select(F.col("rank").alias("number"), "digest", "segments").join(manifest.sources.select("number", "height"), "number")
    at = checkpoint(at.select("number", "height", F.lit(0).cast("long").alias("rank"), "digest", "segments"))
    # And on, each from its own height; the last step is taken with the requests at hand, since it makes a row for each.
    lone = at.where("height = 0")
    going = at.where(F.col("height") == most)
    for level in range(most, 1, -1):
        below = _down(going, manifest.records).join(passed[level - 1].select("number", "rank"), ["number", "rank"], "left_semi")
        going = checkpoint(below.unionByName(at.where(F.col("height") == level - 1)))
    ends = lone.select("number", F.lit(0).cast("long").alias("run"), F.array("digest").alias("children"), "segments", F.lit(False).alias("inner"))
    if most:
        ends = ends.unionByName(going.join(manifest.records, "digest").select("number", F.col("rank").alias("run"), "children", "segments", F.lit(True).alias("inner")))
    own = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row_")
    digit = F.col("rank") % FANOUT
    each = wanted.select("number", F.expr(f"rank div {FANOUT}").alias("run"), digit.alias("digit"), own)
    found = each.join(ends, ["number", "run"]).where(F.col("digit") < F.size("children"))
    last = F.when(F.col("inner"), F.array(_segment(F.col("children"), F.col("digit")))).otherwise(F.array().cast(none))
    found = found.select("number", F.concat(last, F.reverse("segments")).alias("segments"), "row_")
    tops = manifest.sources.select(F.col("number").alias("n_"), "subroot", "root")
    return found.join(small_side(tops), F.col("number") == F.col("n_")).select("row_.*", "subroot", "root", "segments")


def folded(start: Column, segments: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(segments, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(segments: Column) -> Column:
    """All siblings, level by level and left to right, as one text of digests."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


def verified(docs: DataFrame) -> DataFrame:
    """Proves every row of ``docs``, after lower-casing A-Z in the texts of those whose crc32 of the id is divisible by 5.

    Null fields have a digest of their own (``-``), so that null and empty texts
    differ. Rows that repeat an id stand by their digests in the tree; a null id
    comes first and isn't tampered with. Other columns are not read.
    """
    cols = {c: F.col(c) for c in FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").alias("order"), leaf(*cols.values()).alias("leaf"),
        F.when(hit, leaf(*(cols | {"text": lowered}).values())).alias("tampered"),
    )
    manifest = build(rows)
    found = proofs(manifest, manifest.leaves.select("number", "rank", F.col("order").alias("doc_id"), "leaf", "tampered"))
    root = folded(F.coalesce("tampered", "leaf"), F.col("segments"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("segments")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
