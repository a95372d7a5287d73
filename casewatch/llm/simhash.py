"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are cut into segments, each the key of a table. Round each segment
a small Hamming ball is enumerated, every table match fetched and verified by
the distance over all bits. Balls are of two kinds:

- ``full_balls``: all values within ``distance // segments`` bits. By the
  pigeonhole principle no pair within ``distance`` is missed.
- ``sure_balls``, for pairs of a given similarity, whose distance is large: the
  values got by flipping the bits that a text is least sure of, those with the
  most even votes, which are the ones that near copies differ in. Width and
  number of segments follow the number of texts, so that a segment is shared by
  few texts by chance and a pair at the limit is missed once in ``MISSED`` times.

Only distinct fingerprints are compared: copies share one, and stand in the
result through it. Large groups of near copies never meet in pairs: members of
a crowded table entry are linked to leaders of it first, over and over while
that joins them; then only rows of different groups are compared, an entry's
large groups against its other rows. That pass is exact whatever came before;
where a cluster is dense, pairs that can't be links are told by counts alone.
Where a similarity is given, fingerprints only find candidates: a link is kept
only if the Jaccard index of the texts' sets of shingles, counted exactly, is
that high.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, small_side, text_key, wrapped

WORD = 64
GOLDEN = 0x9E3779B97F4A7C15
#: Rows of a table entry, and members of a group, from which they count as many.
CROWD = 64
#: Leaders of such an entry, and how many of the leaders that a row meets are tried.
LEADERS, NEAREST = 8, 3
#: Bits flipped in a segment, by their rank from the least sure on.
FLIPS = ((0,), (1,), (2,), (0, 1))
#: Share of pairs right at the limit that may share no entry.
MISSED = 0.005
#: Words of 64 bits in the bitmap of a set of shingles, and what ``_bounds`` gives.
BITMAP = 4
BOUND = "struct<n:long,shared:long," + ",".join(f"{name}{k}:long" for name in ("all", "mine") for k in range(BITMAP)) + ">"
#: Rows of fingerprints to a task, at least.
ROWS = 2_000
#: Where the number of a segment is put into the key of an entry.
KEY_BITS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, or of all words where there are no more; none for a text without words."""
    said = text.lower().split()
    if not said:
        return np.empty(0, dtype="<u8")
    if len(said) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(said), 42)]
    else:
        joined = b" ".join(said)
        ends = np.cumsum([len(w) + 1 for w in said])
        starts = [0, *ends[: len(said) - shingle].tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return np.array(hashes, dtype="<u8")


def votes(h: np.ndarray, words: int) -> np.ndarray:
    """For each bit, by how many hashes it is set in more than it isn't; later words are mixed from the first."""
    out = []
    for k in range(words):
        x = _mix(h + np.uint64(GOLDEN * k % 2**64)) if k else h
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(2 * bits.sum(axis=0, dtype=np.int64) - len(h))
    return np.concatenate(out)


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of the shingles' XXH64, repeats included, as a signed integer; 0 for a text without words.

    >>> fingerprint(b"", 3)
    0
    """
    return int(np.packbits(votes(shingles(text, shingle), 1) > 0, bitorder="little").view("<i8")[0])


def _columns(words: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, words)]]


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), text_key(F.col("text")).alias("told"), "text")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, told, fp long) of whole texts, told standing for the text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["doc_id", "told", "fp"])

    return _given(docs).mapInArrow(run, "doc_id long, told struct<h1:long,h2:long>, fp long")


@lru_cache
def sizes(texts: int, similarity: float) -> tuple[int, int, int, int]:
    """(segments, width, distance over all their bits, distance over one word) for so many texts and pairs that similar.

    Bits of two sets of Jaccard index j vote like normal variables with
    correlation 2j / (1 + j); the chance that a pair meets in an entry is drawn
    from such variables. Distances hold for all but one pair in a thousand.
    """
    width = min(KEY_BITS - 4, max(12, math.ceil(math.log2(max(texts, 2))) - 2))
    alike = 2 * similarity / (1 + similarity)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20_000, width))
    b = alike * a + math.sqrt(1 - alike * alike) * rng.standard_normal(a.shape)
    differ, met = (a > 0) != (b > 0), np.zeros(len(a), bool)
    for side in (a, b):
        d = np.take_along_axis(differ, np.argsort(np.abs(side), axis=1), 1)
        for flips in ((), *FLIPS):
            met |= (d == np.isin(np.arange(width), flips)).all(1)
    segments = math.ceil(math.log(MISSED) / math.log(1 - met.mean()))
    flip = math.acos(alike) / math.pi
    most = lambda n: math.ceil(n * flip + 3.1 * math.sqrt(n * flip * (1 - flip)))
    return segments, width, most(-(-segments * width // WORD) * WORD), most(WORD)


def keyed(text: bytes, shingle: int, segments: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the fingerprint of distinct shingles, keys of its entries, keys of the balls round them)."""
    v = votes(np.unique(shingles(text, shingle)), -(-segments * width // WORD))
    bits = v > 0
    cut = lambda x: x[: segments * width].reshape(segments, width)
    own = cut(bits) @ (1 << np.arange(width)) + (np.arange(segments) << KEY_BITS)
    unsure = 1 << np.argsort(np.abs(cut(v)), axis=1, kind="stable")[:, : max(map(max, FLIPS)) + 1]
    balls = [own ^ np.bitwise_or.reduce(unsure[:, list(f)], axis=1) for f in FLIPS]
    return np.packbits(bits, bitorder="little").view("<i8"), own, np.concatenate(balls)


def keyed_fingerprints(docs: DataFrame, shingle: int, segments: int, width: int) -> DataFrame:
    """(doc_id, told, fp long, fp1 long, ..., own array<long>, ball array<long>) of whole texts."""
    names = _columns(-(-segments * width // WORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [keyed(t.as_py() or b"", shingle, segments, width) for t in b.column(2).cast(pa.binary())]
            words = np.stack([f[0] for f in found]) if found else np.empty((0, len(names)), np.int64)
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(w) for w in words.T], *lists], ["doc_id", "told", *names, "own", "ball"])

    return _given(docs).mapInArrow(run, "doc_id long, told struct<h1:long,h2:long>, " + ", ".join(f"{c} long" for c in names) + ", own array<long>, ball array<long>")


def full_balls(classes: DataFrame, distance: int, segments: int) -> DataFrame:
    """``classes`` with own and ball: keys of its entries, and of all others within ``distance // segments`` bits of each."""
    at = [round(i * WORD / segments) for i in range(segments + 1)]
    segment = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << KEY_BITS) for i, (a, b) in enumerate(zip(at, at[1:]))]
    flips = [{"s": i, "x": sum(1 << k for k in c)} for i, (a, b) in enumerate(zip(at, at[1:])) for r in range(1, distance // segments + 1) for c in combinations(range(b - a), r)]
    balls = F.from_json(F.lit(json.dumps(flips)), "array<struct<s:int,x:long>>")
    return classes.withColumn("own", F.array(*segment)).withColumn("ball", F.transform(balls, lambda t: F.get("own", t["s"]).bitwiseXOR(t["x"])))


def _entries(classes: DataFrame, keys: str | Column, side: str, extra: tuple[str, ...] = (), width: int = 0) -> DataFrame:
    """(key, node, fp, extra) of each entry of each fingerprint; all but the key get the prefix ``side``.

    fp is one word. Of several it is the one after the entry's segment, whose
    ``width`` bits are alike anyway in all that meet there: were they among those
    compared, far more rows that share an entry by chance would seem near, and
    the more of them the wider segments are.
    """
    names = [c for c in classes.columns if c.startswith("fp")]
    rows = classes.select(F.explode(keys).alias("key"), "node", *names, *extra)
    last = ((F.shiftright("key", KEY_BITS) + 1) * width - 1) / WORD
    fp = F.get(F.array(*names), ((F.floor(last) + 1) % len(names)).cast("int")) if width and len(names) > 1 else F.col("fp")
    return rows.select("key", F.col("node").alias(f"{side}node"), fp.alias(f"{side}fp"), *[F.col(c).alias(side + c) for c in extra])


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def leader_links(classes: DataFrame, distance: int, draw: int) -> DataFrame:
    """(a, b): b's NEAREST leaders a, over all bits, of those within ``distance`` over one word.

    Of each entry with more than CROWD rows LEADERS leaders are drawn by hashes:
    a row meets so many for each of its segments, however large the entry is.
    """
    names = [c for c in classes.columns if c.startswith("fp")]
    rows = classes.select(F.explode("own").alias("key"), F.struct("node", *names).alias("b"))
    crowded = small_side(rows.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    rows = rows.join(crowded, "key")
    leaders = rows.groupBy("key").agg(*[F.min_by("b", F.xxhash64("b.node", F.lit(draw * LEADERS + i))).alias(f"l{i}") for i in range(LEADERS)])
    leaders = small_side(leaders.select("key", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("a")))
    found = rows.join(leaders, "key").where((_apart("a.fp", "b.fp") <= distance) & (F.col("a.node") != F.col("b.node")))
    whole = sum((_apart(f"a.{c}", f"b.{c}") for c in names), F.lit(0))
    # A set of LEADERS for each segment at most.
    nearest = found.groupBy(F.col("b.node").alias("b")).agg(F.slice(F.array_sort(F.collect_set(F.struct(whole.alias("d"), F.col("a.node").alias("a")))), 1, NEAREST).alias("x"))
    return nearest.select(F.explode("x.a").alias("a"), "b")


def _reach(a: str, b: str, similarity: float) -> Column:
    """Whether two sets may be similar, by their ``_bounds``; null where a bound isn't known.

    Each bit of one set's ``mine`` that the other's ``all`` has not is by a shingle that the other lacks, and so are the
    shingles that no other node has: the rest at most are common.
    """
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}.mine{k}").bitwiseAND(F.bitwise_not(f"{y}.all{k}"))) for k in range(BITMAP)), F.lit(0))
    common = F.least(F.col(f"{a}.shared") - lacks(a, b), F.col(f"{b}.shared") - lacks(b, a))
    return F.col(a).isNull() | F.col(b).isNull() | (common >= similarity * (F.col(f"{a}.n") + F.col(f"{b}.n") - common))


def crossing_links(classes: DataFrame, distance: int, similarity: float = 0.0, width: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different groups that meet in an entry and are within ``distance`` over one word.

    ``classes`` has (node, fp, own, ball, group, many), and bound for ``_reach``;
    if it has several words (fp1, ...), ``width`` is the bits of a segment.
    Rows of groups with many members meet all rows of other groups, but never
    those of their own.
    """
    few, many = classes.where("not many"), classes.where("many")
    every, extra = F.concat("own", "ball"), ("group", "bound")
    close = (F.col("a_group") != F.col("b_group")) & (_apart("a_fp", "b_fp") <= distance) & _reach("a_bound", "b_bound", similarity)
    once = F.col("b_many") | ~F.col("a_first") | (F.col("a_node") < F.col("b_node"))  # two rows of small groups share an entry once, not once each way
    first = _entries(few, "own", "a_", extra, width).withColumn("a_first", F.lit(True)).union(_entries(few, "ball", "a_", extra, width).withColumn("a_first", F.lit(False)))
    pair = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")]
    found = [
        first.join(_entries(classes, "own", "b_", (*extra, "many"), width), "key").where(close & once).select(*pair),
        _entries(few, "own", "a_", extra, width).join(_entries(many, "ball", "b_", extra, width), "key").where(close).select(*pair),
    ]
    # Entries that two large groups share: found from the groups alone, then their rows meet.
    rows = _entries(many, every, "a_", extra, width)
    own = _entries(many, "own", "b_", extra, width)
    shared = rows.select("key", "a_group").distinct().join(own.select("key", "b_group").distinct(), "key").where("a_group <> b_group")
    found.append(rows.join(shared, ["key", "a_group"]).join(own, ["key", "b_group"]).where(close).select(*pair))
    out = found[0].union(found[1]).union(found[2])
    return out.distinct()


def _bounds(classes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, bound) of the nodes with a crowded entry, for ``_reach``.

    bound has the size n of the set of shingles, how many of them (shared) some
    other such node has, a bitmap of all in BITMAP words, and the bits of it that
    none but shared ones set. A dense cluster of texts a little less similar than
    asked for would make all its pairs; what each text has that the other lacks
    rules most of them out beforehand, and none that is a link.
    """
    entries = classes.select("node", F.explode(F.concat("own", "ball")).alias("key"))
    crowded = entries.groupBy("key").count().where(F.col("count") > CROWD).select("key")
    nodes = entries.join(small_side(crowded), "key").select("node").distinct()
    said = checkpoint(sets(nodes)).select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    bits = lambda name: [F.expr(f"coalesce(bit_or(if(pmod(shingle, {BITMAP}) = {k}, shiftleft(1L, cast(pmod(shiftright(shingle, 8), 64) as int)), 0L)), 0L)").alias(f"{name}{k}") for k in range(BITMAP)]
    single = said.groupBy("shingle").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"), *bits("own"))
    whole = said.groupBy("node").agg(F.first("n").cast("long").alias("n"), *bits("all")).join(alone, "node", "left")
    mine = [F.col(f"all{k}").bitwiseAND(F.bitwise_not(F.coalesce(f"own{k}", F.lit(0)))).alias(f"mine{k}") for k in range(BITMAP)]
    shared = (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")
    return whole.select("node", F.struct("n", shared, *[f"all{k}" for k in range(BITMAP)], *mine).alias("bound"))


def _crowding(classes: DataFrame) -> int:
    """Pairs that entries with more than CROWD rows would make, however few they are beside the table: they grow with the square of a group."""
    each = classes.select(F.explode("own").alias("key")).groupBy("key").count()
    return each.where(F.col("count") > CROWD).agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0


def linked(classes: DataFrame, distance: int, keep: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0, width: int = 0, rows: int | None = None) -> DataFrame:
    """(a, b): links between nodes, enough of them that components are those of all links.

    ``distance`` is over one word, ``width`` as in ``crossing_links``, ``keep`` takes pairs and gives those that are
    links, ``sets`` takes nodes and gives their sets of shingles. ``rows``, if known,
    is how many ``classes`` has at most.
    """
    fewer = lambda df: df if rows is None else df.coalesce(1 + rows // ROWS)
    grouped, links, work = classes.withColumn("group", F.col("node")).withColumn("many", F.lit(False)), None, _crowding(classes)
    # Leaders go on while entries are crowded, and each round spares a good part of the pairs they would make.
    for draw in range(8):
        if not work:
            break
        found = checkpoint(keep(leader_links(grouped.where("not many"), distance, draw)))
        links = found if links is None else links.union(found)
        found = components(links)
        count = found.groupBy("component").count().where(F.col("count") > CROWD).select(F.col("component").alias("group"), F.lit(True).alias("many"))
        marked = classes.join(small_side(found), "node", "left").select("*", F.coalesce("component", "node").alias("group")).drop("component")
        grouped = checkpoint(fewer(marked.join(small_side(count), "group", "left").withColumn("many", F.coalesce("many", F.lit(False)))))
        left = _crowding(grouped.where("not many"))
        if left > 0.8 * work:
            break
        work = left
    bounds = None if sets is None else small_side(_bounds(grouped, sets))
    grouped = grouped.withColumn("bound", F.lit(None).cast(BOUND)) if bounds is None else grouped.join(bounds, "node", "left")
    rest = keep(crossing_links(grouped, distance, similarity, width))
    return rest if links is None else links.union(rest)


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, set array<long>) of the texts that ``nodes`` stand for, read again from ``docs``, one for each node."""
    asked = small_side(classes.join(nodes, "node", "left_semi").select("node", "told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(t.as_py() or b"", shingle)).view("<i8") for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    texts = docs.select(text_key(F.col("text")).alias("told"), "text").join(asked, "told").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, distance: int, shingle: int, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b) within ``distance`` over all bits whose sets of shingles have a Jaccard index of ``similarity`` or more.

    Only the texts of nodes in such a pair are read again, one for each node.
    """
    names = _columns(words)
    bits = lambda side: classes.select(F.col("node").alias(side), *[F.col(c).alias(side + c) for c in names])
    whole = sum((_apart("a" + c, "b" + c) for c in names), F.lit(0))
    pairs = checkpoint(pairs.join(bits("a"), "a").join(bits("b"), "b").where(whole <= distance).select("a", "b"))
    sets = checkpoint(shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, shingle))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with root, a node of its component, and component_id, the least of its component's ids."""
    found = components(links).withColumnRenamed("component", "root")
    least = small_side(found.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id")))
    named = classes.join(found.join(least, "root"), "node", "left")
    return checkpoint(named.withColumn("component_id", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id"))).withColumn("root", F.coalesce("root", "node")))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``: links are fingerprints at most ``distance`` bits apart.

    fingerprint is 16 lowercase hex digits, component_id the smallest doc_id that
    links reach, the row's own included. Texts without words (null, empty, white
    space) have fingerprint zero and are linked like any other. Repeated rows
    stay; rows without an id (ids are whole numbers, others count as none) get
    the id of their component all the same, or null where it has none. Other
    columns are ignored; an empty table gives an empty result. No link is missed.
    """
    fps = checkpoint(fingerprints(docs, shingle))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("node", F.col("fp")))
    links = linked(full_balls(classes, distance, segments), distance, lambda pairs: pairs)
    named = _labels(classes, links).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, told, root, component_id) for every row of ``docs``: links are texts of ``similarity`` in sets of shingles.

    root names the component, component_id is its least doc_id. Texts without
    words are one group; ids, repeated rows, other columns and empty tables are
    as in ``near_duplicates``, rows with one id and different texts are two.
    """
    n = docs.count()
    segments, width, whole, word = sizes(max(n, 2), similarity)
    names = _columns(-(-segments * width // WORD))
    fps = checkpoint(keyed_fingerprints(docs, shingle, segments, width))
    classes = fps.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.min(F.struct("told", "own", "ball")).alias("x"))
    classes = classes.select(*names, "rep", "x.told", "x.own", "x.ball").coalesce(1 + n // ROWS)
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    keep = lambda pairs: similar(pairs, classes, docs, len(names), whole, shingle, similarity)
    links = linked(classes, word, keep, lambda nodes: shingle_sets(nodes, classes, docs, shingle), similarity, width, n)
    named = _labels(classes, links).select(*names, "root", "component_id")
    return fps.select("doc_id", "told", *names).join(named, names).select("doc_id", "told", "root", "component_id")


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the least id, then by a hash of its text.

    Rows without an id come after all others of their group. A row of a group of
    its own always stays, also if another text has its id. Of rows with the same
    id and text one is kept, the least by all its columns.
    """
    groups = similar_groups(docs, shingle, similarity)
    each = groups.groupBy("root", "doc_id", "told").agg(F.count("*").alias("copies"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "told", "copies")).alias("x"))
    kept = checkpoint(first.select(F.col("x.doc_id").alias("id"), F.col("x.told").alias("told"), F.col("x.copies").alias("copies")))
    rows = docs.select(wrapped(docs).alias("row"), F.col("doc_id").try_cast("long").alias("own_id"), text_key(F.col("text")).alias("own_told"))
    same = lambda k: rows.join(k, F.col("own_id").eqNullSafe(k["id"]) & (F.col("own_told") == k["told"]))
    single = same(kept.where("copies = 1")).select("row.*")
    several = same(small_side(kept.where("copies > 1"))).groupBy("id", "told").agg(F.min("row").alias("row")).select("row.*")
    return single.union(several)
