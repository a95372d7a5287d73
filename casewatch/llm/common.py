"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every operator here: space and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Edges of a graph to a task.
EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and Spark is on one machine (tests) a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        return tempfile.mkdtemp(prefix="checkpoint-")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty() or sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most: int = 100_000, weight: Column | None = None) -> DataFrame:
    """``df`` written out and measured; marked for broadcast only if it has at most ``most`` rows.

    Beyond that it is joined by a shuffle, with the same result. Callers give
    narrow tables; where a row has an array, ``weight`` is its size, and it is the
    sum of weights that is bounded, so that the bound is always one on bytes.
    """
    df = checkpoint(df)
    total = df.limit(most + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def row_key(docs: DataFrame) -> Column:
    """128 bits that stand for id and text: what belongs to a row can be joined to it, repeated rows and null ids included."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own).alias("h2"))


def wrapped(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that those an operator adds clash with none, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def numbered(docs: DataFrame, *without: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by number, but for those in ``without``, and their names: Python functions over whole
    batches take columns by name, which fails for names with dots and names that appear twice."""
    at = [i for i, c in enumerate(docs.columns) if c not in without]
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in at]), [docs.columns[i] for i in at]


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of an array of int up to each element; by blocks, so that a long array costs little more than in proportion."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def whole(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), (F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int"))
        blocks = F.transform(cuts, lambda b: F.slice(F.aggregate(F.slice(v, b * block + 1, F.lit(block)), F.array(F.lit(0)), add), 2, block))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: add(acc, F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o)))

    # The array is bound to a variable, or else it would be made anew for each use.
    return F.element_at(F.transform(F.array(values), whole), 1)


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches nothing, as array<struct<start, end, value, before, after>>.

    Positions count code points; before and after are the text up to the next
    match on either side. The text is cut only where something matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def cut(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        n = F.size(found)
        steps = F.zip_with(F.slice(pieces, F.lit(1), n), found, lambda p, m: F.length(p) + F.length(m))
        ends = running_sums(steps)
        parts = F.arrays_zip(ends.alias("end"), found.alias("value"), F.slice(pieces, F.lit(1), n).alias("before"), F.slice(pieces, F.lit(2), n).alias("after"))
        return F.transform(parts, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(F.size(found) > 0, cut(found)).otherwise(none)


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % divisor


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null. Counted by its single spaces; only a text that still has two running is split."""
    text = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    text = F.trim(F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" ")))
    single = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(text == "", 0).when(F.contains(text, F.lit("  ")), F.size(F.array_remove(F.split(text, " "), ""))).otherwise(single)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path. Unlike a checkpoint it is read with its true size in view,
    which Spark otherwise multiplies from join to join; loops over joins need that."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long), by alternating large and small stars.

    Returns (node, component), component being the smallest node reached; nodes
    without an edge don't appear. Every step is written to the shared folder, so
    a lost executor costs one step at most. Minima are aggregated and written
    before they are joined back: Spark can split the rows of a node with many
    edges, which are never gathered.
    """
    spark, old = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        # A small graph isn't dealt over more tasks than it has work for.
        table, path = written(df.coalesce(1 + edges_left // EDGES))
        old.append(path)
        return table

    def state(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges_left = 1 << 40
    e = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = state(e)
    edges_left = seen[0]
    while seen[0]:
        # A round over a small graph is one task of one job: a few rows aren't worth a shuffle and a table for each step.
        few = edges_left <= EDGES
        step, other = ((lambda df: df), (lambda df: df.hint("merge"))) if few else (kept, lambda df: df)
        e = e.coalesce(1) if few else e
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*") if few else e.union(e.select("v", "u"))
        low = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = step(both.where("v > u").join(other(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = step(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(other(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = kept(small.where("u <> v").distinct())
        removed(spark, old[:-1])
        del old[:-1]
        now = state(e)
        if now == seen:
            break
        seen, edges_left = now, now[0]
    out = written(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", "v").distinct()).coalesce(1 + edges_left // EDGES))[0]
    removed(spark, old)
    return out
