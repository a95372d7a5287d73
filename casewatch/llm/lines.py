"""Removal of lines that stand in several documents, all but the first document's.

Two Bloom filters say which lines can be repeats at all: one of the hashes seen
once, one of those seen twice. Every task makes both for its own documents and
passes them on by buckets of 2**16 bits; merging two parts is ``twice |= once &
other.once`` beside the plain unions, so that a line in two documents, wherever
they are read, has all its bits in the second filter. Only lines found there
are shuffled, as a digest of 32 bytes and a place, for exact confirmation and
the choice of the first document. A false positive costs a row, never a line.

The filter follows the number of lines up to ``MOST_BITS``; that bounds what is
broadcast. Beyond, more lines are confirmed that needn't be, up to one narrow
row for each, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_key, wrapped, written

#: Bits a line; bits of a bucket; most bits of a filter (64 MB); hashes that a task gathers before it passes them on.
BITS, BUCKET, MOST_BITS, UNIT = 16, 1 << 16, 1 << 29, 1 << 20
#: Code points from which a line counts.
LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"


def keys(text: bytes) -> list[bytes]:
    """A key for each line: stripped, A-Z lower-cased."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def counts(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points; bytes that continue a character aren't counted."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash: its bucket, and two bits in it."""
    low = np.uint64(BUCKET - 1)
    return (hashes >> np.uint64(32)) & np.uint64(buckets - 1), hashes & low, (hashes >> np.uint64(16)) & low


def _bits(stored: bytes) -> np.ndarray:
    """A bucket's bits from what was passed on: all of them, or the numbers of those that are set."""
    if len(stored) == BUCKET // 8:
        return np.frombuffer(stored, np.uint8)
    bits = np.zeros(BUCKET, bool)
    bits[np.frombuffer(stored, "<u2")] = True
    return np.packbits(bits, bitorder="little")


def _stored(numbers: np.ndarray) -> bytes:
    if 2 * len(numbers) < BUCKET // 8:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(BUCKET, bool)
    bits[numbers.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


FILTERS = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _filters(hashes: list[int], buckets: int) -> pa.RecordBatch:
    """Both filters of some documents, each hash given once a document: a row for each bucket that has bits."""
    each, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
    bucket, p, q = places(each, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, p, q, n = bucket[order], p[order], q[order], n[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
        twice = n[a:b] > 1
        rows.append((int(bucket[a]), _stored(np.concatenate([p[a:b], q[a:b]])), _stored(np.concatenate([p[a:b][twice], q[a:b][twice]]))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), FILTERS.types)], schema=FILTERS)


def twice_seen(docs: DataFrame, buckets: int, least: int) -> DataFrame:
    """The filter of hashes seen twice, as (bucket, twice)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                held.extend({xxhash.xxh64_intdigest(k) for k in keys(text.as_buffer().to_pybytes()) if counts(k, least)})
                if len(held) >= UNIT:
                    yield _filters(held, buckets)
                    held = []
        if held:
            yield _filters(held, buckets)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row after the other: what is held is two filters of this task's buckets.
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for bucket, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = _bits(once), _bits(twice)
                if bucket in held:
                    a, b = held[bucket]
                    once, twice = a | once, b | twice | (a & once)
                held[bucket] = once, twice
        for bucket, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["bucket", "twice"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 1024))
    return text.mapInArrow(made, "bucket int, once binary, twice binary").repartition(parts, "bucket").mapInArrow(merged, "bucket int, twice binary")


def suspects(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """Lines that may be in another document too: (id, row, digest, line), lines numbered from 0."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    n = docs.agg(F.sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))).first()[0] or 0
    bits = min(max(BUCKET, 1 << (BITS * n).bit_length()), most_bits)
    buckets = bits // BUCKET
    whole = np.zeros((buckets, BUCKET // 8), np.uint8)
    for r in twice_seen(docs, buckets, least).toLocalIterator():
        whole[r.bucket] = np.frombuffer(r.twice, np.uint8)
    seen = spark.sparkContext.broadcast(whole.reshape(-1))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = seen.value
        for batch in batches:
            rows, numbers, digests = [], [], []
            for i, text in enumerate(batch.column("text")):
                own = [(j, k) for j, k in enumerate(keys(text.as_buffer().to_pybytes())) if counts(k, least)]
                bucket, p, q = places(np.fromiter((xxhash.xxh64_intdigest(k) for _, k in own), np.uint64, len(own)), buckets)
                start = bucket.astype(np.int64) * BUCKET
                p, q = start + p.astype(np.int64), start + q.astype(np.int64)
                both = (twice[p >> 3] >> (p & 7).astype(np.uint8)) & (twice[q >> 3] >> (q & 7).astype(np.uint8)) & 1
                for x in np.flatnonzero(both):
                    rows.append(i)
                    numbers.append(own[x][0])
                    digests.append(hashlib.sha256(own[x][1]).digest())
            if rows:
                ids = batch.select(["id", "row"]).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(digests, pa.binary()), pa.array(numbers, pa.int32())], ["id", "row", "digest", "line"])

    own = docs.select(F.col("doc_id").alias("id"), row_key(docs).alias("row"), text.alias("text"))
    return own.mapInArrow(found, f"id {docs.schema['doc_id'].dataType.simpleString()}, row struct<h1:long,h2:long>, digest binary, line int")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without lines whose key is in a document of smaller id; adds n_lines (before) and n_dropped, replacing columns of these names.

    A key has ``least`` code points or more. Documents are told apart by id: a
    key that only rows of one id have is no repeat, and all rows of the least
    id keep it, each time they have it. Null ids are one id, after all others. A
    null or empty text is one empty line, its text becomes empty, and repeated rows
    stay; an empty table gives an empty one.
    """
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    found = written(suspects(docs, least))[0].withColumn("place", place)
    repeats = found.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    repeats = checkpoint(repeats.select("digest", "first"))
    drops = found.join(repeats, "digest").where("place > first").groupBy("row").agg(F.collect_set("line").alias("drop_"))
    text = F.coalesce(F.col("docs_.text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    drop = F.coalesce("drop_", F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i)), "\n")
    joined = docs.select(wrapped(docs).alias("docs_"), row_key(docs).alias("row")).join(drops, "row", "left")
    names = {"text": F.when(F.size(drop) == 0, text).otherwise(kept), "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(drop).cast("long")}
    same = [F.col(f"docs_.`{c}`") for c in docs.columns if c not in names]
    return joined.select(*same, *[x.alias(c) for c, x in names.items()])
