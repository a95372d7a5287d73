"""Best-fit packing of documents into training sequences of several permitted lengths.

A document longer than the longest sequence is cut: its full pieces are
sequences by themselves, the rest is packed. Pieces are dealt into shards of
bounded size by a hash; within a shard they are packed best-fit in falling
order of length over bins of all sizes at once. Where no open bin has room, the
bin is opened whose cost per token is least, counted over what it may yet
hold; at the end every bin is downsized to the smallest permitted length that
holds its contents. This is repeated with each limit on the size opened, and
with bins opened at that limit whatever they cost, and the plan of least cost is
kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, n_words

SIZES = (256, 512, 1024, 2048)
#: Pieces of a shard, on average; and what a sequence costs besides its length.
SHARD, OVERHEAD = 8_192, 16


def cost(size: int) -> float:
    """Of a sequence: its tokens, its overhead, and attention that grows with the square."""
    return size + OVERHEAD + size * size / 16_384


def _plan(lengths: list[int], sizes: tuple[int, ...], limit: int, cheapest: bool) -> tuple[float, list[list[int]]]:
    """Best fit with bins opened at ``limit`` at most, if the piece allows: (cost, bins as lists of piece numbers); lengths fall.

    Opened at the size of least cost per token if ``cheapest``, else at the largest.
    """
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    left = sum(lengths)
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            fit = [s for s in sizes if s >= n]
            fit = [s for s in fit if s <= limit] or fit[:1]
            space = min(fit, key=lambda s: (cost(s) / min(s, left), s)) if cheapest else fit[-1]
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        left -= n
        if space > n:
            insort(room, (space - n, b))
    used = [sum(lengths[i] for i in b) for b in bins]
    return sum(cost(next(s for s in sizes if s >= u)) for u in used), bins


def pack_shard(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, list[int]]]:
    """(size, piece numbers) of each bin; every length is from 1 to the largest size."""
    if not lengths:
        return []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    plans = [_plan(falling, sizes, limit, cheapest) for limit in sizes for cheapest in (True, False)]
    _, bins = min(plans, key=lambda p: p[0])
    return [(next(s for s in sizes if s >= sum(falling[i] for i in b)), [order[i] for i in b]) for b in bins]


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, separator: int = 1) -> DataFrame:
    """(bin_id, capacity, used, position, doc_id, piece, start, length): one row for each piece of each document.

    A document has as many tokens as words, plus ``separator``; start and length
    count tokens. Null and empty texts have the separator alone. Ids that aren't
    numbers count as none. Repeated rows
    are packed each by itself. Every token is in one piece, no bin is over its
    capacity. Other columns are ignored; an empty table gives no rows.
    """
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), (n_words(F.col("text")) + separator).alias("n"), F.xxhash64("doc_id", "text").alias("h"))
    # Repeated rows are told apart by a number, by which they go to different shards.
    rows = checkpoint(rows.groupBy("doc_id", "n", "h").agg(F.count("*").alias("copies")))
    rows = rows.select("doc_id", "n", "h", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).withColumn("key", F.xxhash64("doc_id", "h", "copy"))
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    full = F.floor(F.col("n") / most).cast("int")
    whole = rows.where(full > 0).select("key", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select(
        F.concat_ws("-", F.lit("w"), F.lower(F.hex("key")), "piece").alias("bin_id"), F.lit(most).alias("capacity"), F.lit(most).alias("used"), F.lit(0).alias("position"),
        "doc_id", "piece", (F.col("piece") * most).alias("start"), F.lit(most).alias("length"),
    )
    rest = rows.where(F.col("n") % most > 0).select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "doc_id", full.alias("piece"), (full * most).alias("start"), (F.col("n") % most).cast("int").alias("length"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        plan = pack_shard(pdf.length.tolist(), sizes)
        counts = np.array([len(p) for _, p in plan])
        out = pdf.iloc[np.concatenate([p for _, p in plan])]
        number = np.repeat(np.arange(len(plan)), counts)
        used = np.bincount(number, out.length)
        return pd.DataFrame({
            "bin_id": [f"s{pdf.shard[0]}-{b}" for b in number], "capacity": np.repeat([s for s, _ in plan], counts), "used": used[number].astype("int32"),
            "position": np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts), "doc_id": out.doc_id.array, "piece": out.piece.array, "start": out.start.array, "length": out.length.array,
        })

    packed = rest.groupBy("shard").applyInPandas(run, "bin_id string, capacity int, used int, position int, doc_id long, piece int, start int, length int")
    return whole.union(packed)
