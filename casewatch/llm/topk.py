"""Exact top-k search by block-at-a-time pruning.

Vectors are lists of integer term weights, one a dimension. Ranges of rows in
order of id form blocks; of each block a forward index (its rows' weights) and
each term's largest and smallest weight are kept. For a query, a block's bound
is the sum over terms of what the term can add at most; blocks are scored in
falling order of bound, each at once through its forward index, until the next
bound is below the k-th best score found so far. Bounds are never too low, so
the result is exact. Queries and ranges of rows meet in a grid of cells of
bounded size. Each query is searched in one cell first; the k-th best score
found there goes with it into all others, where most blocks then need no
scoring. The best k of a query's cells are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of a block; rows and queries of a cell.
BLOCK, ROWS, QUERIES = 256, 32_768, 8_192


def search_blocks(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(number of the query, id, score) of each query's best k rows other than its ``own``, ties to the smaller id.

    ``rows`` tell rows apart. Scores below a query's ``floor`` aren't asked for.
    """
    order = np.argsort(ids, kind="stable")
    vectors, ids, rows = vectors[order], ids[order], rows[order]
    starts = np.arange(0, len(ids), block)
    high = np.maximum.reduceat(vectors, starts, axis=0)
    low = np.minimum.reduceat(vectors, starts, axis=0)
    out = []
    for n, (q, mine) in enumerate(zip(queries, own)):
        bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
        least = -np.inf if floor is None else floor[n]
        best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < least:
                break
            a = starts[b]
            scores = vectors[a : a + block] @ q
            keep = (rows[a : a + block] != mine) & (scores >= least)
            if keep.any():
                best_scores, best_ids = np.concatenate([best_scores, scores[keep]]), np.concatenate([best_ids, ids[a : a + block][keep]])
                top = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[top], best_ids[top]
                if len(best_ids) == k:
                    least = max(least, best_scores[-1])
        out += [(n, int(i), int(s)) for i, s in zip(best_ids, best_scores)]
    return out


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<double>): floor(scale * x) of each component x as double; written out, row telling rows apart.

    Rows without an id, and vectors that are null, empty or hold null, infinite
    or not-a-number components are left out; rows that repeat an id stay, each a
    row by itself. Other columns are ignored.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    found = rows.where(fine).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v"))
    return checkpoint(found.withColumn("row", F.monotonically_increasing_id()))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other rows.

    ``vectors`` and ``queries`` have (row, vec_id, v), queries being rows of
    ``vectors``; v holds whole numbers as doubles, whose products are exact up to
    2**53. Vectors of another length than the query's take no part in its
    search. Rows that repeat a query's id are candidates, and queries of their
    own. Fewer rows than k give fewer results, no rows none.
    """
    n_rows, n_queries = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    # Cuts between ranges of ids; of an id that fills more than a range rows are dealt by their number.
    cuts = vectors.agg(F.percentile_approx("vec_id", [i / n_rows for i in range(1, n_rows)], 10_000)).first()[0] if n_rows > 1 else []
    cut = F.array(*[F.lit(c).cast("long") for c in cuts or []])
    below, upto = F.size(F.filter(cut, lambda c: c < F.col("vec_id"))), F.size(F.filter(cut, lambda c: c <= F.col("vec_id")))
    part = (below + F.pmod(F.xxhash64("row"), upto - below + 1)).cast("long") if cuts else F.lit(0).cast("long")
    rows = vectors.select(F.size("v").alias("dim"), part.alias("part"), "row", "vec_id", "v")
    asks = queries.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(n_queries)).cast("int").alias("cell"), "row", "vec_id", "v")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf.asks], pdf[~pdf.asks]
        found = search_blocks(np.stack(q.v), q.row.to_numpy(), np.stack(r.v), r.vec_id.to_numpy(), r.row.to_numpy(), k, floor=q.floor.to_numpy()) if len(q) and len(r) else []
        out = pd.DataFrame(found, columns=["n", "vec_id", "score"]).astype("int64")
        return pd.DataFrame({"row": q.row.to_numpy()[out.n], "query_id": q.vec_id.to_numpy()[out.n], "vec_id": out.vec_id, "score": out.score})

    def searched(asks: DataFrame, cells: int) -> DataFrame:
        names = ["dim", "part", "cell", "asks", "row", "vec_id", "v", "floor"]
        own = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("asks", F.lit(False)).withColumn("floor", F.lit(0.0))
        both = own.select(*names).union(asks.withColumn("asks", F.lit(True)).select(*names))
        return both.groupBy("dim", "part", "cell").applyInPandas(cell, "row long, query_id long, vec_id long, score long")

    low = float("-inf")
    found = searched(asks.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_rows))).withColumn("floor", F.lit(low)).withColumn("cell", F.lit(0)), 1)
    if n_rows > 1:
        found = checkpoint(found)
        floors = found.groupBy("row").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
        left = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long")))).where(F.col("part") != F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_rows)))
        found = found.union(searched(left.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(low))), n_queries))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
