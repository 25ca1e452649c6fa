"""Operator 10: nearest neighbours by a block matrix join.

Queries and candidates are dealt into bounded blocks, and each pair of blocks
is a tile that one task takes (no pair of rows is ever a row). In a tile

1. vectors are scaled to int8 each, with their largest quantisation errors;
2. the product of the int8 blocks, summed in whole numbers, approximates every
   score, and |error| <= e_q * |x|_1 + e_x * (|q|_1 + d * e_q) bounds what it is off by,
   where e are half steps of the two scales;
3. a pair survives if its upper bound reaches the k-th best lower bound of its
   query so far;
4. survivors are computed in double precision from the original vectors, and a
   heap a query keeps the k best, ties to the smaller id.

Heaps of the tiles are merged for each query by its rank over the tiles. The
result is exact: a pair is left out only if k others are proven to be nearer.

Defined cases: vectors that are null, empty, zero, of another length than most, or
that hold null or non-finite components take no part; repeated ids are
candidates each, but a query is never matched with its own id; with fewer
candidates than k all are given; an empty table gives an empty one; other
columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship

#: Rows in a query block and in a candidate block at most, on average; rows multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 2048, 8192, 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, their scales, their largest errors)."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.abs(x - q * scale[:, None]).max(1) * (1 + 1e-9)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (score, id) among the rows, best first."""
    q8, q_scale, q_error = quantised(queries)
    q_norm = np.abs(queries).sum(1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # of (score, -id): the worst is first
    floor = np.full(len(query_ids), -np.inf)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products are whole numbers in it
    q32 = q8.astype(exact)
    for begin in range(0, len(rows), STEP):
        x, x_ids = rows[begin : begin + STEP], ids[begin : begin + STEP]
        x8, x_scale, x_error = quantised(x)
        near = (q32 @ x8.astype(exact).T) * q_scale[:, None] * x_scale[None, :]
        off = (q_error[:, None] * np.abs(x).sum(1)[None, :] + x_error[None, :] * (q_norm + queries.shape[1] * q_error)[:, None]) * (1 + 1e-6) + 1e-12
        near[query_ids[:, None] == x_ids[None, :]] = -np.inf
        low = near - off
        if low.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        a, b = np.nonzero((near + off >= floor[:, None]) & (near > -np.inf))
        scores = np.einsum("ij,ij->i", queries[a], x[b])
        for i, s, j in zip(a.tolist(), scores.tolist(), x_ids[b].tolist(), strict=True):
            h = heaps[i]
            if len(h) < k:
                heapq.heappush(h, (s, -j))
            elif (s, -j) > h[0]:
                heapq.heapreplace(h, (s, -j))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return [[(s, -j) for s, j in sorted(h, reverse=True)] for h in heaps]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` the k rows of ``vectors`` of largest inner product."""
    ship(vectors.sparkSession)
    double = F.col(vector_col).cast("array<double>")
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), double.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    c, q = clean(vectors), clean(queries)
    sizes = c.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
    c, q = c.where(F.size("v") == d), q.where(F.size("v") == d)
    columns, rows = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-q.count() // QUERY_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("id", F.lit(17)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = q.select(block(rows).alias("r"), each(columns).alias("c"), "id", "v", F.lit(True).alias("is_query"))
    right = c.select(each(rows).alias("r"), block(columns).alias("c"), "id", "v", F.lit(False).alias("is_query"))

    def run(t: pa.Table) -> pa.Table:
        ids, flags = t.column("id").to_numpy(), t.column("is_query").to_numpy()
        v = pa.concat_arrays(t.column("v").chunks).flatten().to_numpy().reshape(len(ids), -1)
        order = np.flatnonzero(~flags)
        order = order[np.argsort(ids[order], kind="stable")]
        asked = np.flatnonzero(flags)
        found = tile(ids[asked], v[asked], ids[order], v[order], k)
        return pa.table({"query_id": pa.array(np.repeat(ids[asked], [len(f) for f in found])), "id": pa.array([j for f in found for _, j in f], pa.int64()), "score": pa.array([s for f in found for s, _ in f], pa.float64())})

    best = left.unionAll(right).groupBy("r", "c").applyInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
