"""Nearest neighbours by cosine: int8 product tiles with error bounds, exact recomputation."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwork.llm.common import type_of

def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, the norms of the decoded rows and of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their vectors divided by a power of two near the largest component.

    That changes no cosine, and keeps squares within the range of doubles."""
    ids = table.column("vec_id").to_numpy()  # objects, where they aren't numbers
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    rows = flat.reshape(len(ids), -1).astype(np.float64)[order]
    return ids[order], np.ascontiguousarray(np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products by row, component after component."""
    return np.cumsum(a * b, axis=1)[:, -1]


def tile_search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, rows: int = 256, columns: int = 4096) -> list[tuple[int, int, float]]:
    """The ``k`` nearest of ``c`` for each of ``q`` (ties to smaller ids), never a row of the same id;
    ``c_ids`` ascend.

    Each tile's int8 products (exact in float32 while they stay below 2**24, else in float64) give
    a cosine that is off by ``|decoded query| * error of candidate + error of query`` at most.  A
    pair stays if its upper bound reaches the k-th best of the lower bounds and exact values seen;
    what stays is computed from the vectors in double precision and goes through a heap.
    """
    q_norm, c_norm = np.sqrt(_dot(q, q)), np.sqrt(_dot(c, c))
    q_code, q_scale, q_len, q_err = quantised(q / q_norm[:, None])
    c_code, c_scale, _, c_err = quantised(c / c_norm[:, None])
    wide = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    best: list[list] = [[] for _ in q_ids]
    for a in range(0, len(q_ids), rows):
        left = q_code[a : a + rows].astype(wide)
        for b in range(0, len(c_ids), columns):
            s = slice(b, b + columns)
            near = (left @ c_code[s].astype(wide).T).astype(np.float64) * (q_scale[a : a + rows, None] * c_scale[None, s])
            off = q_len[a : a + rows, None] * c_err[None, s] + q_err[a : a + rows, None] + 1e-9
            own = q_ids[a : a + rows, None] == c_ids[None, s]
            near[own] = -np.inf
            low = near - off
            if low.shape[1] > k:
                floor = -np.partition(-low, k - 1, axis=1)[:, k - 1]
            else:
                floor = np.full(len(low), -np.inf)
            for i in range(len(low)):
                heap = best[a + i]
                least = max(floor[i], heap[0][0] - 1e-12) if len(heap) == k else floor[i]
                found = np.flatnonzero((near[i] + off[i] >= least) & ~own[i])
                exact = _dot(q[a + i], c[b + found]) / (q_norm[a + i] * c_norm[b + found])
                if len(found) > k:
                    keep = np.lexsort((found, -exact))[:k]
                    found, exact = found[keep], exact[keep]
                for score, j in zip(exact.tolist(), (b + found).tolist()):
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -j))
                    elif (score, -j) > heap[0]:
                        heapq.heapreplace(heap, (score, -j))
    return [(i, c_ids[-j], score) for i, heap in zip(q_ids, best) for score, j in heap]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", candidate_block: int = 16384, query_block: int = 16384) -> DataFrame:
    """The ``k`` rows nearest to each query row by cosine: ``query_id, rank, vec_id, score``.

    A block matrix join: candidates fall into blocks of about ``candidate_block`` rows, queries of
    about ``query_block``, and each pair of blocks is one task's tile (see ``tile_search``).  A tile
    returns k rows for each of its queries, and a ranking window merges the tiles.  The result is
    exact, so that its recall is 1.

    Ids may be of any type that has an order.  Null ids and vectors that are null, empty, zero or
    hold a null or non-finite component take no part.  Ids name vectors: rows that repeat an id
    count once, by the least vector in array order.  Only vectors of
    equal length are compared.  With fewer than k candidates all are returned; an empty table gives
    no rows; other columns are ignored.  Equal vectors tie and go by id.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")).withColumn("dim", F.size("vector"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-asked // query_block))
    block = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    c = rows.select("vec_id", "vector", "dim", block(1, c_blocks).alias("cb")).withColumn("qb", every(q_blocks))
    q = rows.filter("asks").select("vec_id", "vector", "dim", block(2, q_blocks).alias("qb")).withColumn("cb", every(c_blocks))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = tile_search(*_matrix(left), *_matrix(right), k) if left.num_rows and right.num_rows else []
        ids, others, scores = zip(*found) if found else ((), (), ())
        kind = left.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(ids, kind), "vec_id": pa.array(others, kind), "score": pa.array(scores, pa.float64())})

    keys, kind = ["dim", "cb", "qb"], type_of(rows, "vec_id")
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(tile, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
