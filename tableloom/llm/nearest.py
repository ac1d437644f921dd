"""Nearest vectors by a block matrix join.

Queries and candidates are cut into blocks of bounded size; every query block meets every candidate block in one tile.
In a tile both sides are quantised to int8, one matrix product gives all inner products up to a known error, and only
pairs whose upper bound reaches the query's k-th best lower bound are computed again in double precision. Heaps of k
rows per query merge the parts of a tile; a limited window merges the tiles. The result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.keyed import top_k
from tableloom.llm.common import named
from tableloom.session import materialise

LEVELS = 127
#: Relative room for rounding in the bounds themselves.
SLACK = 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, length of the restored vector and length of what is lost, per row."""
    scale = np.abs(x).max(axis=1) / LEVELS
    scale[scale == 0] = 1.0  # subnormal rows: all is lost, the error bound says so
    codes = np.rint(x / scale[:, None]).clip(-LEVELS, LEVELS).astype(np.int8)
    restored = codes * scale[:, None]
    return codes, scale, np.sqrt((restored**2).sum(axis=1)), np.sqrt(((x - restored) ** 2).sum(axis=1))


def first_copies(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Positions, by id, of rows among the ``keep`` smallest ids of their equal vectors; no other copy can be a result."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x[order] + 0.0)  # -0.0 becomes 0.0
    _, group = np.unique(rows.view([("", f"V{rows.shape[1] * rows.itemsize}")]).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_groups = group[by_group]
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    at = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[np.sort(by_group[at < keep])]


def search_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, part: tuple = (512, 4096)
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within one tile: query ids, ids, scores."""
    kept = first_copies(ids, vectors, k + 1)
    ids, vectors = ids[kept], vectors[kept]
    q_codes, q_scale, q_length, q_lost = quantise(queries)
    c_codes, c_scale, c_length, c_lost = quantise(vectors)
    exact_int = np.float32 if queries.shape[1] * LEVELS**2 < 2**24 else np.float64  # sums of products stay exact
    heaps: list[list] = [[] for _ in query_ids]
    for i in range(0, len(query_ids), part[0]):
        qs = slice(i, i + part[0])
        left = q_codes[qs].astype(exact_int)
        for j in range(0, len(ids), part[1]):
            cs = slice(j, j + part[1])
            near = (left @ c_codes[cs].astype(exact_int).T).astype(np.float64)
            near *= q_scale[qs, None] * c_scale[None, cs]
            error = q_lost[qs, None] * (c_length + c_lost)[None, cs] + q_length[qs, None] * c_lost[None, cs]
            error += SLACK * ((q_length + q_lost)[qs, None] * (c_length + c_lost)[None, cs]) + 1e-300
            own = query_ids[qs, None] == ids[None, cs]
            low = np.where(own, -np.inf, near - error)
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[qs]])
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            rows, cols = np.nonzero((near + error >= floor[:, None]) & ~own)
            for s in range(0, len(rows), 65536):
                r, c = rows[s : s + 65536] + i, cols[s : s + 65536] + j
                scores = np.zeros(len(r))
                for products in (queries[r] * vectors[c]).T:  # summed in the order of the components
                    scores += products
                for row, score, other in zip(r.tolist(), scores.tolist(), (-ids[c]).tolist()):
                    heap = heaps[row]
                    if len(heap) < k:
                        heapq.heappush(heap, (score, other))
                    elif (score, other) > heap[0]:
                        heapq.heapreplace(heap, (score, other))
    found = [(q, -other, score) for q, heap in zip(query_ids.tolist(), heaps) for score, other in heap]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b, c = zip(*found)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    query_rows: int = 4096,
    candidate_rows: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all rows but its own.

    ``is_query`` is a condition on the key column. Order: score down, then smaller id. Only vectors of the query's
    length are candidates. Rows whose id or vector is null, or whose vector is empty, zero or holds a null or non-finite
    component, take no part. Rows that share an id count once, with the smallest of their vectors. Queries with fewer
    candidates return all of them; an empty table gives no rows. Other columns are ignored.
    """
    x = named(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    chosen = vectors.filter(
        named(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)
    )
    rows = materialise(
        chosen.select(named(key).cast("bigint").alias("id"), x.cast("array<double>").alias("x"), is_query.alias("q"))
        .groupBy("id", "q")
        .agg(F.min("x").alias("x"))
        .withColumn("dim", F.size("x"))
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    # a grid of tiles: both sides are cut by a hash of the id, so copies and close ids spread over all blocks
    down, across = max(1, math.ceil(sizes["q"] / query_rows)), max(1, math.ceil(sizes["n"] / candidate_rows))
    block = F.xxhash64("id")
    queries = rows.filter("q").select(
        F.pmod(block, F.lit(down)).alias("h"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("g"),
        "dim", "id", "x",
    )
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("h"),
        F.pmod(block, F.lit(across)).alias("g"),
        "dim", "id", "x",
    )

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        found = search_tile(
            left["id"].to_numpy(), np.stack(left["x"].to_numpy()), right["id"].to_numpy(),
            np.stack(right["x"].to_numpy()), k,
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    tiles = (
        queries.groupBy("h", "g", "dim")
        .cogroup(candidates.groupBy("h", "g", "dim"))
        .applyInPandas(tile, "query_id bigint, vec_id bigint, score double")
    )
    best = top_k(tiles, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
