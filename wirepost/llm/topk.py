"""Exact top-k search: tiled matrix products of query blocks and candidate shards, partial selection per tile, tree merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products stay exact in float64 below this bound, so a tile can use BLAS; larger ones use 64-bit or Python integers.
EXACT = 2**53


def quantized(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id long, q array<double>): floor(factor * x) of each component; rows with a null id, a null vector, or a null or non-finite component are left out.

    factor is a power of two, so every q is a whole number without rounding, of whatever size. A component whose multiple
    goes beyond what a double holds (over 2**1016) fails.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    times = lambda v: v * float(factor)
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) == float("inf"), F.raise_error(F.lit("a component is too large")).cast("double")).otherwise(y)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select("vec_id", F.transform("x", lambda v: whole(times(v))).alias("q"))
    )


def products(q: np.ndarray, c: np.ndarray, banned: np.ndarray | None = None) -> np.ndarray:
    """Integer inner products of rows of whole doubles; exact in whatever arithmetic the magnitudes allow. A product that isn't a long fails, unless its cell is banned."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, c)]
    scores = exact[0] @ exact[1].T
    if banned is not None:
        scores[banned] = 0
    return np.array(scores.tolist(), np.int64).reshape(scores.shape)  # raises if a score isn't a long


def select_tile(scores: np.ndarray, ids: np.ndarray, banned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores, ties to the smaller id; `banned` cells never count."""
    kept_rows, kept_cols = [], []
    for i in range(len(scores)):
        row, free = scores[i], np.flatnonzero(~banned[i])
        if len(free) > k:
            cut = np.partition(row[free], len(free) - k)[len(free) - k]  # the k-th best score: all above it and the smallest ids at it stay
            above, at = free[row[free] > cut], free[row[free] == cut]
            need = k - len(above)
            free = np.concatenate([above, at[np.argsort(ids[at], kind="stable")[:need]]])
        kept_rows.append(np.full(len(free), i))
        kept_cols.append(free)
    return np.concatenate(kept_rows), np.concatenate(kept_cols)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 16_384, shard_rows: int = 8192, fan_in: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest integer inner product with each query.

    vectors and queries are (vec_id, q) as quantized() makes them. A row is its query's own, and no candidate for it, if the
    ids are equal. Ties go to the smaller vec_id. Vectors of another length than the query's take no part for it. Rows that
    repeat an id and vector count once; one id with several vectors stands for all of them, each a row. Fewer than k
    candidates: all. Empty tables give no rows. A score that isn't a long fails.

    Queries go in blocks and candidates in shards of about so many rows (dealt by a hash of the id, never by content, so
    equal vectors spread out). Each (block, shard) tile is one matrix product in one task, of bounded size, and returns k rows
    a query. The lists of a query are then merged fan_in shards at a time, so no task gathers more than fan_in * k rows of one.
    """
    vectors = vectors.select("vec_id", "q").distinct()
    queries = queries.select("vec_id", "q").distinct()
    n_blocks = max(1, -(-queries.count() // block_rows))
    n_shards = max(1, -(-vectors.count() // shard_rows))
    if max(n_blocks, n_shards) > 2**31:
        raise ValueError("too many tiles")
    left = queries.select(F.expr(f"pmod(xxhash64(vec_id), {n_blocks})").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("s"), "vec_id", "q")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.expr(f"pmod(xxhash64(vec_id, 1), {n_shards})").cast("int").alias("s"), F.col("vec_id").alias("cand"), F.col("q").alias("cq"))

    def tile(key: tuple, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        a_len, c_len = (t[n].map(len) if n in t else pd.Series([], dtype=int) for t, n in ((a, "q"), (c, "cq")))
        for n in np.intersect1d(a_len.unique(), c_len.unique()):
            x, y = a[a_len == n], c[c_len == n]
            xs, ys = (np.array(t.tolist(), np.float64).reshape(len(t), n) for t in (x["q"], y["cq"]))
            xi, yi = x["vec_id"].to_numpy(), y["cand"].to_numpy()
            for at in range(0, len(xs), 256):
                own = xi[at : at + 256, None] == yi[None, :]
                scores = products(xs[at : at + 256], ys, own)
                rows, cols = select_tile(scores, yi, own, k)
                parts.append(pd.DataFrame({"query_id": xi[at + rows], "vec_id": yi[cols], "score": scores[rows, cols]}))
        out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return out.assign(s=int(key[1]))[["query_id", "s", "vec_id", "score"]]

    lists = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(tile, "query_id long, s int, vec_id long, score long")
    best = Window.partitionBy("query_id", "s").orderBy(F.desc("score"), "vec_id")
    while True:
        n_shards = -(-n_shards // fan_in)
        lists = lists.withColumn("s", F.expr(f"pmod(s, {n_shards})").cast("int")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if n_shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


__all__ = ["products", "quantized", "select_tile", "top_k"]
