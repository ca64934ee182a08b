"""Exact top-k cosine search and explanations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import cosine

BLOCK = 2048


def similar_to(vectors: DataFrame, post_id: int, limit: int) -> DataFrame:
    """rank, post_id, score of the nearest to one post, itself not counted; empty if it has no vector. The one query row
    is broadcast, the scan is narrow, and only each task's best rows are shuffled."""
    query = vectors.where(F.col("post_id") == post_id).limit(1).select(F.col("vec").alias("q"))
    scored = vectors.where(F.col("post_id") != post_id).join(F.broadcast(query)).select("post_id", cosine(F.col("vec"), F.col("q")).alias("cos"))
    best = scored.orderBy(F.desc("cos"), "post_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("cos"), "post_id"))  # of `limit` rows
    return best.select(rank.cast("bigint").alias("rank"), "post_id", F.round("cos", 4).alias("score"))


def refine(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query in a block. A matrix product proposes with a margin; the scores that count are left-to-right
    sums in double, as the column expression makes them."""
    left_sum = lambda a, b: np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))
    nq, nx = np.sqrt(left_sum(q, q)), np.sqrt(left_sum(x, x))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (q @ x.T) / (nq[:, None] * nx[None])
    s[~((nq[:, None] != 0) & (nx[None] != 0))] = 0
    s[query_ids[:, None] == ids[None]] = -np.inf
    take = min(k, len(ids))
    kth = np.partition(s, len(ids) - take, axis=1)[:, len(ids) - take]
    r, c = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = left_sum(q[r], x[c]) / (nq[r] * nx[c])
    cos[(nq[r] == 0) | (nx[c] == 0)] = 0
    order = np.lexsort((ids[c], -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < take
    return pd.DataFrame({"query_id": query_ids[r[keep]], "post_id": ids[c[keep]], "cos": cos[keep]})


def similar_all(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, post_id, score of every query (post_id, vec) against all vectors, in blocks of bounded size; each
    pair of blocks returns its k best of each query, which are merged by a window."""
    parts = [max(1, -(-df.count() // block)) for df in (queries, vectors)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.pmod(F.xxhash64("post_id"), F.lit(parts[0])).alias("qb"), every(parts[1]).alias("xb"), F.col("post_id").alias("query_id"), F.col("vec").alias("q"))
    right = vectors.select(every(parts[0]).alias("qb"), F.pmod(F.xxhash64("post_id"), F.lit(parts[1])).alias("xb"), "post_id", "vec")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "post_id": [], "cos": []}).astype({"query_id": "int64", "post_id": "int64"})
        stack = lambda v: np.stack(v.to_numpy()).astype(np.float64)
        return refine(a.query_id.to_numpy(), stack(a.q), b.post_id.to_numpy(), stack(b.vec), k)

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(meet, "query_id bigint, post_id bigint, cos double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "post_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "post_id", F.round("cos", 4).alias("score"))


def score_breakdown(cf: Column, cf_other: Column, tag: Column, tag_other: Column) -> tuple[Column, Column]:
    return F.round(cosine(cf, cf_other), 4), F.round(cosine(tag, tag_other), 4)

