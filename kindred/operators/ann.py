"""Approximate nearest neighbours by an inverted file: vectors are kept by the cell of their nearest centroid, and a query
looks into the cells nearest to it.

Centroids come from a bounded sample (`sample` rows, chosen by hash of the id); every vector is indexed. A cell is cut into
blocks of bounded size, so one that holds a third of all vectors is still many tasks' work; within the cells probed,
scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.similarity import BLOCK, refine

SAMPLE, MOST_CELLS, PROBES = 65_536, 4096, 16


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(vectors: DataFrame, n: int, *, sample: int = SAMPLE, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Spherical k-means over a sample of vectors (post_id, vec) of n rows; about as many cells as the root of n."""
    share = min(1.0, sample / max(n, 1))
    rows = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("post_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    got = rows.select("vec").toPandas().vec  # about `sample` rows
    x = unit(np.stack(got.to_numpy()).astype(np.float64)) if len(got) else np.zeros((0, 1))
    k = max(1, min(MOST_CELLS, int(n**0.5), len(x)))
    if not len(x):
        return x
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where((np.bincount(near, minlength=k) > 0)[:, None], unit(sums), c)
    return c


def celled(vectors: DataFrame, cells: np.ndarray, probes: int = 1) -> DataFrame:
    """cell, post_id, vec: each vector with its nearest cells, the nearest alone by default."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells.astype(np.float32))  # MOST_CELLS rows at most
    take = max(1, min(probes, len(cells)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 4096):
                some = part.iloc[at : at + 4096]
                x = unit(np.stack(some.vec.to_numpy()).astype(np.float32))
                near = np.argpartition(-(x @ shared.value.T), take - 1, axis=1)[:, :take]
                yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "post_id": np.repeat(some.post_id.to_numpy(), take), "vec": [v for v in some.vec for _ in range(take)]})

    return vectors.select("post_id", "vec").mapInPandas(run, "cell int, post_id bigint, vec array<float>")


def nearest_cells(cells: np.ndarray, query: np.ndarray, probes: int) -> list[int]:
    return np.argsort(-(cells @ unit(query[None].astype(np.float64))[0]), kind="stable")[:probes].tolist()


def similar_approx(queries: DataFrame, index: DataFrame, cells: np.ndarray, k: int, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, post_id, score of each query (post_id, vec) among the vectors of its nearest cells. A query travels to
    the blocks of `probes` cells, a vector to one block: nothing is copied once for each block of the other side."""
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = index.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("post_id"), F.col("blocks")).cast("int").alias("part"), "post_id", "vec")  # a row a cell
    asked = celled(queries, cells, probes).join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("post_id").alias("query_id"), F.col("vec").alias("q"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "post_id": [], "cos": []}).astype({"query_id": "int64", "post_id": "int64"})
        stack = lambda v: np.stack(v.to_numpy()).astype(np.float64)
        x, ids = stack(b.vec), b.post_id.to_numpy()
        return pd.concat([refine(a.query_id.to_numpy()[at : at + block], stack(a.q[at : at + block]), ids, x, k) for at in range(0, len(a), block)])

    found = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(meet, "query_id bigint, post_id bigint, cos double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "post_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "post_id", F.round("cos", 4).alias("score"))
