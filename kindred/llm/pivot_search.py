"""Exact top-k search by inner product over integer vectors, with a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to it; a pivot's vectors are cut into annuli by
distance, and annuli into blocks of bounded size (salted by row, so that many equal vectors share the work).
Search: an annulus can hold a score of at most (|q|^2 + max |x|^2 - gap^2) / 2, gap being the least distance that the
triangle inequality leaves between the query and the annulus. Each query expands its annuli in the order of that bound,
first one, then STEP times as many in every round; its k-th score so far rises from round to round, and a query stops at
the first annulus whose bound is below it. Only blocks that some query of a chunk asks for travel to that chunk.
Pivots and annuli come from a bounded sample, which moves the work but not the result; every vector is indexed.

Defined results: vectors that are null, hold a null or non-finite component, are empty, have a null id, or a length
other than the commonest (at ties the longer) take no part. Every row is a candidate, also with a repeated id, but for
rows of the query's own id; an id with several query rows asks once, with the largest vector. Scores are exact while
|component| < 2^26. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import forget, hashed_share, stored

BLOCK, QUERIES, SAMPLE, STEP = 2048, 16384, 8192, 4
#: pivots and rings a pivot at most: what the driver holds, not what is searched; larger annuli have more blocks
MOST_PIVOTS, MOST_RINGS = 1024, 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec array<bigint>: floor(256 * x) of every usable vector."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return rows.where(F.size("embedding") == (sizes.n if sizes else 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))


def pivots_of(sample: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first seeds, then some rounds of means."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < many and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    p = sample[chosen].astype(np.float64)
    for _ in range(5):
        near = distances(sample, p).argmin(axis=1)
        for k in range(len(p)):
            if (near == k).any():
                p[k] = sample[near == k].mean(axis=0)
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * (x @ p.T), 0))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query in a block, not itself; x sorted by id, so that a stable sort breaks ties."""
    out = []
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53
    for at in range(0, len(q), 512):
        own, qs = q_ids[at : at + 512], q[at : at + 512]
        s = qs @ x.T if exact else (qs.astype(np.int64) @ x.astype(np.int64).T)
        s = s.astype(np.int64)
        low = np.iinfo(np.int64).min
        s[own[:, None] == ids[None]] = low
        take = min(k, len(ids))
        # the k-th score, then all at least as good, sorted by (score, id)
        kth = np.partition(s, len(ids) - take, axis=1)[:, len(ids) - take]
        r, c = np.nonzero((s >= kth[:, None]) & (s > low))
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        starts = np.searchsorted(r, np.arange(len(own)))
        keep = np.arange(len(r)) - starts[r] < take
        out.append(pd.DataFrame({"query_id": own[r[keep]], "vec_id": ids[c[keep]], "score": s[r[keep], c[keep]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def search(vectors: DataFrame, is_query: Column, k: int = 5, visits: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of every row that is_query holds for, against all rows. vectors: vec_id, embedding.
    visits takes, for each round, how many pairs of query and vector were compared."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    n = rows.count()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if n == 0:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE / n)
    sample = np.array([r.vec for r in rows.where(hashed_share(F.col("vec_id"), 13) < share).select("vec").limit(2 * SAMPLE).collect()] or [rows.first().vec], dtype=np.float64)
    pivots = pivots_of(sample, max(1, min(MOST_PIVOTS, int(n**0.5 / 2), len(sample) // 8)))
    d = distances(sample, pivots)
    near, own = d.argmin(axis=1), d.min(axis=1)
    edges = []
    for p in range(len(pivots)):
        rings = max(1, min(MOST_RINGS, round(n * (near == p).mean() / BLOCK)))
        edges.append(np.quantile(own[near == p], np.linspace(0, 1, rings + 1)[1:-1]) if (near == p).any() else np.zeros(0))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.stack(part.vec.to_numpy()).astype(np.float64)
            d = distances(x, pivots)
            p, dist = d.argmin(axis=1), d.min(axis=1)
            ring = np.array([int(np.searchsorted(edges[a], b, side="right")) for a, b in zip(p, dist)])
            yield pd.DataFrame({"vec_id": part.vec_id, "vec": [v.tobytes() for v in x.astype(np.int64)], "pivot": p, "ring": ring, "dist": dist, "norm": (x * x).sum(axis=1)})

    placed = rows.mapInPandas(place, "vec_id bigint, vec binary, pivot int, ring int, dist double, norm double")
    index = stored(placed.withColumn("row", F.monotonically_increasing_id()), "index")
    stats = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm")).toPandas()  # MOST_PIVOTS * MOST_RINGS rows at most
    stats["salts"] = -(-stats.n // BLOCK)
    low, high, norm = stats.low.to_numpy(), stats.high.to_numpy(), stats.norm.to_numpy()
    ring_pivot, ring_salts, held = (stats[c].to_numpy() for c in ("pivot", "salts", "n"))
    names = spark.createDataFrame([(int(r.pivot), int(r.ring), i, int(r.salts)) for i, r in enumerate(stats.itertuples())], "pivot int, ring int, annulus bigint, salts bigint")
    blocks = index.join(F.broadcast(names), ["pivot", "ring"]).select((F.shiftleft("annulus", 32) + F.col("row") % F.col("salts")).alias("block"), "vec_id", "vec")
    asked = stored(rows.where(is_query).groupBy("vec_id").agg(F.max("vec").alias("q")).select(F.col("vec_id").alias("query_id"), "q"), "queries")
    chunks = max(1, -(-asked.count() // QUERIES))
    chunk = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks)).cast("int")

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left = left.sort_values("vec_id")
        x = np.frombuffer(b"".join(left.vec), np.int64).reshape(len(left), -1).astype(np.float64)
        return best(right.query_id.to_numpy(), np.stack(right.q.to_numpy()).astype(np.float64), left.vec_id.to_numpy(), x, k)

    def expanded(first: int, many: int):
        """Of each query's annuli in order, those from place `first` on, `many` at most, that can reach its k-th score."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, min(1024, 4_000_000 // len(low)))
            for part in parts:
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    q = np.stack(some.q.to_numpy()).astype(np.float64)
                    d = distances(q, pivots)[:, ring_pivot]
                    gap = np.maximum(0, np.maximum(low[None] - d, d - high[None]) - 1e-6)
                    reach = ((q * q).sum(axis=1)[:, None] + norm[None] - gap * gap) / 2
                    order = np.lexsort((d, -reach))[:, first : first + many]
                    kth = some.kth.astype("float64").fillna(-np.inf).to_numpy()
                    i, c = np.nonzero(np.take_along_axis(reach, order, axis=1) + 1e-3 >= kth[:, None])
                    j = order[i, c]
                    times = ring_salts[j]
                    i, j = np.repeat(i, times), np.repeat(j, times)
                    s = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
                    yield pd.DataFrame({"block": (j.astype(np.int64) << 32) + s, "query_id": some.query_id.to_numpy()[i], "q": some.q.to_numpy()[i], "pairs": held[j] / ring_salts[j]})

        return run

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top, first, many, kth = None, 0, 1, asked.select("query_id", F.lit(None).cast("bigint").alias("kth"))
    while first < len(stats):
        wide = asked.join(kth, "query_id").mapInPandas(expanded(first, many), "block bigint, query_id bigint, q array<bigint>, pairs double")
        wide = stored(wide.withColumn("chunk", chunk), "asked")
        pairs = wide.agg(F.sum("pairs")).first()[0]
        if not pairs:
            forget(wide)
            break
        if visits is not None:
            visits.append(round(pairs))
        wanted = blocks.join(wide.select(F.col("block").alias("b"), F.col("chunk").alias("c")).distinct(), F.col("block") == F.col("b"))
        found = wanted.groupBy("b", "c").cogroup(wide.groupBy("block", "chunk")).applyInPandas(ask, "query_id bigint, vec_id bigint, score bigint")
        found = found if top is None else found.unionByName(top.drop("rank"))
        new = stored(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k), "top")
        for used in (wide, top):
            if used is not None:
                forget(used)
        top, first, many = new, first + many, many * STEP
        so_far = top.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("got"))
        kth = asked.select("query_id").join(so_far, "query_id", "left").select("query_id", F.when(F.col("got") >= k, F.col("kth")).alias("kth"))
    for used in (rows, index, asked):
        forget(used)
    return top.select("query_id", "rank", "vec_id", "score") if top is not None else spark.createDataFrame([], schema)
