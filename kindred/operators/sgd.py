"""The ordered fold of reactions into user and post vectors.

Each event moves both vectors by the other's old value; order matters through users and posts at once, so the fold
is one ordered task, and everything around it stays distributed. Events of one wavefront level touch different users
and posts, so a level is one vectorized step; the result is that of the event-by-event loop, bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def start_vector(kind: int, key: int, dim: int, seed: int) -> np.ndarray:
    """N(0, 1) * 0.01 in single precision, the same for one entity whenever it is first seen."""
    return (np.random.default_rng([seed, kind, key & ((1 << 64) - 1)]).standard_normal(dim) * 0.01).astype(np.float32)


def levels(users: np.ndarray, posts: np.ndarray, u_level: np.ndarray, p_level: np.ndarray) -> np.ndarray:
    """1 + the greater level of the last event of the same user and of the same post; rows of u_level and p_level are
    advanced in place."""
    out = np.empty(len(users), np.int64)
    for k, (u, p) in enumerate(zip(users.tolist(), posts.tolist())):
        out[k] = u_level[u] = p_level[p] = max(u_level[u], p_level[p]) + 1
    return out


def fold_rows(u: np.ndarray, p: np.ndarray, users: np.ndarray, posts: np.ndarray, actions: np.ndarray, lr: float, reg: float, most: float) -> None:
    """Fold events (rows into u and p, in order) in place, level by level."""
    lev = levels(users, posts, np.zeros(len(u), np.int64), np.zeros(len(p), np.int64))
    order = np.argsort(lev, kind="stable")
    cuts = np.flatnonzero(np.diff(lev[order])) + 1
    lr32, decay = np.float32(lr), np.float32(lr * reg)
    for at in np.split(order, cuts):
        i, j = users[at], posts[at]
        a, b = u[i], p[j]
        step = lr32 * actions[at].astype(np.float32)[:, None]
        for rows, new, where in ((u, a + step * b - decay * a, i), (p, b + step * a - decay * b, j)):
            n = np.sqrt((new.astype(np.float64) ** 2).sum(axis=1))
            big = np.isfinite(n) & (n > most) if most > 0 else np.zeros(len(n), bool)
            new[big] = new[big] * (most / n[big]).astype(np.float32)[:, None]
            rows[where] = new


def sgd_fold(events: DataFrame, state: DataFrame | None = None, *, dim: int = 64, lr: float = 0.01, reg: float = 0.001, most: float = 10.0, seed: int = 42) -> DataFrame:
    """kind ('user' or 'post'), id, vec after all events in order of event_id. state: vectors to start from, in the same
    form; entities of it without events come back as they are."""
    known = None if state is None else state.select(F.lit(None).cast("bigint").alias("event_id"), F.col("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("int").alias("action"), "vec")
    rows = events.select("event_id", F.lit("event").alias("kind"), F.col("user_id").alias("a"), F.col("post_id").alias("b"), F.col("action").cast("int").alias("action"), F.lit(None).cast("array<float>").alias("vec"))
    # entities that no event touches need not pass through the ordered task
    if known is not None:
        touched = events.select(F.lit("user").alias("kind"), F.col("user_id").alias("a")).union(events.select(F.lit("post"), "post_id")).distinct()
        idle = known.join(touched, ["kind", "a"], "left_anti").select("kind", F.col("a").alias("id"), "vec")
        rows = rows.unionByName(known.join(touched, ["kind", "a"], "left_semi"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: list[dict[int, int]] = [{}, {}]
        vecs: list[list[np.ndarray]] = [[], []]
        tables: list[np.ndarray] = [np.zeros((0, dim), np.float32)] * 2

        def place(kind: int, ids: np.ndarray) -> np.ndarray:
            for x in ids.tolist():
                if x not in index[kind]:
                    index[kind][x] = len(index[kind])
                    vecs[kind].append(start_vector(kind, x, dim, seed))
            return np.fromiter((index[kind][x] for x in ids.tolist()), np.int64, len(ids))

        for part in parts:  # in order: known vectors first, then events
            for kind, name in enumerate(("user", "post")):
                for x, v in part.loc[part.kind == name, ["a", "vec"]].itertuples(index=False):
                    index[kind][int(x)] = len(index[kind])
                    vecs[kind].append(np.asarray(v, np.float32))
            e = part[part.kind == "event"]
            if len(e):
                at = [place(0, e.a.to_numpy(np.int64)), place(1, e.b.to_numpy(np.int64))]
                for kind in (0, 1):
                    if vecs[kind]:
                        tables[kind] = np.concatenate([tables[kind], np.stack(vecs[kind])])
                        vecs[kind] = []
                fold_rows(tables[0], tables[1], at[0], at[1], e.action.to_numpy(np.int64), lr, reg, most)
        for kind, name in enumerate(("user", "post")):
            if vecs[kind]:
                tables[kind] = np.concatenate([tables[kind], np.stack(vecs[kind])])
            ids = list(index[kind])
            for k in range(0, len(ids), 4096):
                yield pd.DataFrame({"kind": name, "id": ids[k : k + 4096], "vec": list(tables[kind][k : k + 4096])})

    ordered = rows.repartition(1).sortWithinPartitions(F.col("event_id").asc_nulls_first())
    out = ordered.mapInPandas(run, "kind string, id bigint, vec array<float>")
    return out.unionByName(idle) if known is not None else out
