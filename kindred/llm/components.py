"""Connected components of a graph that is too large for one machine, by alternating stars (Kiveris et al., 2014).

Each round is two shuffles with map-side aggregates; results go to the shared folder, so the plan never grows and lost
executors cost one round at most. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import forget, stored


def dealt(placed: DataFrame, key: str, chunk: int) -> DataFrame:
    """placed with (a, b, chunk): each family's rows (column `members` counts them) are cut by the hash of `key` into chunks
    of about `chunk` rows, more in huge families so that a row's copies stay few; every pair of chunks is one block."""
    chunks = F.greatest(F.lit(1), F.least(F.ceil(F.col("members") / chunk), F.lit(32) + F.ceil(F.col("members") / (64 * chunk)))).cast("int")
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    return placed.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair", "chunks", "members")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Every node of either end hangs its neighbours (large: the greater ones; small: itself and the
    smaller ones) under the least of its neighbourhood."""
    if large:
        ends = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m"))
        out = ends.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component): for each node with a link, the least node it reaches. edges: (u, v), any order, loops ignored. A round
    halves the depth of what is left, about, so there are as many rounds as it takes. The result is stored; forget() it."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    done = was[0] == 0
    while not done:
        new = stored(star(star(now, True), False), "edges")
        forget(now)
        is_ = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        now, done = new, is_ == was
        was = is_
    # settled: every node but the least of its component hangs under that one
    out = now.select("u", F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
    out._kindred_path = now._kindred_path
    return out
