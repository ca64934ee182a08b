"""Favorite counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: event ids that one window puts in order at most
RANGE = 1 << 20


def fav_count(favorites: DataFrame) -> DataFrame:
    return favorites.groupBy("post_id").agg(F.count("*").alias("fav_count"))


def clamped_counts(events: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """post_id, fav_count after all events in order of event_id, where a count never falls below 0.

    The order-dependent loop c = max(0, c + action) in closed form: c0 + S - least(0, min(c0 + S_k)), S_k being the running
    sums. (S, min S_k) of consecutive ranges of events compose, so a post's events are summed range by range and only one
    row a range is put in order: a post with any number of events is no single task's work. Posts of `start` without
    events keep their count."""
    rows = events.select("post_id", "event_id", "action", F.floor(F.col("event_id") / RANGE).alias("range"))
    run = F.sum("action").over(Window.partitionBy("post_id", "range").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.withColumn("s", run).groupBy("post_id", "range").agg(F.sum("action").alias("total"), F.min("s").alias("low"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("post_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.withColumn("low", before + F.col("low")).groupBy("post_id").agg(F.sum("total").alias("total"), F.min("low").alias("low"))
    rows = sums.join(start, "post_id", "full_outer") if start is not None else sums.withColumn("fav_count", F.lit(0))
    c0 = F.coalesce("fav_count", F.lit(0))
    total, low = F.coalesce("total", F.lit(0)), F.coalesce("low", F.lit(0))
    return rows.select("post_id", (c0 + total - F.least(F.lit(0), c0 + low)).cast("bigint").alias("fav_count"))
