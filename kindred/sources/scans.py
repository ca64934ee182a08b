"""Source scans: watermarks and keyset pages over posts, tags, favorites and favorite events."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.columns import keyset_after

EPOCH = datetime(1970, 1, 1)


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table of a database; with a numeric key and its bounds, read by many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def with_retry(action: Callable[[], Any], attempts: int = 5, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """action(), again after a failure, waiting twice as long each time."""
    for k in range(attempts):
        try:
            return action()
        except AnalysisException:
            raise  # will not pass the next time either
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(min(most, first * 2**k))


def max_event_id(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("event_id"), F.lit(0)).cast("bigint").alias("max_event_id"))


def max_updated_at(posts: DataFrame) -> DataFrame:
    return posts.agg(F.max("updated_at").alias("max_updated_at"))


def events_after(events: DataFrame, cursor: int, bound: datetime, limit: int | None = None) -> DataFrame:
    """Events behind the cursor and not older than the bound; with a limit, the first page in order of event_id. An
    event behind the cursor but older than the bound is late, and left out for good."""
    out = events.where((F.col("event_id") > cursor) & (F.col("created_at") >= F.lit(bound)))
    return out if limit is None else out.orderBy("event_id").limit(limit)


def changed_posts(posts: DataFrame, watermark: datetime | None, last_id: int = -1, limit: int | None = None) -> DataFrame:
    """Posts behind (watermark, last_id); those at the watermark itself come again. Null updated_at never comes."""
    out = posts.where(keyset_after(["updated_at", "id"], [watermark or EPOCH, last_id]))
    return out if limit is None else out.orderBy("updated_at", "id").limit(limit)


def favorites_page(favorites: DataFrame, user_id: int = -1, post_id: int = -1, limit: int | None = None) -> DataFrame:
    out = favorites.where(keyset_after(["user_id", "post_id"], [user_id, post_id]))
    return out if limit is None else out.orderBy("user_id", "post_id").limit(limit)


def all_posts(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("id") > -1)


def tag_metadata(tags: DataFrame) -> DataFrame:
    """One row for each name (of equal names the greatest row)."""
    return tags.groupBy("name").agg(F.max(F.struct("category", "post_count")).alias("m")).select("name", "m.category", "m.post_count")


def post_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("n_posts"))


def event_lag(events: DataFrame, last_event_id: int) -> DataFrame:
    return max_event_id(events).select(F.greatest(F.lit(0).cast("bigint"), F.col("max_event_id") - last_event_id).alias("lag"))


def posts_watermark(posts: DataFrame, watermark: datetime) -> DataFrame:
    """The greater of the watermark and the latest updated_at; nulls don't count."""
    return posts.agg(F.greatest(F.max("updated_at"), F.lit(watermark).cast("timestamp_ntz")).alias("new_watermark"))


def check_watermark_age(last_event_id: int, created_at: datetime, now: datetime, retention_days: int = 14) -> None:
    """Raise if the events behind the watermark may be gone from the source already."""
    if last_event_id > 0 and created_at != EPOCH and (now - created_at) // timedelta(days=1) >= retention_days - 1:
        raise RuntimeError(f"event watermark of {created_at} is {(now - created_at).days} days old; events are kept for {retention_days}: run a backfill")
