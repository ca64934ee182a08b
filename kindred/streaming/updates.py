"""Structured Streaming over the event log: every micro-batch folds what is behind the snapshot's own watermark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.config import EngineConfig
from kindred.engine import METRICS, Sources, update
from kindred.operators.store import ModelNotLoaded, Snapshot

EVENT_SCHEMA = "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz"


def event_stream(spark, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events once by event_id, however late a copy within the delay. Watermarks need a zoned timestamp."""
    return stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_updates(stream: DataFrame, sources: Sources, config: EngineConfig, checkpoint: str, *, now: Callable[[], datetime] | None = None, version: Callable[[int], str | None] = lambda batch: None) -> StreamingQuery:
    """Start the query; it ends when what is there has been folded. A batch that is run again after a failure finds its
    events at or below the published watermark, and so changes nothing twice."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            at = Snapshot(spark, config.model_dir).state.last_event_id
        except ModelNotLoaded as e:
            raise RuntimeError("run a backfill first") from e
        events = batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).where(F.col("event_id") > at)
        if not events.isEmpty():
            update(spark, Sources(sources.posts, sources.tags, sources.favorites, events), config, now=now() if now else None, version=version(batch_id))
        METRICS["stream_last_batch"] = batch_id

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
