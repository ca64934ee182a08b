"""The engine: full rebuild, incremental update, and similar-post queries over published snapshots."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import EngineConfig
from kindred.functions import columns as C
from kindred.operators import ann, counts, sgd, similarity, tags
from kindred.operators.store import EPOCH, ModelNotLoaded, Snapshot, State, Writer, version_name
from kindred.sources import scans

log = logging.getLogger(__name__)
#: counters, gauges and the last durations, by name; a label stands in braces
METRICS: dict[str, float] = {}


def counted(name: str, by: float = 1) -> None:
    METRICS[name] = METRICS.get(name, 0) + by


@contextmanager
def request(endpoint: str) -> Iterator[None]:
    """Count a request by endpoint and status, and time it."""
    start, status = time.time(), "500"
    try:
        yield
        status = "200"
    except (UnknownModeError, ValueError):
        status = "422"
        raise
    finally:
        counted(f"api_requests_total{{{endpoint},{status}}}")
        METRICS[f"api_request_duration_seconds{{{endpoint}}}"] = time.time() - start


class UnknownModeError(ValueError):
    """The model has no such mode."""


SOURCE_TABLES = ("posts", "tags", "favorites", "favorite_events")


@dataclass
class Sources:
    """posts(id, tag_string, updated_at), tags(name, category, post_count), favorites(user_id, post_id),
    favorite_events(event_id, user_id, post_id, action, created_at)."""

    posts: DataFrame
    tags: DataFrame
    favorites: DataFrame
    events: DataFrame

    @staticmethod
    def parquet(spark: SparkSession, folder: str) -> Sources:
        return Sources(*(spark.read.parquet(f"{folder}/{name}") for name in SOURCE_TABLES))

    @staticmethod
    def jdbc(spark: SparkSession, url: str, partitions: int = 32, **options: str) -> Sources:
        """The four tables of a database, tried again while it can't be reached; large ones are read by many tasks, in
        ranges of their key."""

        def read(name: str) -> DataFrame:
            key = {"posts": "id", "favorites": "user_id", "favorite_events": "event_id"}.get(name)
            low = high = None
            if key:
                quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
                low, high = scans.with_retry(lambda: scans.read_jdbc(spark, url, f"(SELECT min({quoted}) AS low, max({quoted}) AS high FROM {name}) AS bounds", **options).first())
            return scans.with_retry(lambda: scans.read_jdbc(spark, url, name, key=key, bounds=(int(low), int(high) + 1) if low is not None else None, partitions=partitions, **options))

        return Sources(*(read(name) for name in SOURCE_TABLES))


def tag_embeddings(vocab: DataFrame, dim: int, seed: int) -> DataFrame:
    """tag_id, vec: N(0, 1) * 0.01 seeded by the id, so that growth keeps the old ones."""

    def run(parts):
        import pandas as pd

        for p in parts:
            yield pd.DataFrame({"tag_id": p.tag_id, "vec": [(np.random.default_rng([seed, int(t)]).standard_normal(dim) * 0.01).astype(np.float32) for t in p.tag_id]})

    return vocab.select("tag_id").mapInPandas(run, "tag_id bigint, vec array<float>")


def publish(spark: SparkSession, config: EngineConfig, *, top: DataFrame, vocab: DataFrame, cf: DataFrame, fav: DataFrame, state: State, version: str | None = None) -> str | None:
    """Vectors of every mode from top tags (post_id, tags) and reaction vectors (kind, id, vec), written as a new version."""
    start, zero = time.time(), F.array_repeat(F.lit(0.0).cast("float"), config.embedding_dim)
    posts_cf = cf.where("kind = 'post'").select(F.col("id").alias("post_id"), "vec")
    universe = posts_cf.select("post_id").union(top.select("post_id")).distinct()
    if universe.isEmpty():
        log.warning("no posts: nothing published")
        return None
    if not posts_cf.where(F.size("vec") != config.embedding_dim).isEmpty():
        raise ValueError("stored vectors have another length than the configuration asks for")
    emb = tag_embeddings(vocab, config.embedding_dim, config.seed)
    flat = top.select("post_id", F.explode("tags").alias("t")).select("post_id", F.col("t.tag_id").cast("bigint").alias("tag_id"), F.col("t.weight").cast("double").alias("weight"))
    dims = tags.tag_vector_arrays(flat, emb).select("post_id", F.transform("vec", lambda x: x.cast("float")).alias("tagvec"))
    rows = universe.join(posts_cf.withColumnRenamed("vec", "cf"), "post_id", "left").join(dims, "post_id", "left").select("post_id", F.coalesce("cf", zero).alias("cf"), F.coalesce("tagvec", zero).alias("tagvec"))
    aligned = universe.join(fav, "post_id", "left").select("post_id", F.coalesce("fav_count", F.lit(0)).alias("fav_count"))
    with Writer(spark, config.model_dir, config.keep_versions) as w:
        w.begin(version or version_name(), config.weight_presets, config.embedding_dim, state, post_top_tags=top, tag_vocab=vocab, fav_count=aligned, cf_vectors=cf, tag_vectors=emb)
        for mode, (w_cf, w_tag) in config.weight_presets.items():
            # rounded to half precision, as vectors are meant to be stored; by position, so files can be skipped by id
            vec = F.transform(C.blend(F.col("cf"), F.col("tagvec"), w_cf, w_tag), lambda x: C.f16_round(x).cast("float"))
            w.mode(mode, rows.select("post_id", vec.alias("vec")).repartitionByRange("post_id").sortWithinPartitions("post_id"))
            written = w.staged(f"post_vectors/mode={mode}").select("post_id", "vec")
            cells = ann.centroids(written, w.counts["fav_count"], seed=config.seed)
            w.index(mode, spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cells)], "cell int, vec array<double>"), ann.celled(written, cells))
        done = w.finish()
    METRICS["updater_index_rebuild_seconds"] = time.time() - start
    return done


def top_and_vocab(sources: Sources, posts: DataFrame, config: EngineConfig, vocab: DataFrame | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    n = sources.posts.count()
    weights = tags.weighted(posts, scans.tag_metadata(sources.tags), n, config.excluded_tags, config.category_weights)
    if "updated_at" in order:
        weights = weights.join(posts.select(F.col("id").alias("post_id"), "updated_at"), "post_id")
    grown = tags.vocabulary(weights, order) if vocab is None else tags.grow_vocabulary(vocab, weights, order).select("tag_id", "tag")
    arrays = tags.as_arrays(tags.top_tags(weights, config.n_top_tags), grown)
    empty = F.array().cast("array<struct<tag_id:int,weight:float>>")
    known = posts.select(F.col("id").alias("post_id")).join(arrays, "post_id", "left").select("post_id", F.coalesce("tags", empty).alias("tags"))
    return known, grown


def backfill(spark: SparkSession, sources: Sources, config: EngineConfig, version: str | None = None) -> str | None:
    """Rebuild from all posts and current favorites (in order of user and post, each as one reaction)."""
    start = time.time()
    last_id = scans.max_event_id(sources.events).first()[0]  # before the scan: what comes later is folded by the next update
    posts = scans.all_posts(sources.posts)
    top, vocab = top_and_vocab(sources, posts, config, None, ["post_id"])
    favs = scans.favorites_page(sources.favorites)
    events = favs.select(F.struct("user_id", "post_id").alias("event_id"), "user_id", "post_id", F.lit(1).alias("action"))
    cf = fold(events, None, config)
    seen = sources.posts.agg(F.max("updated_at")).first()[0]
    state = State(last_event_id=last_id, last_event_created_at=EPOCH, last_posts_updated_at=seen.isoformat() if seen else None)
    out = publish(spark, config, top=top, vocab=vocab, cf=cf, fav=counts.fav_count(favs), state=state, version=version)
    METRICS["updater_run_duration_seconds"] = time.time() - start
    return out


def fold(events: DataFrame, state: DataFrame | None, config: EngineConfig) -> DataFrame:
    return sgd.sgd_fold(events, state, dim=config.embedding_dim, lr=config.sgd_lr, reg=config.sgd_reg, most=config.max_norm, seed=config.seed)


def update(spark: SparkSession, sources: Sources, config: EngineConfig, now: datetime | None = None, version: str | None = None) -> str | None:
    """Fold the events behind the watermark, refresh changed posts, publish; all or nothing in one snapshot."""
    start, old = time.time(), Snapshot(spark, config.model_dir)
    state = old.state
    at = datetime.fromisoformat(state.last_event_created_at)
    scans.check_watermark_age(state.last_event_id, at, now or datetime.now(), config.retention_days)
    METRICS["updater_event_lag"] = scans.event_lag(sources.events, state.last_event_id).first()[0]
    events = scans.events_after(sources.events, state.last_event_id, at)
    latest = events.agg(F.count("*").alias("n"), F.max(F.struct("event_id", "created_at")).alias("last")).first()
    if latest.n:
        state = replace(state, last_event_id=latest["last"].event_id, last_event_created_at=latest["last"].created_at.isoformat())
    fav = counts.clamped_counts(events, old.table("fav_count"))
    cf = fold(events, old.table("cf_vectors"), config)
    seen = datetime.fromisoformat(state.last_posts_updated_at) if state.last_posts_updated_at else None
    changed = scans.changed_posts(sources.posts, seen)
    fresh, vocab = top_and_vocab(sources, changed, config, old.table("tag_vocab"), ["updated_at", "post_id"])
    top = tags.upsert(old.table("post_top_tags"), fresh)
    newest, n_changed = changed.agg(F.max("updated_at"), F.count("*")).first()
    if newest and (seen is None or newest > seen):
        state = replace(state, last_posts_updated_at=newest.isoformat())
    out = publish(spark, config, top=top, vocab=vocab, cf=cf, fav=fav, state=state, version=version)
    counted("updater_events_processed_total", latest.n)
    counted("updater_changed_posts_total", n_changed)
    METRICS.update(updater_watermark_event_id=state.last_event_id, updater_run_duration_seconds=time.time() - start)
    return out


class Engine:
    """Queries over one published version, which stays the same until refresh()."""

    def __init__(self, spark: SparkSession, config: EngineConfig) -> None:
        self.spark, self.config, self.snapshot, self._indexes = spark, config, None, {}

    @staticmethod
    def open(spark: SparkSession, config: EngineConfig) -> Engine:
        """With the current version, or not ready if there is none."""
        engine = Engine(spark, config)
        try:
            engine.refresh()
        except ModelNotLoaded as e:
            log.warning("%s", e)
        return engine

    def refresh(self) -> None:
        self.snapshot, self._indexes = Snapshot(self.spark, self.config.model_dir), {}
        for name in [n for n in METRICS if n.startswith("api_model_version_info")]:
            del METRICS[name]
        METRICS[f"api_model_version_info{{{self.snapshot.version}}}"] = 1
        METRICS["api_ann_index_size"] = self.snapshot.manifest["rows"].get("fav_count", 0)

    def ready(self) -> str | None:
        """The version in use."""
        return self.snapshot.version if self.snapshot else None

    def _vectors(self, mode: str) -> DataFrame:
        if self.snapshot is None:
            raise ModelNotLoaded("no model loaded")
        if mode not in self.snapshot.modes:
            raise UnknownModeError(mode)
        return self.snapshot.vectors(mode)

    def similar(self, post_id: int, limit: int = 6, explain: bool = False, include_scores: bool = True, mode: str = "favorites", probes: int | None = None) -> DataFrame:
        """rank, post_id, score[, shared_tags, fav_query, fav_candidate] of the most similar posts; empty for an unknown one.
        With probes, only that many cells of the index are read."""
        with request("/similar"):
            if not 1 <= limit <= 20:
                raise ValueError("limit must be from 1 to 20")
            vectors = self._vectors(mode)
            index = self._index(mode) if probes else None
            if index is not None:
                own = vectors.where(F.col("post_id") == post_id).select("vec").first()
                near = ann.nearest_cells(index[0], np.array(own.vec), probes) if own else []
                mine = vectors.where(F.col("post_id") == post_id).select("post_id", "vec")  # the query itself may lie in any cell
                vectors = index[1].where(F.col("cell").isin(near) & (F.col("post_id") != post_id)).select("post_id", "vec").unionByName(mine)
            found = similarity.similar_to(vectors, post_id, limit)
            if not include_scores:
                found = found.withColumn("score", F.lit(0.0))
            return self._explained(found, post_id) if explain else found

    def _index(self, mode: str) -> tuple[np.ndarray, DataFrame] | None:
        """The mode's search index, its centroids read once for a version."""
        if mode not in self._indexes:
            self._indexes[mode] = self.snapshot.index(mode)
        return self._indexes[mode]

    def similar_batch(self, ids: DataFrame, limit: int = 6, mode: str = "favorites", probes: int | None = ann.PROBES) -> DataFrame:
        """query_id, rank, post_id, score for many posts at once, found in the `probes` nearest cells of the index; exactly,
        by comparing all blocks, with probes None or in a version without index."""
        with request("/similar_batch"):
            vectors = self._vectors(mode)
            asked, index = vectors.join(ids.select("post_id").distinct(), "post_id", "left_semi"), self._index(mode) if probes else None
            return similarity.similar_all(asked, vectors, limit) if index is None else ann.similar_approx(asked, index[1], index[0], limit, probes)

    def _explained(self, found: DataFrame, post_id: int) -> DataFrame:
        top, vocab, fav = (self.snapshot.table(t) for t in ("post_top_tags", "tag_vocab", "fav_count"))
        empty = F.array().cast("array<struct<tag_id:int,weight:float>>")
        own = top.where(F.col("post_id") == post_id).agg(F.coalesce(F.first("tags", True), empty).alias("own"))  # one row, also for a post without tags
        rows = found.join(top, "post_id", "left").join(F.broadcast(own)).select("rank", "post_id", "score", C.let(F.coalesce("tags", empty), lambda t: tags.shared_pair(t, F.col("own"), self.config.m_shared_tags)).alias("shared"))
        names = rows.select("post_id", F.posexplode("shared").alias("pos", "t")).select("post_id", "pos", F.col("t.tag_id").cast("bigint").alias("tag_id")).join(vocab, "tag_id", "left")
        names = names.groupBy("post_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("tag", F.concat(F.lit("tag_"), "tag_id")).alias("tag")))), lambda x: x["tag"]).alias("shared_tags"))
        query = fav.where(F.col("post_id") == post_id).agg(F.coalesce(F.first("fav_count", True), F.lit(0)).alias("fav_query"))
        out = rows.drop("shared").join(names, "post_id", "left").join(fav.withColumnRenamed("fav_count", "fav_candidate"), "post_id", "left").join(F.broadcast(query))
        return out.select("rank", "post_id", "score", F.coalesce("shared_tags", F.array().cast("array<string>")).alias("shared_tags"), "fav_query", F.coalesce("fav_candidate", F.lit(0)).alias("fav_candidate"))
