"""Helpers that the text operators share: tables, shared storage, held-out folds, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where all run in one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's own setting to delete a query's shuffle files when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: seconds between two times that the driver hands memory back
RELEASE_S = 3.0


def handed_back() -> None:
    """Give memory that this process freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(spark: SparkSession) -> None:
    """The driver drops plans, broadcasts and buffers of finished steps: Python's first, as they hold the JVM's. Else either
    process grows until its own limit, whatever little it needs."""
    now = time.monotonic()
    if now - HELD_BACK.get("at", -RELEASE_S) < RELEASE_S:
        return
    gc.collect()
    handed_back()
    spark.sparkContext._jvm.System.gc()
    HELD_BACK["at"] = time.monotonic()


#: when the driver handed memory back last
HELD_BACK: dict[str, float] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage and survives lost executors. The shuffle
    files that it took are deleted then."""
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    released(df.sparkSession)
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_kindred_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: bytes of the batches that travel to Python workers, where the session sets none: texts may be long
BATCH_BYTES = 8 << 20


#: what a worker keeps from task to task, by name
HELD: dict[str, Any] = {}


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType | str, holds: str | None = None) -> DataFrame:
    """df.mapInArrow(run) in batches of bounded size. A worker forgets what it holds for others than `holds`, and when done hands
    the memory that it freed back to the system."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)

    def inner(parts: Iterator) -> Iterator:
        from kindred.llm import common  # the worker's own

        for name in [x for x in common.HELD if x != holds]:
            del common.HELD[name]
        try:
            yield from run(parts)
        finally:
            common.handed_back()

    return df.mapInArrow(inner, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def hashed_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; a null key has a fixed one."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(1 << 53)


def bounded_sample(df: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """About `most` rows at most, chosen by the hash of the key: the same rows for the same table, however it is split."""
    total = df.count()
    return df if total <= most else df.where(hashed_share(key, seed) < most / total)


#: files of a stored sample, whose rows are bounded
SAMPLE_FILES = 4


def bounded_texts(rows: DataFrame, most_chars: int) -> list[Row]:
    """The rows of a sample (with text), in the order of their texts' hashes as far as `most_chars` characters go; a text that
    exceeds what is left is skipped. Only lengths reach the driver before that is settled."""
    kept = stored(rows.withColumn("_hash", F.xxhash64("text")).withColumn("_size", F.coalesce(F.char_length("text"), F.lit(0))).repartition(SAMPLE_FILES), "sample")
    left, chosen = most_chars, []
    for r in sorted(kept.groupBy("_hash", "_size").count().collect()):  # a row for each text of the sample at most
        if r["_size"] * r["count"] <= left:
            left -= r["_size"] * r["count"]
            chosen.append((r["_hash"], r["_size"]))
    if not chosen:
        forget(kept)
        return []
    wanted = rows.sparkSession.createDataFrame(chosen, "_hash bigint, _size int")
    out = kept.join(F.broadcast(wanted), ["_hash", "_size"]).drop("_hash", "_size").collect()
    forget(kept)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, most_chars: int = 60_000_000) -> list[tuple[str, int, str]]:
    """(text, label, lang) of about `most` labelled documents at most, none of whose remainder is `held`, and of
    `most_chars` characters at most: of a sample with more, texts that exceed what is left are skipped.

    The chosen label rows are bounded by `most`, hence safe to broadcast. Null labels and ids are left out; an id
    with several labels takes their rounded mean.
    """
    own = labels.select("doc_id", F.col(label).alias("y")).where("y is not null and doc_id is not null").where(fold(F.col("doc_id"), folds) != held)
    own = bounded_sample(own, F.col("doc_id"), most, 7).groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    rows = bounded_texts(documents.select("doc_id", "text", "lang").join(F.broadcast(own), "doc_id").select("text", "y", "lang"), most_chars)
    return sorted((r.text or "", int(r.y > 0), r.lang or "") for r in rows)


def texts_of(batch: pa.RecordBatch, column: str = "text", step: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, some at a time, with the place of the first."""
    col = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(col), step):
        yield at, col.slice(at, step).to_pylist()


class HashCache(dict):
    """word -> unsigned 64-bit hash, made on first use and bounded in size."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


FILTER_BITS = 27


def bit_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of one hash over a column of well mixed 64-bit integers. It is of a fixed size, whatever the rows: at
    most 2**bits bits pass through the driver; where they are too few, the filter only lets more through."""
    rows = df.groupBy(F.expr(f"shiftrightunsigned({column}, {70 - bits})").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int)))").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in rows.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    del rows
    handed_back()
    return out


def may_hold(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value passes the filter: all that were put in do."""
    at = values.view(np.uint64) >> np.uint64(59 - len(held).bit_length())
    return (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def batches(rows: Iterable[dict[str, Any]], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, in order, without any others."""
    return df.select(*DOCUMENT_COLUMNS)
