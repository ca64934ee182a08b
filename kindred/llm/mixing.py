"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic); a cell's weight is the product of one factor of each, raked until
the weighted tokens meet each marginal's target shares. Weights become inclusion probabilities, capped at 1 and
calibrated so that the expected tokens are `budget` of all; where caps bind, they are raked again, so that the marginals
still hold as well as the caps allow: a value's goal is at most its tokens, and the others of its dimension make up for it.
A document is sampled if a number made from the hash of its id and a seed is below its cell's probability.

Targets are parameters, or by default tempered shares (tokens to the power `temper`). Every value of a dimension is raked by
itself. Of a dimension with targets, values that are not named keep their tempered share and the named ones divide the rest
in proportion to their targets (0 for none); None names null, topics are named by number. Up to CELLS cells are raked on the
driver; more stay in a table, whose marginals are aggregates. Sources are raked last: where marginals contradict each other
(each source has its own topics, say), the sources' hold. Topics are clusters of hashed word counts, learned from every text;
each text is put into the nearest, one without long words into 0.

Tokens are the words between ASCII white space. Defined results: null source and language are values of their own; null and empty texts have no tokens and the
probability of their cell; a null id is sampled like any fixed id; repeated ids are sampled together. Further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from kindred.llm.common import forget, hashed_share, mapped, mix64, stored

TOPICS, TERMS, LONG, CELLS = 8, 256, 6, 100_000
DIMENSIONS = ("source", "lang", "topic")
#: the column of the counts of long words; a bucket fits into a byte
COUNTS = "_long_words"


class Topics:
    """Clusters of texts by the words of LONG characters and more: counts of hashed words, damped and weighted by how few
    texts hold them, on the unit sphere."""

    def __init__(self, rare: np.ndarray, centers: np.ndarray) -> None:
        self.rare, self.centers = rare, centers

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The nearest cluster; ties and texts without long words go to the lower."""
        return (self.vectors(counts, self.rare) @ self.centers.T).round(9).argmax(axis=1)

    @staticmethod
    def vectors(counts: np.ndarray, rare: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * rare
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and how many long ones fall into each of TERMS hash buckets."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    tokens = np.bincount(owner[sizes > 0], minlength=len(texts))
    long = np.flatnonzero(sizes >= LONG)
    named = words.take(pa.array(long)).dictionary_encode()
    bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % TERMS for w in named.dictionary.to_pylist()), np.int64, len(named.dictionary))
    place = owner[long] * TERMS + (bucket[named.indices.to_numpy()] if len(long) else np.zeros(0, np.int64))
    return tokens, np.bincount(place, minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float64)


def packed(counts: np.ndarray) -> pa.Array:
    """The counts of each text that are not 0, eight bytes each: the count, and its bucket in the lowest byte."""
    owner, bucket = np.nonzero(counts)
    held = (counts[owner, bucket].astype(np.uint64) << np.uint64(8)) | bucket.astype(np.uint64)
    starts = 8 * np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(held.astype("<u8").tobytes())])


def unpacked(column: pa.Array) -> np.ndarray:
    """The counts that packed() took."""
    column = column.cast(pa.large_binary())
    out = np.zeros((len(column), TERMS))
    if not len(column):
        return out
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
    if starts[-1] > starts[0]:
        held = np.frombuffer(column.buffers()[2], "<u8", int(starts[-1]))[starts[0] :]
        out[np.repeat(np.arange(len(out)), np.diff(starts)), (held & np.uint64(255)).astype(np.int64)] = held >> np.uint64(8)
    return out


def counted(documents: DataFrame) -> DataFrame:
    """documents (with text), n_tokens bigint and the counts of their long words."""
    names = documents.columns
    schema = StructType([*documents.schema.fields, StructField("n_tokens", LongType()), StructField(COUNTS, BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                tokens, counts = word_counts(some.column(names.index("text")))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(tokens, pa.int64()), packed(counts)], [*names, "n_tokens", COUNTS])

    return mapped(documents, run, schema)


def placed(rows: DataFrame, topics: Topics) -> DataFrame:
    """rows that counted() made, the counts of their words replaced by topic int."""
    names = [c for c in rows.columns if c != COUNTS]
    schema = StructType([*(f for f in rows.schema.fields if f.name != COUNTS), StructField("topic", IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                near = topics.of(unpacked(some.column(some.schema.get_field_index(COUNTS))))
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(near, pa.int32())], [*names, "topic"])

    return mapped(rows, run, schema)


def with_topics(documents: DataFrame, topics: Topics) -> DataFrame:
    """documents (with text) and topic int, n_tokens bigint."""
    return placed(counted(documents), topics).select(*documents.columns, "topic", "n_tokens")


def learn_topics(documents: DataFrame, *, topics: int = TOPICS, rounds: int = 20, seed: int = 3) -> Topics:
    """Spherical k-means over every text with long words (or over rows that counted() made), begun by k-means++. Each step is one
    pass over the stored counts, of which numbers of a fixed size reach the driver; sums are of integers, so they are the same
    however the table is split."""
    rows = documents if COUNTS in documents.columns else counted(documents.where("text is not null").select("doc_id", "text"))
    some = stored(rows.where(F.length(COUNTS) > 0).select(F.xxhash64("doc_id", COUNTS, F.lit(seed)).alias("hash"), COUNTS), "long_words")

    def tasks(step: Callable[[np.ndarray, np.ndarray, pa.Array], None], result: Callable[[], dict], schema: str) -> list:
        """What each task returns after step() took all its rows."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    step(unpacked(part.column(1)), part.column(0).to_numpy().view(np.uint64), part.column(1))
            if found := result():
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in found.items()})

        return mapped(some, run, schema).collect()

    def total(add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sums of integers that add() makes of each batch's counts."""
        sums = np.zeros(size, np.int64)

        def step(counts: np.ndarray, *_: object) -> None:
            np.add(sums, add(counts), out=sums)

        return sum((np.frombuffer(r.sums, np.int64) for r in tasks(step, lambda: {"sums": sums.tobytes()}, "sums binary")), np.zeros(size, np.int64))

    n, *holders = total(lambda counts: np.concatenate([[len(counts)], (counts > 0).sum(axis=0)]), TERMS + 1).tolist()
    rare = np.log((n + 1) / (np.array(holders) + 1)) + 1e-3
    centers = np.zeros((0, TERMS))

    def next_seed(k: int) -> np.ndarray | None:
        """A text drawn with odds of its distance to the nearest centre: of all, the first to arrive at such a rate."""
        best: dict = {}

        def step(counts: np.ndarray, hashes: np.ndarray, column: pa.Array) -> None:
            x = Topics.vectors(counts, rare)
            gap = np.maximum(1 - (x @ centers.T).round(9).max(axis=1), 0) if len(centers) else np.ones(len(x))
            share = ((mix64(hashes ^ np.uint64(k)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            wait = np.divide(-np.log(share), gap, out=np.full(len(x), np.inf), where=gap > 1e-9)
            at = int(wait.argmin()) if len(wait) else 0
            if len(wait) and (wait[at], int(hashes[at]) >> 1) < (best.get("wait", np.inf), best.get("hash", 0)):
                best.update(wait=float(wait[at]), hash=int(hashes[at]) >> 1, counts=column[at].as_py())

        found = sorted((r.wait, r.hash, bytes(r.counts)) for r in tasks(step, lambda: best, "wait double, hash bigint, counts binary"))
        return Topics.vectors(unpacked(pa.array([found[0][2]], pa.binary())), rare) if found else None

    while len(centers) < topics and (chosen := next_seed(len(centers) + 1)) is not None:
        centers = np.concatenate([centers, chosen])
    if not len(centers):
        forget(some)
        return Topics(rare, np.zeros((1, TERMS)))

    def members(counts: np.ndarray) -> np.ndarray:
        x = Topics.vectors(counts, rare)
        near = (x @ centers.T).round(9).argmax(axis=1)
        return np.concatenate([np.rint(x[near == k] * (1 << 30)).astype(np.int64).sum(axis=0) for k in range(len(centers))])

    before = None
    for _ in range(rounds):
        sums = total(members, len(centers) * TERMS).reshape(len(centers), TERMS)
        if before is not None and (sums == before).all():
            break
        before, size = sums, np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
        centers = np.divide(sums, size, out=centers.copy(), where=size > 0)
    forget(some)
    return Topics(rare, centers)


def rake(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells (column tokens) that give every dimension its target shares of the weighted tokens; values
    with tokens but no target get none."""
    tokens = cells.tokens.to_numpy(float)
    w = np.ones(len(cells))
    codes = {d: pd.factorize(cells[d].astype(str), sort=True) for d in targets}
    goals = {d: np.array([targets[d].get(v, 0.0) for v in codes[d][1]], float) for d in targets}
    for _ in range(rounds):
        before = w.copy()
        for d, goal in goals.items():
            code = codes[d][0]
            share = goal / goal.sum() if goal.sum() else goal
            now = np.bincount(code, w * tokens, len(share))
            w = w * np.divide(share * tokens.sum(), now, out=np.ones_like(now), where=now > 0)[code]
        if np.allclose(w, before, rtol=tolerance, atol=0):
            break
    return w


def rake_capped(cells: pd.DataFrame, targets: dict[str, dict], weights: np.ndarray, budget: float, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Probabilities min(1, weight times one factor for each value of each dimension) whose expected tokens are budget of all
    and meet the targets, where a value can't have more than its tokens. A step moves towards the goal and never beyond it."""
    tokens = cells.tokens.to_numpy(float)
    p = calibrate(tokens, weights, budget)
    if not len(p) or p.max() < 1:
        return p  # no cap binds: the marginals of the weights hold
    codes, totals, share = {d: pd.factorize(cells[d].astype(str), sort=True) for d in targets}, {}, {}
    for d, (code, values) in codes.items():
        totals[d] = np.bincount(code, tokens, len(values))
        share[d] = np.divide([targets[d].get(v, 0.0) for v in values], totals[d], out=np.zeros(len(values)), where=totals[d] > 0)
    part = min((calibrate(totals[d], share[d], budget) * totals[d]).sum() for d in targets) / (tokens.sum() or 1.0)
    goals = {d: calibrate(totals[d], share[d], part) * totals[d] for d in targets}
    r = weights * part
    for _ in range(rounds):
        before = np.minimum(r, 1)
        for d, goal in goals.items():
            code = codes[d][0]
            full = np.bincount(code, tokens * (r >= 1), len(goal))
            mass = np.bincount(code, tokens * np.where(r < 1, r, 0), len(goal))
            up = np.divide(goal - full, mass, out=np.ones_like(mass), where=mass > 0)
            down = np.divide(goal, full + mass, out=np.ones_like(mass), where=full + mass > 0)
            r = r * np.where(goal < full + mass, down, up)[code]
        if np.allclose(np.minimum(r, 1), before, rtol=tolerance, atol=0):
            break
    return np.minimum(r, 1)


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight), c such that the expected tokens are budget of all (or as many as can be)."""
    goal, order = budget * tokens.sum(), np.argsort(-weights, kind="stable")
    t, w = tokens[order], weights[order]
    left = goal - np.concatenate([[0.0], np.cumsum(t)[:-1]])  # for those from each place on, if the ones before are capped
    mass = np.cumsum((t * w)[::-1])[::-1]
    c = np.divide(left, mass, out=np.zeros_like(mass), where=mass > 0)
    fits = np.flatnonzero(c * w <= 1 + 1e-12)
    k = fits[0] if len(fits) else len(t)
    p = np.ones(len(t))
    p[order[k:]] = np.clip(c[k] * w[k:], 0, 1) if k < len(t) else 1.0
    return p


def named(value: object) -> str:
    """A value as the cells have it: null is apart from every text."""
    return "" if value is None else f"={value}"


def shares(totals: pd.Series, temper: float, targets: dict | None) -> dict[str, float]:
    """The target share of each value, from its tokens and the named targets."""
    own = totals.clip(lower=0).astype(float) ** temper
    own = own / own.sum() if own.sum() else own
    goal = pd.Series({named(k): float(v) for k, v in (targets or {}).items()}, dtype=float).reindex(totals.index)
    if goal.isna().all():
        return own.to_dict()
    rest = 1.0 - own[goal.isna()].sum()
    return own.where(goal.isna(), rest * goal / (goal.sum() or 1.0)).to_dict()


def share_table(totals: DataFrame, temper: float, targets: dict | None) -> DataFrame:
    """As shares(), for totals (value, tokens) of any number: (value, tokens, share)."""
    rows = totals.withColumn("own", F.pow(F.col("tokens").cast("double"), F.lit(temper)))
    named_targets = rows.sparkSession.createDataFrame([(named(k), float(v)) for k, v in (targets or {}).items()], "value string, target double")
    rows = rows.join(named_targets, "value", "left")
    every, free, asked = rows.agg(F.sum("own"), F.coalesce(F.sum(F.when(F.col("target").isNull(), F.col("own"))), F.lit(0.0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    every = every or 1.0
    return rows.select("value", "tokens", F.when(F.col("target").isNull(), F.col("own") / every).otherwise(F.col("target") * ((1 - free / every) / (asked or 1.0))).alias("share"))


def fitted(cells: DataFrame, goals: dict[str, DataFrame], capped: bool, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """cells (with tokens and r) in which r is scaled by one factor for each value of each dimension until its tokens times
    r (capped: at most 1) are the value's goal: (value, goal) tables by dimension. Each round is stored, the table of cells
    never leaves the executors; a capped step moves towards the goal and never beyond it."""
    now = cells
    full = F.sum(F.when(F.col("r") >= 1, F.col("tokens")).otherwise(0).cast("double") if capped else F.lit(0.0))
    mass = F.sum(F.when(F.col("r") >= 1, 0.0).otherwise(F.col("r") * F.col("tokens")) if capped else F.col("r") * F.col("tokens"))
    p = (lambda c: F.least(F.col(c), F.lit(1.0))) if capped else F.col
    for k in range(rounds):
        new = now.withColumn("was", F.col("r"))
        for d, goal in goals.items():
            factor = F.when(F.col("goal") < F.col("full") + F.col("mass"), F.col("goal") / (F.col("full") + F.col("mass"))).when(F.col("mass") > 0, (F.col("goal") - F.col("full")) / F.col("mass")).otherwise(1.0)
            factors = new.groupBy(d).agg(full.alias("full"), mass.alias("mass")).join(goal.withColumnRenamed("value", d), d).select(d, factor.alias("factor"))
            new = new.join(factors, d).withColumn("r", F.col("r") * F.col("factor")).drop("factor")
        new = stored(new, "cells")
        if k:
            forget(now)
        off = new.agg(F.max(F.abs(p("r") - p("was")) - tolerance * p("was"))).first()[0]
        now = new.drop("was")
        now._kindred_path = new._kindred_path
        if off is None or off <= 0:
            break
    return now


def rake_table(cells: DataFrame, temper: float, targets: dict[str, dict], budget: float) -> DataFrame:
    """As shares(), rake() and rake_capped(), for cells of any number: their dimensions, weight and probability."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("tokens")).first()[0])
    goals = {f"_{d}": stored(share_table(cells.groupBy(F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("tokens")), temper, targets.get(d)), "goals") for d in reversed(DIMENSIONS)}
    raked = fitted(cells.withColumn("r", F.lit(1.0)), {d: g.select("value", (F.col("share") * total).alias("goal")) for d, g in goals.items()}, False)

    def within(rows: DataFrame, part: float) -> DataFrame:
        """rows (tokens, r), r scaled until the expected tokens are this part of all."""
        return fitted(rows.withColumn("all", F.lit("all")), {"all": spark.createDataFrame([("all", part * total)], "value string, goal double")}, True).drop("all")

    rows = within(raked.withColumn("weight", F.col("r")), budget)
    if rows.where("r >= 1").limit(1).count():  # caps bind
        held = F.sum(F.least("r", F.lit(1.0)) * F.col("tokens"))
        ratio = lambda g: g.select("value", "tokens", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens") * total).otherwise(0.0).alias("r"))
        part = min(within(ratio(g), budget).agg(held).first()[0] for g in goals.values()) / (total or 1.0)
        capped = {d: within(ratio(g), part).select("value", (F.least("r", F.lit(1.0)) * F.col("tokens")).alias("goal")) for d, g in goals.items()}
        rows = fitted(rows, capped, True)
    return rows.select(*(f"_{d}" for d in DIMENSIONS), "weight", F.least("r", F.lit(1.0)).alias("probability"))


def mix(documents: DataFrame, *, budget: float = 0.5, temper: float = 0.7, targets: dict[str, dict] | None = None, seed: int = 29, keep: bool = False, most_cells: int = CELLS, topics: Topics | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every document; with keep, its own columns
    too. The texts' words are counted once; what the rest needs is stored. topics: clusters learned before, in place of the
    documents' own."""
    added = ("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled", "_source", "_lang", "_topic", COUNTS)
    own = [c for c in documents.columns if keep and c not in added]
    texts = counted(documents.select(*dict.fromkeys([*own, "doc_id", "source", "lang", "text"])))
    kept = stored(texts.select(*own, "doc_id", "source", "lang", "n_tokens", COUNTS), "counted")
    topics = topics or learn_topics(kept)

    def in_cells(rows: DataFrame) -> DataFrame:
        rows = placed(rows, topics)
        return rows.withColumns({f"_{d}": F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")) for d in DIMENSIONS})

    by_cell = [f"_{d}" for d in DIMENSIONS]
    rows = in_cells(kept)
    found = stored(in_cells(kept.select("source", "lang", "n_tokens", COUNTS)).groupBy(*by_cell).agg(F.sum("n_tokens").alias("tokens")), "found_cells")
    n = found.count()
    if not n:
        return rows.select(*own, "doc_id", "source", "lang", "topic", "n_tokens", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"), F.lit(True).alias("sampled"))
    if n <= most_cells:
        cells = found.toPandas().rename(columns={f"_{d}": d for d in DIMENSIONS}).sort_values(list(DIMENSIONS)).reset_index(drop=True)
        goals = {d: shares(cells.groupby(d).tokens.sum(), temper, (targets or {}).get(d)) for d in reversed(DIMENSIONS)}
        w = rake(cells, goals)
        p = rake_capped(cells, goals, w, budget)
        made = [(r.source, r.lang, r.topic, float(a), float(b)) for r, a, b in zip(cells.itertuples(), w, p)]
        table = F.broadcast(documents.sparkSession.createDataFrame(made, "_source string, _lang string, _topic string, weight double, probability double"))  # bounded by most_cells
    else:
        table = rake_table(found, temper, targets or {}, budget)
    out = rows.join(table, by_cell)
    return out.select(*own, "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (hashed_share(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))
