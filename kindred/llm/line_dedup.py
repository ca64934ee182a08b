"""Near-duplicate lines by a segment-partition edit join.

A line is cut into tau + 1 segments; a line within edit distance tau holds one of them unchanged, near its place. Keys of
the segments are the index; each line probes it, for every length from its own less tau up, with the substrings that a
match may start at. Lines that meet under a key hang under the least of them (a star, never all pairs), families of
lines are dealt out in blocks, and in a block proposed pairs are verified by banded bit-parallel edit distance.
The first line (by doc_id, then position) of each class of linked lines stays, the others go.

A line counts without white space at its ends, and takes part if it then has at least `least` characters. Defined
results: null texts stay null; shorter lines stay; rows with a null id neither lose lines nor make others lose them;
rows that share an id are one document (equal lines at one position stay or go together). Lines are told apart by 64-bit
hashes. Further columns are kept as they are, but for ones of the names that are added (n_lines, n_dropped), which go.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bit_filter, forget, mapped, may_hold, mix64, stored
from kindred.llm.components import components, dealt
from kindred.llm.winnowing import let

TAU, LEAST = 2, 30
BLANK = " \t\r\x0b\x0c"
CHUNK = 64
GONE = "_places_that_go"
BASE = 0x9E3779B97F4A7C15 | 1


def segments(length: int | np.ndarray, tau: int) -> list[tuple]:
    """(start, length) of each of tau + 1 segments, the longer ones last."""
    base, more = length // (tau + 1), length % (tau + 1)
    out, start = [], length * 0
    for i in range(tau + 1):
        size = base + (i >= tau + 1 - more)
        out.append((start, size))
        start = start + size
    return out


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift from the segment's place) that a match may have."""
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            left, right = (-i, i), (d - (tau - i), d + (tau - i))
            out += [(d, i, s) for s in range(max(left[0], right[0]), min(left[1], right[1]) + 1)]
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], tau: int) -> np.ndarray:
    """Whether each pair of code point arrays (the first not the shorter... any order) has edit distance <= tau: a banded
    bit-parallel computation (Hyyro 2003), all pairs side by side. Lengths must exceed tau."""
    if not pairs:
        return np.zeros(0, bool)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    n1, n2 = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    most = int(n2.max())
    first = np.full((len(pairs), most + 2 * tau + 2), 0xFFFFFFFF, np.uint32)
    second = np.full((len(pairs), most), 0xFFFFFFFE, np.uint32)
    for k, (a, b) in enumerate(pairs):
        first[k, tau : tau + len(a)] = a
        second[k, : len(b)] = b
    width = 2 * tau + 1
    weights = np.uint64(1) << np.arange(64 - width, 64, dtype=np.uint64)
    one, top = np.uint64(1), np.uint64(1 << 63)
    vp = np.full(len(pairs), (((1 << (tau + 1)) - 1) << (63 - tau)) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    score = np.full(len(pairs), tau, np.int64)
    across = np.full(len(pairs), 1 << 62, np.uint64)
    at, near, gap = np.arange(len(pairs)), np.zeros(len(pairs), bool), n2 - n1
    with np.errstate(over="ignore"):
        for i in range(most):
            if i % 32 == 31:  # pairs that ended leave, and those that the last 2 tau steps can't bring back to tau
                near[at] = score <= tau
                live = (i < n2) & (score <= 3 * tau)
                if not live.any():
                    at = at[:0]
                    break
                if not live.all():
                    at, n1, n2, first, second, vp, vn, score, across = (x[live] for x in (at, n1, n2, first, second, vp, vn, score, across))
            x = ((first[:, i : i + width] == second[:, i : i + 1]) * weights).sum(axis=1, dtype=np.uint64)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            diagonal, live = i < n1 - tau, i < n2
            score += np.where(diagonal, (d0 & top) == 0, np.where(live, ((hp & across) != 0).astype(np.int64) - ((hn & across) != 0), 0))
            across = np.where(diagonal, across, across >> one)
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    if len(at):
        near[at] = score <= tau
    return near & (gap <= tau)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def line_id(line: str) -> int:
    """As Spark's xxhash64 of the line, its lowest bit cleared."""
    import xxhash

    x = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) & ~1
    return x - (1 << 64) if x >> 63 else x


def lines_of(texts: list[str | None], least: int) -> dict[int, str]:
    found: dict[int, str] = {}
    for line in {w for t in texts if t for x in t.split("\n") if len(w := x.strip(BLANK)) >= least}:
        found[line_id(line)] = line
    return found


def keys_of(lines: dict[int, str], tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id | 1 if it is an index key) of all lines."""
    ids = np.fromiter(lines, np.int64, len(lines))
    points = [code_points(x) for x in lines.values()]
    sizes = np.array([len(p) for p in points])
    flat = np.concatenate(points)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        power = np.cumprod(np.full(len(flat) + 1, BASE, np.uint64))
        back = np.cumprod(np.full(len(flat) + 1, inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat.astype(np.uint64) + np.uint64(BASE)) * power[: len(flat)])])

        def key(length, i, at, size):
            part = (sums[at + size] - sums[at]) * back[at]
            return mix64(mix64(length.astype(np.uint64) * np.uint64(64) + np.uint64(i)) ^ mix64(part)).view(np.int64)

        keys, owners = [], []
        for i, (start, size) in enumerate(segments(sizes, tau)):
            keys.append(key(sizes, i, starts + start, size))
            owners.append(ids | 1)
        for d, i, shift in probes(tau):
            if d == 0 and shift == 0:
                continue  # the index key serves as this probe
            length = sizes - d
            start, size = segments(length, tau)[i]
            ok = (start + shift >= 0) & (start + shift + size <= sizes)
            keys.append(key(length[ok], i, (starts + start + shift)[ok], size[ok]))
            owners.append(ids[ok])
    return np.concatenate(keys), np.concatenate(owners)


def proposed(lines: list[str], tau: int, cross: int | None) -> set[tuple[int, int]]:
    """Pairs of a block that have a segment in common; with cross, only of the first `cross` lines with the others."""
    index: dict[tuple, list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        for i, (start, size) in enumerate(segments(len(line), tau)):
            index[len(line), i, line[start : start + size]].append(k)
    pairs = set()
    for k, line in enumerate(lines):
        for d, i, shift in probes(tau):
            start, size = segments(len(line) - d, tau)[i]
            if start + shift >= 0:
                for j in index.get((len(line) - d, i, line[start + shift : start + shift + size]), ()):
                    if j != k and (cross is None or (j < cross) != (k < cross)):
                        pairs.add((min(j, k), max(j, k)))
    return pairs


def trimmed(a: np.ndarray, b: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the start and the end that they share, as far as more than tau of each are left: the distance stays."""
    room = max(0, min(len(a), len(b)) - tau - 1)
    differ = np.flatnonzero(a[:room] != b[:room])
    start = int(differ[0]) if len(differ) else room
    a, b = a[start:], b[start:]
    room = max(0, min(len(a), len(b)) - tau - 1)
    differ = np.flatnonzero(a[len(a) - room :][::-1] != b[len(b) - room :][::-1])
    end = int(differ[0]) if len(differ) else room
    return a[: len(a) - end], b[: len(b) - end]


def link_blocks(blocks: list[tuple[list[int], list[str], int | None]], tau: int) -> list[tuple[int, int]]:
    """Links that join what is linked in each block (ids, lines, cross). The pairs of all blocks are verified together."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    points: dict[tuple[int, int], np.ndarray] = {}
    first, rest = [], []  # each line's first partner joins most of what there is to join; few other pairs are left then
    for n, (_, lines, cross) in enumerate(blocks):
        met = set()
        for a, b in sorted(proposed(lines, tau, cross)):
            (rest if b in met else first).append((n, a, b))
            met.add(b)
    out = []

    def verify(pairs: list[tuple[int, int, int]]) -> None:
        todo = []
        for n, a, b in pairs:
            if find((n, a)) != find((n, b)):
                for k in (a, b):
                    if (n, k) not in points:
                        points[n, k] = code_points(blocks[n][1][k])
                todo.append((n, a, b, *trimmed(points[n, a], points[n, b], tau)))
        todo.sort(key=lambda t: (max(len(t[3]), len(t[4])), t[:3]))
        for at in range(0, len(todo), 4000):
            some = [t for t in todo[at : at + 4000] if find((t[0], t[1])) != find((t[0], t[2]))]
            for (n, a, b, _, _), near in zip(some, within([(x, y) for *_, x, y in some], tau)):
                if near and find((n, a)) != find((n, b)):
                    root[find((n, a))] = find((n, b))
                    out.append((blocks[n][0][a], blocks[n][0][b]))

    verify(first)
    verify(rest)
    return out


def line_classes(documents: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(u, component): the class of each line that some other line is within tau edits of, by line ids."""
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and text is not null").select("text")

    def keyed(shared=None) -> DataFrame:
        """(key, owner) of all lines; with shared, of the keys that pass this filter."""

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for at in range(0, batch.num_rows, 150):
                    lines = lines_of(batch.column(0).slice(at, 150).to_pylist(), least)
                    if lines:
                        keys, owners = keys_of(lines, tau)
                        if shared is not None:
                            ok = may_hold(shared.value, keys)
                            keys, owners = keys[ok], owners[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "owner"])

        return mapped(texts, rows, "key bigint, owner bigint")

    bare = F.col("owner").bitwiseAND(F.lit(-2))
    met = keyed().groupBy("key").agg(F.min(bare).alias("low"), F.max(bare).alias("high"), F.max(F.col("owner").bitwiseAND(F.lit(1))).alias("indexed")).where("low < high and indexed = 1").select("key", "low")
    met = stored(met, "met")
    # few keys meet others: the rest goes before it is shuffled again
    shared = spark.sparkContext.broadcast(bit_filter(met, "key"))
    stars = keyed(shared).join(met, "key").select(bare.alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
    families = components(stars)
    shared.destroy()
    wanted = families.select(F.col("u").alias("id"), F.col("component").alias("family"))
    n = wanted.count()
    chosen = spark.sparkContext.broadcast(bit_filter(wanted, "id"))

    def texts_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 150):
                lines = lines_of(batch.column(0).slice(at, 150).to_pylist(), least)
                ids = np.fromiter(lines, np.int64, len(lines))
                ids = ids[may_hold(chosen.value, ids)]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([lines[i] for i in ids.tolist()])], ["id", "line"])

    lines = mapped(texts, texts_of, "id bigint, line string")
    members = lines.join(wanted, "id").groupBy("id", "family").agg(F.min("line").alias("line"))
    sizes = wanted.groupBy("family").agg(F.count("*").alias("members"))
    band = F.floor(F.length("line") / 16).cast("int")
    near_start = F.length("line") - F.col("band") * 16 < tau
    placed = members.join(sizes, "family").withColumn("band", band).withColumn("band", F.explode(F.when(near_start, F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array("band"))))
    blocks = dealt(placed, "id", CHUNK)

    # many small blocks to a task group, so that their pairs are verified side by side; a block's size is bounded
    blocks = blocks.withColumn("deal", F.pmod(F.xxhash64("family", "band", "a", "b"), F.lit(max(1, n // 400))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(*(group[c].tolist() for c in ("family", "band", "a", "b", "chunk", "id", "line"))))
        found = []
        for (_, _, a, b), block in groupby(rows, itemgetter(0, 1, 2, 3)):
            chunks, ids, lines = zip(*(r[4:] for r in block))
            found.append((list(ids), list(lines), None if a == b else chunks.count(a)))
        return pd.DataFrame(link_blocks(found, tau), columns=["u", "v"]).astype("int64")

    out = components(blocks.groupBy("deal").applyInPandas(run, "u bigint, v bigint"))
    chosen.destroy()
    for used in (met, families):
        forget(used)
    return out


def native_line_id(line):
    return F.xxhash64(line).bitwiseAND(F.lit(-2))


def place(pos: Column, line: Column) -> Column:
    """A line's position above half of its id."""
    return F.shiftleft(pos.cast("bigint"), 32) + line.bitwiseAND(F.lit(0xFFFFFFFF))


def dedup(documents: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """Every column of documents, text without the lines that go, and n_lines and n_dropped."""
    spark: SparkSession = documents.sparkSession
    linked = line_classes(documents, tau, least)
    classes = linked.select(F.col("u").alias("id"), "component")
    known = documents.where("doc_id is not null and text is not null")
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    places = known.select("doc_id", F.posexplode(trimmed).alias("pos", "line")).where(F.length("line") >= least).select("doc_id", "pos", native_line_id(F.col("line")).alias("id"))
    first = places.groupBy("id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("times")).join(classes, "id", "left").where("times > 1 or component is not null")
    first = stored(first.select("id", F.coalesce("component", "id").alias("class"), "doc"), "firsts")
    forget(linked)
    kept = first.groupBy("class").agg(F.min("doc").alias("kept"))
    met = stored(places.join(first.select("id", "class").join(kept, "class"), "id"), "met_lines")
    forget(first)
    same = met.where("doc_id = kept")  # few: the lines of a class in the one document that keeps it
    again = same.join(same.groupBy("class").agg(F.min("pos").alias("kept_pos")), "class").where("pos <> kept_pos")
    gone = met.where("doc_id <> kept").select("doc_id", "pos", "id").unionByName(again.select("doc_id", "pos", "id"))
    gone = gone.groupBy("doc_id").agg(F.collect_set(place(F.col("pos"), F.col("id"))).alias(GONE))
    own = [c for c in documents.columns if c not in ("n_lines", "n_dropped", GONE)]
    rows = documents.select(*own).join(gone, "doc_id", "left")

    def left(lines: Column) -> Column:
        """The lines whose place is not one of those that go; array_except looks them up by hash."""
        every = F.transform(lines, lambda x, i: place(i, native_line_id(F.btrim(x, F.lit(BLANK)))))
        return F.transform(F.array_except(every, GONE), lambda k: F.get(lines, F.shiftright(k, 32).cast("int")))

    stay = F.when(F.col(GONE).isNotNull() & F.col("text").isNotNull(), let(F.split("text", "\n"), left))
    out = rows.select(*own, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"), stay.alias(GONE))
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(F.array_join(GONE, "\n")).alias("text")
    return out.select(*(text if c == "text" else c for c in own), "n_lines", F.coalesce(F.col("n_lines") - F.size(GONE), F.lit(0)).cast("bigint").alias("n_dropped"))
