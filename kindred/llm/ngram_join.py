"""N-gram Jaccard self-join by vertical partitioning: the n-grams of all documents have one global order, from rare to
common (document frequency, then hash), and the order is cut into fragments.

1. Frequencies. Every (document, n-gram) is dealt to a fragment of the hash space, some documents' n-grams to a row; a
   fragment counts exactly in how many documents each of its n-grams stands. Of n-grams that many documents of a row's
   share, only the count travels, so a very common one loads nobody. N-grams of one document alone go here.
2. Prefixes. Sets that link share one of their n - ceil(percent * n) + 1 rarest n-grams. So a document whose unique n-grams
   fill its prefix links with nothing and goes; few are left. Equal sets collapse to one representative.
3. Stars. Documents that share a prefix n-gram hang under the least of them (of a salt first, then of all): never all pairs.
   For these pairs the overlap is counted in every fragment of the global order separately and summed per pair.
4. What shares a prefix n-gram, however indirectly, and is not yet joined is dealt out in blocks (family, chunk, chunk); a
   block proposes pairs of different labels by its own prefixes and returns only as many links as join what is linked.
5. Components of the links.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component. Null
ids come back as they are, as components of their own (null). Repeated ids: rows with one id are one node, linked if
any of their texts links. Sets are compared by 64-bit hashes of n-grams. Rows are told apart by partition and place, so
documents must come in the same order when a lost task runs again, as files do. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import HashCache, forget, mapped, mix64, stored, texts_of
from kindred.llm.components import components, dealt

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: n-grams that are dealt out at once, and that a fragment counts (both bound a task's memory, not what is counted)
FLUSH, FRAGMENT = 500_000, 400_000
#: from how many documents of a flush on only a count of them travels to the fragment
HOT = 4
#: fragments of the global order in which the overlap of a pair is counted
PARTS = 8
SALTS, CHUNK = 64, 256
MARK = 0xFFFF
SHUFFLED = "frag int, uid bigint, grams binary, idx binary, hot binary, times binary, ids binary, sizes binary, marks binary"
COUNTED = "uid bigint, kind int, grams binary, idx binary, classes binary, hot binary, times binary, ids binary, sizes binary, marks binary"
CANDIDATES = "node bigint, doc_id bigint, n bigint, hi bigint, lo bigint, prefix array<bigint>, parts array<array<bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(UPPER).split() if text else []


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes in a row."""
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def shingled(h: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every n-word shingle of documents whose word hashes stand in a row; of fewer words, of the whole."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.cumsum(sizes) - sizes
    grams, owners = [], []
    if len(h) >= n:
        inside = owner[: len(h) - n + 1] == owner[n - 1 :]
        grams.append(chained(h, n)[inside])
        owners.append(owner[: len(h) - n + 1][inside])
    for k in range(1, n):
        short = np.flatnonzero(sizes == k)
        if len(short):
            grams.append(chained(h[(starts[short][:, None] + np.arange(k)).ravel()], k)[::k])
            owners.append(short.astype(np.int32))
    return (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def distinct(grams: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by hash, then owner, without repetitions. Owners of equal hashes must ascend."""
    order = np.argsort(grams, kind="stable")
    g, o = grams[order], owners[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    return g[new], o[new]


def planes(g: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte of all of them, which compresses."""
    return np.diff(g, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def fragment_of(g: np.ndarray, fragments: int) -> np.ndarray:
    return (((g >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def class_of(df: np.ndarray) -> np.ndarray:
    """The place of a frequency in the global order: itself, from 64 on by powers of two."""
    return np.where(df < 64, df, 58 + np.floor(np.log2(np.maximum(df, 1)))).astype(np.uint8)


def flushed(uid: int, ids: np.ndarray, h: np.ndarray, sizes: np.ndarray, n: int, fragments: int) -> pa.RecordBatch:
    """The rows of some documents: one for each fragment that they have n-grams in, and one that sums them up."""
    g, o = distinct(*shingled(h, sizes, n))
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(g)))
    hot = times > HOT
    many = np.repeat(hot, times)
    cold_g, cold_o = g[~many], o[~many].astype(np.uint16)
    hot_g, hot_n = g[starts[hot]], times[hot].astype(np.uint32)
    with np.errstate(over="ignore"):
        marks = np.zeros((2, len(ids)), np.uint64)
        for k in range(2):
            np.add.at(marks[k], o, mix64(g ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k)))
    cold_f, hot_f = fragment_of(cold_g, fragments), fragment_of(hot_g, fragments)
    met = np.unique(np.concatenate([cold_f, hot_f]))
    a, b = (np.searchsorted(cold_f, met, side) for side in ("left", "right"))
    c, d = (np.searchsorted(hot_f, met, side) for side in ("left", "right"))
    m, none = len(met), [None] * len(met)
    last = [hot_g.tobytes(), hot_n.tobytes(), ids.tobytes(), np.bincount(o, minlength=len(ids)).astype(np.uint32).tobytes(), marks.tobytes()]
    columns = [
        pa.array(np.append(met, -1 - uid % 100_003), pa.int32()), pa.array(np.full(m + 1, uid), pa.int64()),
        pa.array([planes(cold_g[x:y]) for x, y in zip(a, b)] + [None], pa.binary()),
        pa.array([cold_o[x:y].tobytes() for x, y in zip(a, b)] + [o[many].astype(np.uint16).tobytes()], pa.binary()),
        pa.array([hot_g[x:y].tobytes() for x, y in zip(c, d)] + [last[0]], pa.binary()), pa.array([hot_n[x:y].tobytes() for x, y in zip(c, d)] + [last[1]], pa.binary()),
        *(pa.array([*none, x], pa.binary()) for x in last[2:]),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHUFFLED.split(", ")])


def dealt_grams(documents: DataFrame, n: int, fragments: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, base, count = HashCache(), TaskContext.get().partitionId() << 40, 0
        ids, hashes, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return flushed(base | count << 16, np.array(ids, np.int64), np.concatenate(hashes), np.array(sizes), n, fragments)

        for batch in parts:
            keys = batch.column(0).to_pylist()
            for at, texts in texts_of(batch, step=256):
                for key, text in zip(keys[at : at + len(texts)], texts):
                    words = words_of(text)
                    ids.append(key)
                    sizes.append(len(words))
                    hashes.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                    held += len(words)
                    if held >= FLUSH or len(ids) >= MARK - 1:
                        yield flush()
                        ids, hashes, sizes, held, count = [], [], [], 0, count + 1
        if ids:
            yield flush()

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return mapped(rows, run, SHUFFLED)


def grouped(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one key, which are neighbours."""
    return ((k, list(rows)) for k, rows in groupby((r for batch in parts for r in batch.to_pylist()), key=lambda r: r[key]))


def counted(shuffled: DataFrame) -> DataFrame:
    """Of each flush the n-grams that some other document has too, with the class of their frequency; kind 2 rows say how
    many occurrences each class has in a fragment."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    schema = pa.schema([(x, pa.int64() if x == "uid" else pa.int32() if x == "kind" else pa.binary()) for x in names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frag, rows in grouped(parts, "frag"):
            if frag < 0:
                yield pa.RecordBatch.from_pylist([{"uid": r["uid"], "kind": 0, **{x: r[x] for x in ("idx", "hot", "times", "ids", "sizes", "marks")}} for r in rows], schema)
                continue
            cold = [unplanes(r["grams"]) for r in rows]
            hot = [np.frombuffer(r["hot"], np.uint64) for r in rows]
            g = np.concatenate(cold + hot)
            row = np.concatenate([np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in xs]) for xs in (cold, hot)])
            idx = np.concatenate([np.frombuffer(r["idx"], np.uint16) for r in rows] + [np.full(sum(map(len, hot)), MARK, np.uint16)])
            times = np.concatenate([np.ones(sum(map(len, cold)), np.int64)] + [np.frombuffer(r["times"], np.uint32).astype(np.int64) for r in rows])
            order = np.argsort(g, kind="stable")
            g, row, idx = g[order], row[order], idx[order]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            df = np.add.reduceat(times[order], starts)
            kind = np.repeat(class_of(df), np.diff(np.append(starts, len(g))))
            more = kind > 1
            g, row, idx, kind = g[more], row[more], idx[more], kind[more]
            order = np.argsort(row, kind="stable")
            g, row, idx, kind = g[order], row[order], idx[order], kind[order]
            cut = np.searchsorted(row, np.arange(len(rows) + 1))
            out = [{"uid": r["uid"], "kind": 1, "grams": planes(g[a:b]), "idx": idx[a:b].tobytes(), "classes": kind[a:b].tobytes()} for r, a, b in zip(rows, cut, cut[1:]) if b > a]
            out.append({"uid": -1, "kind": 2, "sizes": np.bincount(class_of(df), df, 128).astype(np.int64).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema)

    return mapped(shuffled, run, COUNTED)


def order_of(counts: DataFrame) -> np.ndarray:
    """For each class of frequency, the occurrences of shared n-grams before it in the global order, and of all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128, np.int64)
        for batch in parts:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128, dtype=np.int32)), pa.array(total)], ["class", "n"])

    rows = mapped(counts.where("kind = 2").select("sizes"), run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()  # 128 rows
    n = np.zeros(129)
    for r in rows:
        n[r["class"] + 1] = r.n if r["class"] > 1 else 0
    return np.cumsum(n)


def candidates(counts: DataFrame, percent: int, before: np.ndarray, tasks: int) -> DataFrame:
    """Documents that share an n-gram of their prefix: size and mark of the set, the prefix's shared n-grams and all shared
    ones, by fragment of the global order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, rows in grouped(parts, "uid"):
            head = rows[0]  # kind 0 comes first
            ids, sizes, marks = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["sizes"], np.uint32).astype(np.int64), np.frombuffer(head["marks"], np.int64)
            hot, times, hot_idx = np.frombuffer(head["hot"], np.uint64), np.frombuffer(head["times"], np.uint32).astype(np.int64), np.frombuffer(head["idx"], np.uint16)
            rest = rows[1:]
            if not rest:
                continue
            g = np.concatenate([unplanes(r["grams"]) for r in rest])
            idx = np.concatenate([np.frombuffer(r["idx"], np.uint16) for r in rest])
            kind = np.concatenate([np.frombuffer(r["classes"], np.uint8) for r in rest])
            marked = idx == MARK  # these stand for all documents of the flush that have the n-gram
            at = np.searchsorted(hot, g[marked])
            many, first = times[at], (np.cumsum(times) - times)[at]
            places = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            g, kind, idx = np.concatenate([g[~marked], np.repeat(g[marked], many)]), np.concatenate([kind[~marked], np.repeat(kind[marked], many)]), np.concatenate([idx[~marked], hot_idx[places]])
            shared = np.bincount(idx, minlength=len(ids))
            take = (sizes + (-percent * sizes) // 100 + 1) - (sizes - shared)  # prefix length, less the unique n-grams
            wanted = (take > 0) & (shared > 0)
            ok = wanted[idx]
            g, kind, idx = g[ok], kind[ok], idx[ok]
            order = np.lexsort((g, kind, idx))
            g, kind, idx = g[order], kind[order], idx[order]
            part = np.minimum((before[kind] + (before[kind.astype(int) + 1] - before[kind]) * (g / 2.0**64)) * PARTS / max(before[-1], 1), PARTS - 1).astype(int)
            docs = np.flatnonzero(wanted)
            if not len(docs):
                continue
            cut = np.searchsorted(idx, np.append(docs, len(ids)))
            whole, low = pa.array(g.view(np.int64)), [a + np.searchsorted(part[a:b], np.arange(PARTS)) for a, b in zip(cut, cut[1:])]
            inner = pa.ListArray.from_arrays(pa.array(np.append(np.concatenate(low), len(g)).astype(np.int32)), whole)
            own = [g[a : a + t].view(np.int64) for a, t in zip(cut, take[docs])]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + docs, pa.int64()), pa.array(ids[docs]), pa.array(sizes[docs]), pa.array(marks[docs]), pa.array(marks[len(ids) + docs]), prefix, pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32) * PARTS), inner)],
                [x.split()[0] for x in CANDIDATES.split(", ")],
            )

    rows = counts.where("kind < 2").repartition(tasks, "uid").sortWithinPartitions("uid", "kind")
    return mapped(rows, run, CANDIDATES)


def sizes_of(counts: DataFrame) -> DataFrame:
    """doc_id and n_shingles of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(sizes, np.uint32).astype(np.int64))], ["doc_id", "n_shingles"])

    return mapped(counts.where("kind = 0").select("ids", "sizes"), run, "doc_id bigint, n_shingles bigint")


def without_id(documents: DataFrame, n: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in parts:
            for _, texts in texts_of(batch):
                hashes = [np.fromiter(map(cache.__getitem__, words_of(t)), np.uint64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(shingled(h, np.array([len(h)]), n)[0])) for h in hashes], pa.int64())], ["n_shingles"])

    return mapped(documents.where("doc_id is null").select("text"), run, "n_shingles bigint").select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))


def stars(reps: DataFrame) -> DataFrame:
    """(u, nu, v, nv): every node that shares a prefix n-gram with others, with the least of its salt's, and those with the
    least of all; a very common n-gram's nodes are split by salt."""
    postings = reps.select(F.explode("prefix").alias("gram"), F.struct("node", "n").alias("x")).withColumn("salt", F.pmod(F.xxhash64("x.node"), F.lit(SALTS)))
    local = postings.groupBy("gram", "salt").agg(F.min("x").alias("low"), F.count("*").alias("many"))
    top = local.groupBy("gram").agg(F.min("low").alias("least"), F.count("*").alias("salts")).where("salts > 1").select("gram", "least")
    near = postings.join(local.where("many > 1").select("gram", "salt", "low"), ["gram", "salt"]).select("x", F.col("low").alias("y"))
    far = local.select("gram", F.col("low").alias("x")).join(top, "gram").select("x", F.col("least").alias("y"))
    return near.unionByName(far).where("x.node <> y.node").select(F.col("x.node").alias("u"), F.col("x.n").alias("nu"), F.col("y.node").alias("v"), F.col("y.n").alias("nv")).distinct()


def linked(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs that link: the overlap is counted in each fragment apart and summed per pair."""
    cut = reps.select("node", F.posexplode("parts").alias("part", "grams")).where(F.size("grams") > 0)
    pairs = pairs.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    met = pairs.join(cut.select(F.col("node").alias("u"), "part", F.col("grams").alias("mine")), "u").join(cut.select(F.col("node").alias("v"), "part", F.col("grams").alias("theirs")), ["v", "part"])
    partial = met.select("u", "v", "nu", "nv", F.size(F.array_intersect("mine", "theirs")).alias("both"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("both").alias("both"))
    return total.where(f"100 * both >= {percent} * (nu + nv - both)").select("u", "v")


def link_block(nodes: list[int], sets: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, percent: int, cross: int | None, fragments: int = PARTS) -> list[tuple[int, int]]:
    """Links that join what is linked among nodes (each with its shared n-grams, the size of its whole set and a label); with
    cross, only pairs of the first `cross` nodes with the others are compared. A prefix index over the n-grams from rare to
    common proposes; a node's partial overlaps with all it meets are counted fragment by fragment and summed. Nodes of
    one label are not compared."""
    n = len(nodes)
    held_by = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    if not len(flat):
        return []
    known, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, count))] = np.arange(len(known))
    owner = np.repeat(np.arange(n), held_by)
    order = np.lexsort((rank[token], owner))
    token, ends = rank[token][order], np.cumsum(held_by)
    sets = [token[e - s : e] for e, s in zip(ends, held_by)]
    prefix = np.clip(sizes + (-percent * sizes) // 100 + 1 - (sizes - held_by), 0, held_by)  # n-grams not held here come first
    pre_token = np.concatenate([s[:p] for s, p in zip(sets, prefix)])
    pre_owner = np.repeat(np.arange(n), prefix)
    order = np.lexsort((pre_owner, pre_token))
    pre_token, pre_owner = pre_token[order], pre_owner[order]
    # each node's share of each fragment: cut[i, f] <= place in token < cut[i, f + 1]
    edges = np.linspace(0, len(known), fragments + 1).astype(np.int64)
    cut = np.stack([np.searchsorted(s, edges) for s in sets]) + (ends - held_by)[:, None]
    label, held, out = label.copy(), np.zeros(len(known), bool), []
    for i in range(n if cross is None else cross):
        lowest = i + 1 if cross is None else cross
        if not (label[lowest:] != label[i]).any():
            continue
        mine = sets[i][: prefix[i]]
        lo, hi = np.searchsorted(pre_token, mine), np.searchsorted(pre_token, mine, side="right")
        met = np.zeros(n, bool)
        for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1]):
            met[pre_owner[a:b]] = True
        met[:lowest] = False
        found = np.flatnonzero(met & (label != label[i]))
        found = found[100 * np.minimum(sizes[found], sizes[i]) >= percent * np.maximum(sizes[found], sizes[i])]
        if not len(found):
            continue
        held[sets[i]] = True
        need = -(-percent * (sizes[found] + sizes[i]) // (100 + percent))
        total = np.zeros(len(found), np.int64)
        for f in range(fragments):  # partial overlaps, as long as the sum can still reach what is needed
            low, high = cut[found, f], cut[found, f + 1]
            length = high - low
            first = np.cumsum(length) - length
            places = np.repeat(low - first, length) + np.arange(int(length.sum()))
            sums = np.concatenate([[0], np.cumsum(held[token[places]])])
            total += sums[first + length] - sums[first]
            open_ = total + np.minimum(cut[i, -1] - cut[i, f + 1], cut[found, -1] - high) >= need
            found, total, need = found[open_], total[open_], need[open_]
        held[sets[i]] = False
        joined, first = np.unique(label[found], return_index=True)  # one link to each group that is met
        out += [(nodes[i], nodes[int(j)]) for j in found[first]]
        label[np.isin(label, joined)] = label[i]
    return out


def block_links(reps: DataFrame, near: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v): links among the nodes of a family (near: u, component) that have different labels."""
    known = near.select(F.col("u").alias("node"), F.col("component").alias("family")).join(labels.select(F.col("u").alias("node"), F.col("component").alias("label")), "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy("family").agg(F.count("*").alias("members"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("family", "members")
    members = reps.select("node", "n", F.flatten("parts").alias("grams")).join(known.join(sizes, "family"), "node")
    blocks = dealt(members, "node", CHUNK)
    blocks = blocks.withColumn("deal", F.pmod(F.xxhash64("family", "a", "b"), F.lit(max(1, sizes.count() // 8))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        links = []
        for (_, a, b), block in group.sort_values(["chunk", "node"]).groupby(["family", "a", "b"]):
            cross = None if a == b else int((block.chunk == a).sum())
            links += link_block(block.node.tolist(), [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in block.grams], block.n.to_numpy(), block.label.to_numpy(), percent, cross)
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return blocks.groupBy("deal").applyInPandas(run, "u bigint, v bigint")  # some small blocks to a group


def join(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links of 100 * intersection >= percent * union."""
    rows = documents.where("doc_id is not null")
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # about
    fragments = max(1, words // FRAGMENT)
    tasks = min(20_000, fragments // 16 + 1)
    counts = stored(counted(dealt_grams(rows, n, fragments).repartition(tasks, "frag").sortWithinPartitions("frag")), "counts")
    found = stored(candidates(counts, percent, order_of(counts), tasks), "candidates")
    # one representative for each set
    sets = stored(found.groupBy("hi", "lo", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id")), "sets")
    reps = stored(found.join(sets.select("node"), "node", "left_semi").select("node", "n", "prefix", "parts"), "reps")
    pairs = stored(stars(reps), "pairs")
    links = stored(linked(pairs, reps, percent), "links")
    near, labels = components(pairs.select("u", "v")), components(links)
    more = stored(block_links(reps, near, labels, percent), "links")
    named = sets.select("node", "doc_id")
    joined = links.unionByName(more).join(named.select(F.col("node").alias("u"), F.col("doc_id").alias("a")), "u").join(named.select(F.col("node").alias("v"), F.col("doc_id").alias("b")), "v")
    same = found.select("hi", "lo", "n", F.col("doc_id").alias("u")).join(sets.select("hi", "lo", "n", F.col("doc_id").alias("v")), ["hi", "lo", "n"]).where("u <> v")
    classes = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same.select("u", "v")))
    for used in (found, sets, reps, pairs, links, more, near, labels):
        forget(used)
    out = sizes_of(counts).join(classes.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(without_id(documents, n))
