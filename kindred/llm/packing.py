"""Packing token sequences by cutting-stock column generation.

1. Each document is tokenized once; whole sequences of `capacity` tokens are cut off, the rest is an item.
2. Items are counted in classes of `capacity / UNITS` tokens. A linear program over packing patterns is solved by column
   generation (a knapsack dynamic program prices columns); pattern counts are rounded down, what remains is packed first
   fit decreasing. Only the histogram reaches the driver.
3. Items are ranked within their class; rank decides pattern, sequence and slot.
4. Slack (items shorter than their class, and of patterns) is filled from filler items, cut where needed: the items of
   so few of 100 hash buckets as hold enough tokens. Fillers left over are chopped into whole sequences, the last
   tokens into sequences of powers of two. So only what the rule exempts goes without padding, and padding is none.

Defined results: a null or empty text is the end id alone. Every row is a document of its own, also with a repeated or
null id. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import HELD, mapped, stored

UNITS = 64
BUCKETS = 100
PART_ROWS = 8192
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


#: the rules of a tokenizer whose words can be told apart by white space and tokenized one by one (fixed values)
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


def splits_words(path: str) -> bool:
    """Whether a tokenizer drops white space, never joins across it, and ends every word by tokens of their own."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    parts, model = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [], rules["model"]
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    return (
        rules.get("normalizer") == NORMALIZER and len(parts) == 2 and parts[0] == split and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout") and not model.get("ignore_merges")
        and not any(rules.get(x) for x in ("truncation", "padding", "post_processor"))
    )


def folded(texts: pa.Array) -> pa.Array:
    """In lower case where that can't change an id: the tokenizer lower-cases too, and one case makes entries fewer. In
    Latin-1 every letter has one lower-case letter there and no text has another normal form."""
    return pc.if_else(pc.match_substring_regex(texts, "[^\\x00-\\x{ff}]"), texts, pc.utf8_lower(texts))


#: punctuation that ends a word, behind a letter or number: always a token part of its own
ENDING = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+(?:\s|\z))"


class Encoder:
    """Token ids, for a tokenizer that splits_words() word by word through a bounded cache, for any other text by text.

    Texts are split and their words numbered by Arrow kernels; each word met has its ids in one array, from which the ids
    of whole texts are gathered."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.by_word = Tokenizer.from_file(path), most, splits_words(path)
        self.stop = self.tokenizer.token_to_id("<|endoftext|>")
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.reset()

    def reset(self) -> None:
        """Forget the words met so far: word -> its number; a number's ids are pool[start : start + size]."""
        self.known: dict[str, int] = {"": 0}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def take(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words))))

    def learn(self, words: list[str]) -> None:
        """Tokenize unseen words together. Words of letters alone are one part each, whose last id ends a word; a special
        token stands between the others."""
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), 2000):
            some = letters[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and len(ids) and ends[-1] == len(ids) - 1:
                self.take(some, ids, np.diff(ends, prepend=-1))
            else:  # some letter's lower case holds a mark
                self.apart(some)
        self.apart([w for w in words if not w.isalpha()])

    def apart(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            if self.stop is None:
                every = [self.whole(w) for w in some]
                self.take(some, np.concatenate(every), np.array([len(x) for x in every]))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast(["<|endoftext|>".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.stop), [len(ids)]])
            self.take(some, ids[ids != self.stop], np.diff(cuts) - 1)

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and how many there are before each."""
        sizes = self.size[numbers]
        before = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.start[numbers] - before, sizes) + np.arange(int(sizes.sum()))], before

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number, unseen words taken in. Words differ from each other."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0).tolist()
        if len(self.known) + len(new) > self.most:
            self.reset()
            found[:], new = 0, [k for k, w in enumerate(words) if w]
        if new:
            self.learn([words[k] for k in new])
            found[new] = np.fromiter((self.known[words[k]] for k in new), np.int64, len(new))
        return found

    def encode(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, `end` after each, and where each text begins (and the last one ends)."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool) if self.by_word else np.ones(len(texts), bool)
        for x in ODD if self.by_word else ():
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(folded(pc.if_else(pa.array(odd), "", texts)), ENDING, r"\1 \2"))
        words = lists.flatten().dictionary_encode()
        numbers = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        ids, before = self.gathered(numbers)
        places = np.append(before, len(ids))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        rest = [(k, self.whole(texts[int(k)].as_py())) for k in np.flatnonzero(odd)]
        sizes = np.diff(places)
        for k, own in rest:
            sizes[k] = len(own)
        starts = np.concatenate([[0], np.cumsum(sizes + len(end))])
        out = np.empty(int(starts[-1]), self.kind)
        ends = np.zeros(len(out), bool)
        for j in range(len(end)):
            out[starts[1:] - len(end) + j] = end[j]
            ends[starts[1:] - len(end) + j] = True
        for k, own in rest:
            out[starts[k] : starts[k] + len(own)] = own
            ends[starts[k] : starts[k] + len(own)] = True
        out[~ends] = ids
        return out, starts


def encoder(path: str) -> Encoder:
    """The worker's own, kept while it packs."""
    name = f"encoder {path}"
    if name not in HELD:
        HELD[name] = Encoder(path)
    return HELD[name]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(documents: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, n (tokens), crcs (of whole sequences, then of the rest), ids (raw), wide (4 bytes an id, or 2)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind)
        for batch in parts:
            for at in range(0, batch.num_rows, 2000):
                ids, starts = enc.encode(batch.column(1).slice(at, 2000), end)
                n, wide = np.diff(starts), ids.astype("<u4")
                crcs = [[zlib.crc32(wide[k : min(k + capacity, b)]) for k in range(a, b, capacity)] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((starts * enc.kind.itemsize).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), raw, pa.array(np.full(len(n), enc.kind.itemsize == 4))], ["doc_id", "n", "crcs", "ids", "wide"])

    return mapped(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, n bigint, crcs array<bigint>, ids binary, wide boolean", f"encoder {tokenizer}")


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest worth: how often each size, within the capacity."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth[room], last[room] = worth[room - 1], -1
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gain = worth[room - sizes[fits]] + prices[fits]
            if gain.max() > worth[room] + 1e-12:
                worth[room], last[room] = gain.max(), fits[gain.argmax()]
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return float(worth[capacity]), counts


def patterns(demand: dict[int, int], capacity: int = UNITS, steps: int = 3000) -> list[tuple[dict[int, int], int]]:
    """(how often each size, how many sequences) that hold the whole demand. Linear program by column generation,
    rounded down; the rest first fit decreasing."""
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0))
    if not len(sizes):
        return []
    d = np.array([demand[s] for s in sizes], float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(steps):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(axis=0)  # every column costs 1
        value, column = knapsack(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        x, move = inverse @ d, inverse @ column
        up = np.flatnonzero(move > 1e-9)
        basis[:, up[np.argmin(x[up] / move[up])]] = column
    x = np.floor(np.linalg.solve(basis, d) + 1e-9).clip(0).astype(int)
    out, left = [], d.astype(int).copy()
    for k in np.argsort(-x):
        col = basis[:, k].round().astype(int)
        times = int(min(x[k], min(left[c] // col[c] for c in np.flatnonzero(col))))
        if times > 0:
            out.append(({int(sizes[c]): int(col[c]) for c in np.flatnonzero(col)}, times))
            left -= times * col
    bins: list[list] = []  # [room, Counter]
    for k in range(len(sizes) - 1, -1, -1):
        s, more = int(sizes[k]), int(left[k])
        for b in bins:
            fit = min(more, b[0] // s)
            if fit:
                b[1][s] = b[1].get(s, 0) + fit
                b[0], more = b[0] - fit * s, more - fit
        while more > 0:
            fit = min(more, capacity // s)
            bins.append([capacity - fit * s, {s: fit}])
            more -= fit
    return out + [(b[1], 1) for b in bins]


def running(df: DataFrame, value: Column, key: str, name: str, total: int, within: list[str] | None = None) -> DataFrame:
    """df with `name`: the sum of value over the rows before, in a fixed order (within equal columns `within`). Two levels,
    so that no task sees more than about PART_ROWS rows, nor one row for each part."""
    within = within or []
    parts = max(1, -(-total // PART_ROWS))
    rows = df.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(parts))).withColumn("_v", value)
    sums = rows.groupBy(*within, "_part").agg(F.sum("_v").alias("_sum"))
    before = sums.select(*within, "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy(*within, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, [*within, "_part"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_v", "_own", "_before")


def pack(documents: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark, step = documents.sparkSession, capacity // UNITS
    docs = tokenized(documents, tokenizer, end_id, capacity).withColumn("uid", F.monotonically_increasing_id())  # settled by writing
    docs = stored(docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n"), F.lit(BUCKETS)).cast("int")), "tokens")
    slim = docs.select("uid", "doc_id", "n", "bucket", "crcs", F.floor(F.col("n") / capacity).cast("bigint").alias("whole"), (F.col("n") % capacity).alias("rest"))
    slim = slim.withColumn("cls", F.ceil(F.col("rest") / step).cast("int"))
    counts = slim.groupBy("bucket", "cls").agg(F.count("*").alias("docs"), F.sum("rest").alias("tokens"), F.sum("whole").alias("whole")).toPandas()  # BUCKETS * (UNITS + 1) rows at most
    total, wholes = int(counts.docs.sum()), int(counts.whole.sum())
    for fillers in (3, 5, 8, 12, 18, 27, 40, 60, BUCKETS):
        main = counts[(counts.bucket >= fillers) & (counts.cls > 0)]
        plan = patterns(main.groupby("cls").docs.sum().astype(int).to_dict(), UNITS)
        slack = capacity * sum(times for _, times in plan) - int(main.tokens.sum())
        stream = int(counts[counts.bucket < fillers].tokens.sum())
        if stream >= slack:
            break
    bins = sum(times for _, times in plan)

    # whole sequences come first
    runs = running(slim.where("whole > 0"), F.col("whole"), "uid", "first", total)
    whole = runs.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
    out = whole.select("doc_id", (F.col("j") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"), F.get("crcs", F.col("j").cast("int")).alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("j")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    last = F.get("crcs", F.col("whole").cast("int"))

    # items to patterns by rank within their class
    slots, base, so_far = [], wholes, {}
    for pattern, times in plan:
        for s, a in pattern.items():
            slots.append((s, so_far.get(s, 0), a, times, base))
            so_far[s] = so_far.get(s, 0) + a * times
        base += times
    used = None
    if slots:
        table = spark.createDataFrame(slots, "cls int, low bigint, a bigint, times bigint, base bigint")  # a few hundred rows
        items = running(slim.where(F.col("bucket") >= fillers).where("rest > 0"), F.lit(1), "uid", "rank", total, ["cls"])
        items = items.join(F.broadcast(table), "cls").where("rank >= low and rank < low + a * times").withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("a")).cast("bigint"))
        mates = Window.partitionBy("sequence_id")
        items = items.withColumn("filled", F.sum("rest").over(mates)).withColumn("offset", F.coalesce(F.sum("rest").over(mates.orderBy(F.desc("rest"), "uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        items = stored(items.select("doc_id", (F.col("whole") * capacity).alias("start"), F.col("rest").alias("length"), last.alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset", "filled"), "items")
        out = out.unionByName(items.drop("filled"))
        used = items.where(f"offset = 0 and filled < {capacity}").select("sequence_id", F.col("filled").alias("at"), (F.lit(capacity) - F.col("filled")).alias("room"))
    if stream:
        room = [running(used, F.col("room"), "sequence_id", "low", bins)] if used is not None and slack else []
        rest, chopped = stream - slack, (stream - slack) // capacity
        extra = spark.range(chopped).select((F.col("id") + wholes + bins).alias("sequence_id"), F.lit(0).cast("bigint").alias("at"), F.lit(capacity).cast("bigint").alias("room"), (F.col("id") * capacity + slack).alias("low"))
        tail, low = [], slack + chopped * capacity
        for power in (1 << b for b in range(rest.bit_length(), -1, -1)):
            if (rest - chopped * capacity) & power and power < capacity:
                tail.append((wholes + bins + chopped + len(tail), 0, power, low))
                low += power
        for more in [extra, *([spark.createDataFrame(tail, "sequence_id bigint, at bigint, room bigint, low bigint")] if tail else [])]:
            room.append(more)
        rooms = room[0].select("sequence_id", "at", "room", "low")
        for more in room[1:]:
            rooms = rooms.unionByName(more.select("sequence_id", "at", "room", "low"))
        flow = running(slim.where(F.col("bucket") < fillers).where("rest > 0"), F.col("rest"), "uid", "from", total)
        cell = 4 * capacity
        cells = lambda lo, size: F.explode(F.sequence(F.floor(lo / cell), F.floor((lo + size - 1) / cell)))
        flow, rooms = flow.withColumn("cell", cells(F.col("from"), F.col("rest"))), rooms.withColumn("cell", cells(F.col("low"), F.col("room")))
        cut = flow.join(rooms, "cell").withColumn("lo", F.greatest("from", "low")).withColumn("hi", F.least(F.col("from") + F.col("rest"), F.col("low") + F.col("room"))).where(f"lo < hi and floor(lo / {cell}) = cell")
        cut = cut.select("uid", (F.col("whole") * capacity + F.col("lo") - F.col("from")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), "sequence_id", (F.col("at") + F.col("lo") - F.col("low")).alias("offset"))
        pieces = docs.where(F.col("bucket") < fillers).select("uid", "doc_id", F.col("n").alias("doc_tokens"), "ids", "wide").join(cut, "uid")
        pieces = pieces.withColumn("own", F.substring("ids", F.col("start").cast("int") * F.when(F.col("wide"), 4).otherwise(2) + 1, F.col("length").cast("int") * F.when(F.col("wide"), 4).otherwise(2)))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                got = [crc(np.frombuffer(x, "<u4" if w else "<u2")) for x, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(got, pa.int64()), *batch.columns[5:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        filled = mapped(pieces.select("doc_id", "own", "wide", "start", "length", "doc_tokens", "sequence_id", "offset"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
        out = out.unionByName(filled)
    return out
