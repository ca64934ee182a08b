"""Language identification, word first: known words score by their per-language log frequency, other words back off
to ever shorter character n-grams.

Defined results: a null text, or one without a letter, is `und` with score 0; equal scores go to the alphabetically
first language; with nothing to learn from, all is `und`. Repeated rows are scored one by one; further columns of the
input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SAMPLE_FILES, bounded_texts, fold, forget, handed_back, hashed_share, mapped, stored

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
CACHE = 150_000


class Model:
    """Rows of per-language log frequencies: of words, and of character n-grams (n = LONGEST_GRAM .. 1)."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], logs: np.ndarray) -> None:
        self.langs, self.words, self.grams, self.logs = langs, words, grams, logs
        self.reset()

    def reset(self) -> None:
        """Forget the words met so far: rows after those of `logs` are theirs."""
        self.seen = dict(self.words)
        self.rows = self.logs if len(self.logs) else np.zeros((0, len(self.langs)), np.float32)
        self.size = len(self.rows)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "words": self.words, "grams": self.grams, "logs": self.logs}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def grams_of(self, word: str) -> list[int]:
        """The rows of the word's known n-grams, of the largest n that has any."""
        padded, known = f" {word} ", self.grams
        for n in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            got = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if got:
                return got
        return []

    def add(self, words: list[str]) -> None:
        """Score unseen words by their n-grams and remember them."""
        parts = [self.grams_of(w) for w in words]
        sizes = np.array([max(1, len(p)) for p in parts])
        flat = np.fromiter((i for p in parts for i in (p or [0])), np.int64, int(sizes.sum()))
        logs = self.logs if len(self.logs) else np.zeros((1, len(self.langs)), np.float32)
        mean = np.add.reduceat(logs[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        mean[[not p for p in parts]] = 0
        while self.size + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(1024, len(self.rows)), len(self.langs)), np.float32)])
        self.rows[self.size : self.size + len(words)] = mean
        self.seen.update(zip(words, range(self.size, self.size + len(words))))
        self.size += len(words)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the winner's share when word scores are averaged."""
        if len(self.seen) > CACHE + len(self.words):
            self.reset()
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        found = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in found]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        has = [i for i, ws in enumerate(found) if ws]
        if not has or not self.langs:
            return names, scores
        new = {w for i in has for w in found[i]}.difference(self.seen)
        if new:
            self.add(list(new))
        sizes = np.array([len(found[i]) for i in has])
        at = np.concatenate([np.fromiter(map(self.seen.__getitem__, found[i]), np.int64, len(found[i])) for i in has])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(self.rows[at].astype(np.float64), starts, axis=0) / sizes[:, None]
        share = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(sizes, 20)[:, None])
        share /= share.sum(axis=1, keepdims=True)
        for k, i in enumerate(has):
            best = int(np.argmax(mean[k]))
            names[i], scores[i] = self.langs[best], share[k, best]
        return names, scores


def learn(pairs: list[tuple[str, str]], least: int = 2) -> Model:
    """From (text, lang). Words seen fewer than `least` times are left to the n-grams."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in pairs:
        words[lang].update(WORD.findall(text.lower()))
    langs = sorted(k for k, c in words.items() if c)

    rows: list[list[float]] = []

    def logs(counts: dict[str, Counter]) -> dict[str, int]:
        total, keys, at = {k: sum(c.values()) for k, c in counts.items()}, Counter(), {}
        for c in counts.values():
            keys.update(c)
        for g, n in sorted(keys.items()):
            if n >= least:  # an absent one counts as half an occurrence, so that no language is ruled out by one word
                at[g] = len(rows)
                rows.append([np.log(max(counts[k][g], 0.5) / total[k]) for k in langs])
        return at

    known, grams = logs({k: words[k] for k in langs}), {}
    for n in range(LONGEST_GRAM, 0, -1):
        counts: dict[str, Counter] = {k: Counter() for k in langs}
        for k in langs:
            for w, times in words[k].items():
                padded = f" {w} "
                for i in range(len(padded) - n + 1):
                    counts[k][padded[i : i + n]] += times
        grams |= logs(counts)
    return Model(langs, known, grams, np.array(rows, np.float32).reshape(len(rows), len(langs)))


def fit(documents: DataFrame, *, folds: int = 5, held: int = 0, most: int = 1500, most_chars: int = 6_000_000, least: int = 50) -> Model:
    """Learn from text and lang of a sample outside the held-out fold, chosen by the hash of the id: about `most` documents
    in proportion, and of each language about `least` at least (all, if it has no more). A text that exceeds what is left
    of `most_chars` characters is skipped; a language of which all are gets the start of its shortest text. Only
    the texts that are learned from reach the driver."""
    known = documents.where("lang is not null and text is not null").where(fold(F.col("doc_id"), folds) != held)
    counts = known.groupBy("lang").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    shares = counts.select("lang", F.least(F.lit(1.0), F.greatest(F.lit(most / max(total, 1)), F.lit(float(least)) / F.col("count"))).alias("_share"))
    rows = known.join(F.broadcast(shares), "lang").where(hashed_share(F.col("doc_id"), 3) < F.col("_share")).select("text", "lang")  # one row a language
    sample = stored(rows.repartition(SAMPLE_FILES), "sample")
    taken = [(r.text, r.lang) for r in bounded_texts(sample, most_chars)]
    met = {lang for _, lang in taken}
    start = F.left("text", F.lit(max(1000, most_chars // 100)))
    short = sample.where(~F.col("lang").isin(sorted(met))) if met else sample
    taken += [(r.m["text"], r.lang) for r in short.groupBy("lang").agg(F.min(F.struct(F.char_length("text").alias("size"), start.alias("text"))).alias("m")).collect()]
    forget(sample)
    model = learn(sorted(taken, key=lambda r: (hash_of(r[0]), r)))
    handed_back()  # counts of all n-grams, of which few are kept
    return model


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Every column of documents, and lang_pred and score. One pass over the texts, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    own = [c for c in documents.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in own), "lang_pred string, score double"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in parts:
            texts = batch.column(batch.schema.get_field_index("text"))
            names, scores = [], []
            for at in range(0, batch.num_rows, 256):
                a, b = model.score(texts.slice(at, 256).to_pylist())
                names += a
                scores.append(b)
            if names:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [*own, "lang_pred", "score"])

    return mapped(documents, run, schema)
