"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling over the
whole text, a logistic output; trained in numpy. Each language has its own threshold, calibrated on rows that the
weights were not fitted to, and scores are stretched so that every threshold lies at the same score.

Training does not start at random alone: the first of the DIM numbers of a word starts at how far the word leans to
label 1 among the fitted rows, and half the filters start by reading that number. From random numbers alone it learns
worse of samples of this size (the README has figures).

The language of a text comes from its own words (votes of words that are common in one language of the sample), never
from a column. Defined results: null and empty texts, and texts without words, have the score of an empty text;
without labelled rows every score is 0. Repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.common import mapped

WORD = re.compile(r"\w+")
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.7


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = got = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        return got


def ids_of(text: str | None, cache: Buckets) -> list[int]:
    return [cache[w] for w in WORD.findall(text.lower())] if text else []


class Model:
    """emb: (BUCKETS, DIM), row 0 for padding; filters: for each width (width, DIM, FILTERS); out: weights of the
    pooled filters; votes: (BUCKETS, languages); cuts: the threshold of each language."""

    def __init__(self, emb, filters, bias, out, out_bias, votes, cuts) -> None:
        self.emb, self.filters, self.bias, self.out, self.out_bias, self.votes, self.cuts = emb, filters, bias, out, out_bias, votes, cuts
        self.tables = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"} | {"tables": None}

    def pooled(self, docs: list[list[int]]) -> np.ndarray:
        """Max over all places of each filter: each word's part in each place of a filter is looked up, then added."""
        if self.tables is None:
            self.tables = [[(self.emb @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]
        most = max(WIDTHS) - 1
        sizes = np.array([len(d) + 2 * most for d in docs])  # padding at the end, so that no filter reaches the next text
        flat = np.zeros(int(sizes.sum()) + most, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        for d, s in zip(docs, starts):
            flat[s : s + len(d)] = d
        n, out = int(sizes.sum()), []
        spans = np.stack([starts, starts + sizes - most], axis=1).ravel()
        for table, b in zip(self.tables, self.bias):
            x = table[0][flat[:n]]
            for j in range(1, len(table)):
                x = x + table[j][flat[j : n + j]]
            out.append(np.maximum.reduceat(x, spans, axis=0)[::2] + b)
        return np.maximum(np.concatenate(out, axis=1), 0)

    def raw(self, docs: list[list[int]]) -> np.ndarray:
        z = (self.pooled(docs).astype(np.float64) * self.out).sum(axis=1)  # row by row: equal texts get equal scores
        return 1 / (1 + np.exp(-np.clip(z + self.out_bias, -30, 30)))

    def language(self, docs: list[list[int]]) -> np.ndarray:
        sizes = np.array([max(1, len(d)) for d in docs])
        flat = np.fromiter((i for d in docs for i in (d or [0])), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.votes[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), axis=0).argmax(axis=1)

    def score(self, docs: list[list[int]]) -> np.ndarray:
        p, cut = self.raw(docs).astype(np.float64), self.cuts[self.language(docs)]
        return np.where(p < cut, THRESHOLD * p / cut, THRESHOLD + (1 - THRESHOLD) * (p - cut) / np.maximum(1 - cut, 1e-9)).clip(0, 1)


def learn(rows: list[tuple[str, int, str]], *, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Model | None:
    """From (text, label, lang). A fifth of the rows, chosen by their text, only calibrates the thresholds."""
    if not rows or len({y for _, y, _ in rows}) < 2:
        return None
    rng, cache = np.random.default_rng(seed), Buckets()
    docs, y = [ids_of(t, cache) for t, _, _ in rows], np.array([r[1] for r in rows], np.float32)
    side = np.array([zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % 5 == 0 for r in rows])
    langs = sorted({r[2] for r in rows})
    # words by the share of each language's documents that hold them; a word votes for a language where it is common
    share = np.zeros((BUCKETS, len(langs)), np.float32)
    held = np.zeros(len(langs))
    for d, (_, _, lang) in zip(docs, rows):
        k = langs.index(lang)
        held[k] += 1
        share[np.unique(d).astype(np.int64), k] += 1
    share /= np.maximum(held, 1)
    votes = np.where(share.max(axis=1, keepdims=True) >= 0.2, share - share.mean(axis=1, keepdims=True), 0).astype(np.float32)
    fit = np.flatnonzero(~side)
    # first dimension: how far a word leans to label 1, shrunk for rare words; the others start at random
    seen = np.zeros((2, BUCKETS), np.float32)
    for i in fit:
        seen[int(y[i]), np.unique(docs[i]).astype(np.int64)] += 1
    base = max(1e-3, float(y[fit].mean()))
    n = seen.sum(axis=0)
    lean = (seen[1] - n * base) / np.sqrt(n * base * (1 - base) + 4)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    emb[:, 0] = np.where(lean > 2.5, lean / 4, 0)
    emb[0] = 0
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 0.7
    m = Model(emb, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(np.log(base / (1 - base))), votes, np.full(len(langs), 0.5))
    for k in range(len(WIDTHS)):
        m.out[k * FILTERS : k * FILTERS + FILTERS // 2] = 0.5
    square: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:  # Adagrad
        acc = square.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        acc[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(acc[at])

    for _ in range(epochs):
        order = rng.permutation(fit)
        order = order[np.argsort([len(docs[i]) // 200 for i in order], kind="stable")]
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in (groups[i] for i in rng.permutation(len(groups))):
            most = max(WIDTHS) - 1
            length = max(len(docs[i]) for i in g) + most
            ids = np.zeros((len(g), length + most), np.int64)
            for r, i in enumerate(g):
                ids[r, : len(docs[i])] = docs[i]
            vec, pools, tops = m.emb[ids], [], []
            for f, b in zip(m.filters, m.bias):
                x = sum(vec[:, j : j + length] @ f[j] for j in range(len(f)))
                top = x.argmax(axis=1)
                tops.append(top)
                pools.append(np.take_along_axis(x, top[:, None], axis=1)[:, 0] + b)
            z = np.concatenate(pools, axis=1)
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
            d = (p - y[g]) / len(g)
            back = (d[:, None] * m.out) * (z > 0)
            step("out", m.out, h.T @ d + 1e-4 * m.out)
            m.out_bias = np.float32(m.out_bias - 0.05 * d.sum())
            for k, (f, top) in enumerate(zip(m.filters, tops)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad_f, rows_at = np.zeros_like(f), np.arange(len(g))[:, None]
                for j in range(len(f)):
                    word = ids[rows_at, top + j]  # (docs, FILTERS)
                    grad_f[j] = np.einsum("bf,bfd->df", part, m.emb[word])
                    touched, where = np.unique(word, return_inverse=True)
                    grad_e = np.zeros((len(touched), DIM), np.float32)
                    np.add.at(grad_e, where.ravel(), (part[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                    step("emb", m.emb, grad_e, touched)
                step(f"f{k}", f, grad_f)
                step(f"b{k}", m.bias[k], part.sum(axis=0))
        m.emb[0] = 0
    m.tables = None
    rest = np.flatnonzero(side)
    if len(rest) and y[rest].any():
        p, own = np.concatenate([m.raw([docs[i] for i in rest[k : k + 64]]) for k in range(0, len(rest), 64)]), m.language([docs[i] for i in rest])
        whole = best_cut(p, y[rest])
        m.cuts = np.array([best_cut(p[own == k], y[rest][own == k]) if y[rest][own == k].sum() >= 8 else whole for k in range(len(langs))])
        # few rows of a language: lean to the threshold of all
        counts = np.array([y[rest][own == k].sum() for k in range(len(langs))])
        m.cuts = (m.cuts * counts + whole * 20) / (counts + 20)
    return m


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of highest F1."""
    order = np.argsort(-p, kind="stable")
    hits, ranks = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    f1 = 2 * hits / (ranks + y.sum())
    at = int(np.argmax(f1))
    low = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order[at]] + low) / 2, 0.02, 0.98))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """Every column of documents, and score double. One pass over the texts, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size
    own = [c for c in documents.columns if c != "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in own), "score double"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, Buckets()
        for batch in parts:
            texts, scores = batch.column(batch.schema.get_field_index("text")), []
            for at in range(0, batch.num_rows, 64):
                docs = [ids_of(t, cache) for t in texts.slice(at, 64).to_pylist()]
                scores.append(model.score(docs) if model is not None else np.zeros(len(docs)))
            if scores:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(np.concatenate(scores).astype(np.float64))], [*own, "score"])

    return mapped(documents.select(*own), run, schema)
