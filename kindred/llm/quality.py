"""Quality by Bradley-Terry pairwise ranking: a document's score is linear in features of its text, learned from
preference pairs by logistic loss on feature differences; a quantile of the scores of the training rows is the
threshold. The pairs are all of a row of label 1 and one of label 0, of every labelled row: sums by bins of the score stand for
them, so each step is a pass over the rows and none over the pairs.

Defined results: null and empty texts, and texts without words, are scored as empty texts; without labels of both kinds
every score is 1 (nothing is rejected). Repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import fold, forget, mapped, stored

THRESHOLD = 0.3
#: ASCII symbols that prose has few of
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
FEATURES = 15
#: the column of a text's features
HELD = "_features"
#: features are added up as integers of 1 / UNIT (their products of 1 / OUTER**2): sums are exact, in whatever order
UNIT, OUTER = 1 << 16, 1 << 8
#: fine bins of the strength to a unit; those beyond REACH fall into the outermost
FINE, REACH = 32, 32
STEPS = 25


def features(text: str | None) -> list[float]:
    """Shares and logarithms of the whole text: of kinds of characters, lengths, repeats and line ends. None is a test for one
    symbol or a threshold set by hand; those were measured and add nothing."""
    # Spark puts U+FFFD where Python's encoder has "?" for a lone surrogate: a text is the same in memory and from a table
    raw = (text or "").replace("\ufffd", "?").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * FEATURES
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    upper, lower, digit, beyond = bins[65:91].sum(), bins[97:123].sum(), bins[48:58].sum(), bins[128:].sum()
    lines = text.split("\n")
    log = np.log1p
    return [
        float(x)
        for x in (
            upper / max(1, upper + lower + beyond / 2), digit / size, bins[list(SYMBOLS)].sum() / size, (bins[44] + bins[46]) / n, bins[46] / n, beyond / size,
            log(n), size / n / 10, len(set(words)) / n, 1 - len(set(lines)) / len(lines), log(n / len(lines)), bins[32] / n, bins[63] / n,
            sum(1 for w in lines if w[-1:] in ".!?") / len(lines), min(1.0, 20 / n),
        )
    ]


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float) -> None:
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(axis=1)  # row by row: equal texts get equal scores

    def score(self, x: np.ndarray) -> np.ndarray:
        """THRESHOLD exactly at the cut, rising with the strength."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def tally(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What training needs to know of these rows (x in units of 1 / UNIT): rows of key, number, count and sums of integers. Number -1:
    of the strengths' fine bins by label, the count and the sum of x; 0 and on: of wide bins, a row of the sum of x's outer product."""
    made, floor = [], np.floor((x / UNIT * weights).sum(axis=1) * FINE)
    for at in range(0, len(x), 4096):
        q, fine = x[at : at + 4096], np.clip(floor[at : at + 4096], -REACH * FINE, REACH * FINE - 1).astype(np.int64)
        coarse = np.rint(q / (UNIT // OUTER)).astype(np.int64)
        for number, bins, values in ((-1, fine, np.column_stack([np.ones(len(q), np.int64), q])), (0, fine // FINE, coarse[:, :, None] * coarse[:, None, :])):
            key = bins * 2 + y[at : at + 4096]
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            sums = np.add.reduceat(values[order], starts, axis=0)
            if number < 0:
                made.append(np.column_stack([keys, np.full(len(keys), -1), sums]))
            else:
                made += [np.column_stack([keys, np.full(len(keys), i), np.zeros(len(keys), np.int64), sums[:, i]]) for i in range(x.shape[1])]
    return np.concatenate(made) if made else np.zeros((0, x.shape[1] + 3), np.int64)


class Pairs:
    """Mean logistic loss over all pairs of a good and a bad row, with a little decay: every row counts, with the strength of the
    mean of its fine bin. Its gradient, its curvature, and the fine bins of either label."""

    def __init__(self, rows: np.ndarray, w: np.ndarray) -> None:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        bins, self.w, decay = rows[rows[:, 1] < 0], w, 1e-3
        self.keys, self.counts = bins[:, 0], bins[:, 2].astype(float)
        sums = bins[:, 3:] / UNIT
        means, good, bad = sums / self.counts[:, None], np.flatnonzero(self.keys & 1), np.flatnonzero(1 - (self.keys & 1))
        s, n, m = means @ w, self.counts[good].sum(), self.counts[bad].sum()
        self.loss, pull, push, cross = decay / 2 * (w @ w), np.zeros(len(bins)), np.zeros(len(bins)), np.zeros((len(w), len(w)))
        for at in range(0, len(good), 256):  # blocks of bins against bins, of bounded size
            some = good[at : at + 256]
            gap = np.clip(s[some][:, None] - s[bad][None], -30, 30)
            wrong = 1 / (1 + np.exp(gap))
            self.loss += (self.counts[some] @ np.log1p(np.exp(-gap)) @ self.counts[bad]) / (n * m)
            pull[some], steep = -wrong @ self.counts[bad] / (n * m), wrong * (1 - wrong) / (n * m)
            pull[bad] += self.counts[some] @ wrong / (n * m)
            push[some] = steep @ self.counts[bad]
            push[bad] += self.counts[some] @ steep
            cross += sums[some].T @ steep @ sums[bad]
        self.gradient = pull @ sums + decay * w
        self.curve = (sums * (push / self.counts)[:, None]).T @ sums - cross - cross.T + decay * np.eye(len(w))
        outer = rows[rows[:, 1] >= 0]
        wide = (self.keys >> 1) // FINE * 2 + (self.keys & 1)
        for key in np.unique(wide):  # and what rows differ from the means of their bins, by wide bins
            own = wide == key
            within = outer[outer[:, 0] == key][:, 3:] / OUTER**2 - (sums[own] / self.counts[own][:, None]).T @ sums[own]
            self.curve += (push[own] @ self.counts[own]) / self.counts[own].sum() * within

    def cut(self) -> float:
        """The quantile of the strengths, at a border of fine bins, that best parts the labels, both kinds weighing the same."""
        at = np.unique(self.keys >> 1)
        good, bad = (np.array([self.counts[(self.keys >> 1 == b) & ((self.keys & 1) == k)].sum() for b in at]).cumsum() for k in (1, 0))
        levels = np.searchsorted((good + bad) / (good + bad)[-1], np.linspace(0.005, 0.9, 180) - 1e-12).clip(max=max(0, len(at) - 2))
        balance = 1 - good[levels] / good[-1] + bad[levels] / bad[-1]
        best = np.flatnonzero(balance >= balance.max() - 0.004)
        k = levels[best[len(best) // 2]]
        return float(at[k] + 1 + at[min(k + 1, len(at) - 1)]) / 2 / FINE


def trained(mean: np.ndarray, scale: np.ndarray, tallied: Callable[[np.ndarray], np.ndarray], steps: int) -> Model:
    """Newton's method from zero, halving steps that don't lower the loss."""
    now, size = Pairs(tallied(np.zeros(FEATURES)), np.zeros(FEATURES)), 1.0
    step = np.linalg.solve(now.curve, -now.gradient)
    for _ in range(steps):
        w = now.w + size * step
        new = Pairs(tallied(w), w)
        if new.loss > now.loss + 1e-6:
            size /= 2
            continue
        done, now, size = now.loss - new.loss < 1e-6, new, min(1.0, 2 * size)
        step = np.linalg.solve(now.curve, -now.gradient)
        if done:
            break
    return Model(mean, scale, now.w, now.cut(), 1.0)


def standards(mean: list[float], spread: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale, to nine digits: the order in which rows were added up doesn't matter."""
    return np.array([float(f"{v:.9g}") for v in mean]), np.array([max(float(f"{v:.9g}"), 1e-3) for v in spread])


def learn(rows: list[tuple[str, int, str]], *, steps: int = STEPS) -> Model | None:
    """As fit(), from (text, label, lang) in memory, lang unused."""
    y = np.array([int(r[1] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([features(r[0]) for r in rows])
    mean, scale = standards(x.mean(axis=0).tolist(), x.std(axis=0).tolist())
    z = np.rint((x - mean) / scale * UNIT).astype(np.int64)
    return trained(mean, scale, lambda w: tally(z, y, w), steps)


def featured(documents: DataFrame) -> DataFrame:
    """Every column of documents but text, and what score() and fit() need of the text."""
    own = [c for c in documents.columns if c not in ("text", HELD)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in own), f"{HELD} array<double>"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = [features(t) for at in range(0, batch.num_rows, 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(x, pa.list_(pa.float64()))], [*own, HELD])

    return mapped(documents.select(*own, "text"), run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, *, steps: int = STEPS) -> Model | None:
    """Learned from every labelled row of featured() documents whose remainder is not `held`. Null labels and ids are left out; an
    id with several labels takes their rounded mean. Each step is one pass over the stored features, of which sums by bins,
    bounded in number, reach the driver."""
    own = labels.select("doc_id", F.col(label).alias("_y")).where("_y is not null and doc_id is not null").where(fold(F.col("doc_id"), folds) != held)
    own = own.groupBy("doc_id").agg(F.round(F.avg("_y")).cast("int").alias("_y"))
    rows = stored(documents.select("doc_id", HELD).join(own, "doc_id").select((F.col("_y") > 0).cast("bigint").alias("y"), HELD), "learned")
    at = [F.get(HELD, F.lit(i)) for i in range(FEATURES)]
    found = rows.agg(F.min("y"), F.max("y"), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    if found[0] is None or found[0] == found[1]:
        forget(rows)
        return None
    mean, scale = standards(found[2 : 2 + FEATURES], found[2 + FEATURES :])
    names = ["key", "number", "n", *(f"s{i}" for i in range(FEATURES))]

    def tallied(w: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                made = tally(np.rint((matrix(batch.column(1)) - mean) / scale * UNIT).astype(np.int64), batch.column(0).to_numpy(), w)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made.T.copy()], names)

        sums = mapped(rows, run, ", ".join(f"{c} bigint" for c in names)).groupBy("key", "number").agg(*(F.sum(c).alias(c) for c in names[2:]))
        return np.column_stack([c.to_numpy() for c in sums.toArrow().columns])

    model = trained(mean, scale, tallied, steps)
    forget(rows)
    return model


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """Every column of documents (or of what featured() made of them, but its own), and score double. One pass, no shuffle."""
    source = HELD if HELD in documents.columns and "text" not in documents.columns else "text"
    own = [c for c in documents.columns if c not in ("score", HELD)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in own), "score double"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column, scores = batch.column(batch.schema.get_field_index(source)), []
            for at in range(0, batch.num_rows, 256):
                some = column.slice(at, 256)
                x = matrix(some) if source == HELD else np.array([features(t) for t in some.to_pylist()])
                scores.append(model.score(x) if model is not None else np.ones(len(x)))
            if scores:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(np.concatenate(scores))], [*own, "score"])

    return mapped(documents.select(*own, *([HELD] if source == HELD else [])), run, schema)
