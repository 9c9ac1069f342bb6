"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts of the corpus train a small
network f on the non-negative unbiased risk

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)]),   l = log loss,

so no text needs a trusted 0.  The share pi of positives among the unlabelled
is estimated: with a first network that tells positives from unlabelled texts,
pi is bounded by (share of unlabelled above t) / (share of positives above t)
at every t; the lowest bound, with a confidence margin, is taken.

Inputs are measures of the whole text's form: character classes, word repeats,
words that end in symbols, and the worst window of words, so junk inside a
long clean text shows.  At most ``SAMPLE`` positives and as many unlabelled
texts (smallest hashes of doc_id) train; their measures, not their texts,
reach the driver.  Every text is scored in one map.

Defined results: null and empty text have all measures 0; without positives
every score is 0.5; a null label is unlabelled; a null doc_id counts as held
out; repeated rows are scored each and learnt from once (of several texts of an
id the greatest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bloom_lm import is_held_out
from .factor_machine import one_row_an_id
from .frames import prepared, sent
from .words import _IS_WORD, _places, hash_words, text_pieces

SAMPLE = 15_000
HIDDEN, EPOCHS, RATE = 24, 30, 0.01
WINDOW = 24

_CLASSES = np.zeros((256, 12))
for _i, _set in enumerate([range(65, 91), range(97, 123), range(48, 58), range(128, 256), (32,), (10,), b".,;:'", b"!?", b"|", b"#$%&*=<>{}[]\\^~`_@", b"\"()-/+", (9, 11, 12, 13)]):
    _CLASSES[list(_set), _i] = 1.0
_SYMBOL_END = np.zeros(256, dtype=bool)
_SYMBOL_END[list(b"!|#$%&*=<>{}[]\\^~`_@+")] = True
N_MEASURES = 12 + 14


def word_marks(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word: bytes, whether it ends in a symbol, whether it has capitals only."""
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = word[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return (np.zeros(0),) * 3
    size = np.maximum.reduceat(np.where(word, _places(starts, len(raw)), 0), starts) + 1
    small = np.add.reduceat(((raw >= 97) & (raw <= 122)).astype(np.int32), starts)
    large = np.add.reduceat(((raw >= 65) & (raw <= 90)).astype(np.int32), starts)
    return size.astype(np.float64), _SYMBOL_END[raw[starts + size - 1]].astype(np.float64), ((large > 1) & (small == 0)).astype(np.float64)


def worst(flags: np.ndarray) -> float:
    """The largest share of a flag in WINDOW words in a row (all, if there are fewer)."""
    if len(flags) <= WINDOW:
        return float(flags.mean())
    total = np.cumsum(np.append(0.0, flags))
    return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


def measures(column: pa.Array) -> np.ndarray:
    """A row of N_MEASURES a text."""
    out = []
    for _, offsets, raw in text_pieces(column):
        words, bounds = hash_words(offsets, raw)
        size, symbol, capital = word_marks(offsets, raw)
        for i in range(len(offsets) - 1):
            row = np.zeros(N_MEASURES)
            part, begin, end = raw[offsets[i]:offsets[i + 1]], bounds[i], bounds[i + 1]
            n = end - begin
            if len(part):
                row[:12] = np.bincount(part, minlength=256) @ _CLASSES / len(part)
            if n:
                own = words[begin:end]
                distinct, counts = np.unique(own, return_counts=True)
                again = (own[1:] == own[:-1]).astype(float) if n > 1 else np.zeros(1)
                pairs = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / (n - 1) if n > 1 else 1.0
                row[12:] = (np.log1p(n) / 10, size[begin:end].mean() / 10, min(size[begin:end].max() / 50, 4), len(distinct) / n, counts.max() / n,
                            again.mean(), worst(again), pairs, symbol[begin:end].mean(), worst(symbol[begin:end]),
                            capital[begin:end].mean(), worst(capital[begin:end]), np.log1p(n) / 10 * len(distinct) / n, worst((size[begin:end] <= 2).astype(float)))
            out.append(row)
    return np.array(out).reshape(-1, N_MEASURES)


class Network:
    """One hidden layer, trained by Adam on a risk given as d risk / d output."""

    def __init__(self, rows: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
        self.p = [rng.normal(0, 1 / np.sqrt(rows.shape[1]), (rows.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def forward(self, rows: np.ndarray):
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ self.p[0] + self.p[1])
        return x, h, h @ self.p[2] + self.p[3][0]

    def step(self, x, h, slope) -> None:
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            g = g + 1e-4 * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    @staticmethod
    def slopes(p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
        """d risk / d output from the scores of positives and unlabelled rows; prior None: plain log loss of the one against the other.

        Where the risk of negatives falls below zero it is ascended alone.
        """
        if prior is None:
            return np.concatenate([(p - 1) / len(p), u / len(u)])
        loss = lambda q: -np.log(np.maximum(1 - q, 1e-12))  # noqa: E731  of a 0
        if loss(u).mean() - prior * loss(p).mean() >= 0:
            return np.concatenate([(prior * (p - 1) - prior * p) / len(p), u / len(u)])
        return np.concatenate([prior * p / len(p), -u / len(u)])

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 4) -> "Network":
        rng = np.random.default_rng(seed)
        size = 256
        for _ in range(EPOCHS):
            for _ in range(max(1, max(len(positive), len(unlabelled)) // size)):
                rows = np.concatenate([positive[rng.integers(0, len(positive), size)], unlabelled[rng.integers(0, len(unlabelled), size)]])
                x, h, z = self.forward(rows)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                slope = self.slopes(s[:size], s[size:], prior)
                self.step(x, h, slope)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(rows)[2], -500, 500)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled scores: the lowest upper bound over all thresholds."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    above_p = np.array([(positive >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


class Model:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.network, self.prior = None, 0.5
        if not len(positive) or not len(unlabelled):
            return
        half = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
        rows = np.concatenate([positive, unlabelled])
        if half[0].sum() < len(positive) and half[1].sum() < len(unlabelled):
            first = Network(rows).fit(positive[half[0]], unlabelled[half[1]], None)
            self.prior = estimated_prior(first.score(positive[~half[0]]), first.score(unlabelled[~half[1]]))
        self.network = Network(rows).fit(positive, unlabelled, self.prior)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.full(len(rows), 0.5) if self.network is None else self.network.score(rows)


def measured(rows: DataFrame) -> np.ndarray:
    """Measures of (doc_id, text) rows, in a fixed order."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(measures(batch.column(0))), pa.list_(pa.float64()))], ["m"])

    got = rows.select("text").mapInArrow(run, "m array<double>").toArrow().column("m").to_pylist()
    return np.array(sorted(got)).reshape(-1, N_MEASURES)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, size: int = SAMPLE) -> Model:
    open_ids = F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), parts)

    def some(ids: DataFrame) -> DataFrame:
        return one_row_an_id(docs, ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))

    rng = np.random.default_rng(9)
    positive = measured(some(labels.where(open_ids & (F.col(label) == 1))))
    unlabelled = measured(some(docs.where(open_ids)))
    return Model(positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))])


def quality(docs: DataFrame, fitted: Model, parts: int = 5, threshold: float = 0.3) -> DataFrame:
    model = sent(docs.sparkSession, fitted)

    def run(batches):
        network = model()
        for batch in batches:
            scores = network.score(measures(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), parts).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, size: int = SAMPLE) -> DataFrame:
    prepared(docs.sparkSession)
    return quality(docs, fit_quality(docs, labels, parts=parts, size=size), parts)
