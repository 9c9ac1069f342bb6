"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 for
every hashed term or term prefix in the text.  The pair term is what a linear
model lacks: an insult next to the mention of a group may count for more than
both apart.

With every term in, pairs of chance words outweigh everything in long texts, so
terms are chosen: those whose share of the texts differs between the labels by
more than ``MIN_Z`` standard errors, in ``MIN_DOCS`` training texts or more, and
those that do not differ alone but together with another term: the shares of
texts that hold both differ by more than ``PAIR_Z`` standard errors and half as
much again as either term's.  Pairs are looked at among the ``PAIR_TERMS`` most
frequent terms of the sample.

Learnt from at most ``SAMPLE`` labelled texts (the smallest hashes of doc_id,
so a rerun takes the same), one row an id, whose hashed terms are all that
reaches the driver; every whole text is scored in one map.  The model holds a
weight and factors for the chosen buckets alone.

Defined results: null and empty text score the model's bias; no labelled rows
give 0 everywhere; a null label is unlabelled; a null doc_id counts as held
out; repeated rows are scored each and learnt from once (of several texts or
labels of an id the greatest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bloom_lm import is_held_out
from .frames import prepared, sent
from .words import hash_terms, text_pieces

BUCKET_BITS, FACTORS = 18, 8
PREFIXES = (4, 5)
SAMPLE = 20_000
MIN_DOCS, MIN_Z = 4, 4.5
PAIR_TERMS, PAIR_Z = 2048, 7.0
EPOCHS, STEPS, RATE, DECAY = 8, 500, 0.15, 1e-2


def buckets(column: pa.Array):
    """Yield the distinct buckets of each text."""
    for _, offsets, raw in text_pieces(column):
        kinds, bounds = hash_terms(offsets, raw, PREFIXES)
        shift = np.uint64(64 - BUCKET_BITS)
        kinds = [(k >> shift).astype(np.int32) for k in kinds]
        for i in range(len(bounds) - 1):
            yield np.unique(np.concatenate([k[bounds[i]:bounds[i + 1]] for k in kinds]))


def one_row_an_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen ids with their text, once each; repeated rows are reduced where they are read."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.max("text").alias("text"))


def sampled(docs: DataFrame, labels: DataFrame, label: str, parts: int, size: int) -> DataFrame:
    """(doc_id, label, text) of at most ``size`` labelled ids that are not held out."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), parts))
    chosen = usable.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return one_row_an_id(docs, chosen)


def standard_errors(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far shares ones / n1 and zeros / n0 lie apart, in standard errors."""
    mean = (ones + zeros) / (n1 + n0)
    return (ones / n1 - zeros / n0) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n1 + 1 / n0))


def paired_terms(rows: list[np.ndarray], toxic: np.ndarray, terms: np.ndarray, alone: np.ndarray, n1: int, n0: int, least: float = PAIR_Z) -> np.ndarray:
    """Of ``terms`` those that tell the labels apart together with another one; ``alone``: their own standard errors."""
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    met = [np.zeros((len(terms), len(terms)), np.float32) for _ in range(2)]
    for which in (0, 1):
        mine = np.flatnonzero(toxic == which)
        for begin in range(0, len(mine), 1000):
            some = mine[begin:begin + 1000]
            held = np.zeros((len(some), len(terms)), np.float32)
            for i, k in enumerate(some):
                at = place[rows[k]]
                held[i, at[at >= 0]] = 1
            met[which] += held.T @ held
    found = np.zeros(len(terms), bool)
    for begin in range(0, len(terms), 256):
        part = slice(begin, begin + 256)
        z = np.abs(standard_errors(met[1][part], met[0][part], n1, n0))
        z[np.arange(len(z)), np.arange(begin, begin + len(z))] = 0
        found[part] = (z > np.maximum(least, 1.5 * np.maximum(np.abs(alone[part, None]), np.abs(alone[None])))).any(axis=1)
    return terms[found]


class Machine:
    """Weights by mini-batch AdaGrad on log loss.  ``slot`` gives a bucket's place in weights and factors, -1 for one not chosen."""

    def __init__(self):
        self.bias, self.slot = 0.0, np.full(1 << BUCKET_BITS, -1, np.int32)
        self.linear, self.factors = np.zeros(0), np.zeros((0, FACTORS))

    def margin(self, at: np.ndarray) -> float:
        at = self.slot[at]
        at = at[at >= 0]
        v = self.factors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[at].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def choose(self, rows: list[np.ndarray], label: np.ndarray, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, seed: int = 5) -> None:
        """Choose the buckets and start their factors."""
        held = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for r, y in zip(rows, label):
            held[int(y == 1), r] += 1  # buckets of a row are distinct
        n1, n0 = max(int((label == 1).sum()), 1), max(int((label != 1).sum()), 1)
        z, texts = standard_errors(held[1], held[0], n1, n0), held.sum(axis=0)
        used = (texts >= min_docs) & (np.abs(z) > min_z)
        often = np.argsort(-texts, kind="stable")[:PAIR_TERMS]
        often = often[texts[often] >= min_docs]
        used[paired_terms(rows, label == 1, often, z[often], n1, n0)] = True
        at = np.flatnonzero(used)
        self.slot[at] = np.arange(len(at))
        self.linear, self.factors = np.zeros(len(at)), np.random.default_rng(seed).normal(0, 0.02, (len(at), FACTORS))

    def gradients(self, at: np.ndarray, sizes: np.ndarray, label: np.ndarray):
        """Of a batch (places of all texts in a row, how many a text): distinct places, slopes of the log loss by weight, factor and bias."""
        cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        v = self.factors[at]
        total = np.add.reduceat(v, cuts)
        z = self.bias + np.add.reduceat(self.linear[at], cuts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), cuts))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        each = np.repeat(error, sizes)
        keys, back = np.unique(at, return_inverse=True)
        pull = each[:, None] * (np.repeat(total, sizes, axis=0) - v)
        return keys, np.bincount(back, each), np.stack([np.bincount(back, pull[:, f]) for f in range(FACTORS)], axis=1), error.sum()

    def fit(self, rows: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, seed: int = 11) -> "Machine":
        if not len(rows):
            self.bias = -50.0
            return self
        share = min(max(label.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        self.choose(rows, label, min_docs, min_z)
        rows = [at[at >= 0] for at in (self.slot[r] for r in rows)]
        rng = np.random.default_rng(seed)
        sums = (np.full(self.linear.shape, 1e-2), np.full(self.factors.shape, 1e-2))
        bias_sum = 1.0
        # small samples are gone through more often, so that factors have left their small start
        for _ in range(max(epochs, -(-STEPS * 128 // len(rows)))):
            order = rng.permutation(len(rows))
            for begin in range(0, len(order), 128):
                batch = [i for i in order[begin:begin + 128] if len(rows[i])]
                without = [i for i in order[begin:begin + 128] if not len(rows[i])]  # texts with no chosen term tell of the bias
                by_rest = (1 / (1 + np.exp(-self.bias)) - label[without]).sum()
                if not batch:
                    bias_sum += by_rest ** 2
                    self.bias -= RATE * by_rest / np.sqrt(bias_sum)
                    continue
                keys, by_weight, by_factor, by_bias = self.gradients(np.concatenate([rows[i] for i in batch]), np.array([len(rows[i]) for i in batch]), label[batch])
                step, turn = by_weight + DECAY * self.linear[keys], by_factor + DECAY * self.factors[keys]
                sums[0][keys] += step * step
                self.linear[keys] -= RATE * step / np.sqrt(sums[0][keys])
                sums[1][keys] += turn * turn
                self.factors[keys] -= 0.3 * RATE * turn / np.sqrt(sums[1][keys])
                by_bias += by_rest
                bias_sum += by_bias ** 2
                self.bias -= RATE * by_bias / np.sqrt(bias_sum)
        return self


def fit_machine(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, size: int = SAMPLE) -> Machine:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b in buckets(batch.column(2))], pa.list_(pa.int32())), batch.column(1)], ["doc_id", "at", "label"])

    rows = sampled(docs, labels.withColumn(label, F.col(label).cast("double")), label, parts, size)
    rows = rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, at array<int>, label double").toArrow()
    if not rows.num_rows:
        return Machine().fit([], np.zeros(0))
    # buckets stay in Arrow's buffers; the order of rows from Spark is not fixed, that of ids is
    found = []
    for chunk in rows.column("at").chunks:
        flat, cuts = chunk.flatten().to_numpy(), chunk.offsets.to_numpy()
        found += [flat[a:b] for a, b in zip(cuts - cuts[0], cuts[1:] - cuts[0])]
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    return Machine().fit([found[i] for i in order], rows.column("label").to_numpy()[order])


def toxicity(docs: DataFrame, machine: Machine, parts: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    model = sent(docs.sparkSession, machine)

    def run(batches):
        machine = model()
        for batch in batches:
            z = np.array([machine.margin(at) for at in buckets(batch.column(2))])
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), parts).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, in one map."""
    model = sent(docs.sparkSession, machine)
    at, limit = docs.columns.index("text"), np.log(threshold / (1 - threshold))

    def run(batches):
        machine = model()
        for batch in batches:
            yield batch.filter(pa.array([machine.margin(found) < limit for found in buckets(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, size: int = SAMPLE) -> DataFrame:
    prepared(docs.sparkSession)
    return toxicity(docs, fit_machine(docs, labels, parts=parts, size=size), parts)
