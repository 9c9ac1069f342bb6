"""Fill-in-the-middle by a piecewise-linear learned rank index.

A text of n lines has n + 1 boundaries; boundary i lies ``offsets[i]`` code
points into the text.  The index learns that map: a greedy cone fits the
longest segment whose line misses none of its boundaries by more than ``ERROR``
code points, then the next segment starts.  Rounded down, a line misses by no
more than ERROR + 1, so each boundary's residual fits one signed byte.  A cut
at rank i finds its segment by binary search, predicts, and adds the stored
residual: exact, with one byte a line and a few numbers a segment in place of
eight bytes a line.

Two ranks drawn from a hash of doc_id cut a text into prefix, middle and
suffix, which are put in the order of the form: psm, spm, or plain (as it is).
A text that holds one of the marks is left plain, so the marks of an output
always tell its parts.

One map over the rows: no shuffle, nothing broadcast; a task holds one Arrow
batch and, for each text in turn, its boundaries.

Defined results: null and empty text have 0 lines and are plain; a null doc_id
is hashed as an empty id; equal rows give equal results; very long texts are
cut like others; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import prepared

ERROR = 120
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED, RATE, SPM_RATE = 7, 100, 50
SLICE = 64


def boundaries(text: str) -> np.ndarray:
    """Code points before each line boundary: 0, after every line end, and the end of a last line without one."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    tail = [] if len(ends) and ends[-1] == len(text) else [len(text)]
    return np.concatenate([[0], ends, tail]).astype(np.int64)


class RankIndex:
    """Segments (first rank, offset there, slope) and a residual a boundary."""

    def __init__(self, ranks, starts, slopes, residuals):
        self.ranks, self.starts, self.slopes, self.residuals = ranks, starts, slopes, residuals

    def predict(self, rank) -> np.ndarray:
        at = np.searchsorted(self.ranks, rank, side="right") - 1
        return self.starts[at] + np.floor(self.slopes[at] * (rank - self.ranks[at])).astype(np.int64)

    def offset(self, rank) -> np.ndarray:
        """The exact offsets of boundaries: prediction and residual."""
        rank = np.asarray(rank)
        return self.predict(rank) + self.residuals[rank]

    def __len__(self) -> int:
        """Boundaries less one: the lines."""
        return len(self.residuals) - 1


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of ascending offsets; error at most 126."""
    ranks, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, reach, window = -np.inf, np.inf, at + 1, 32
        while reach < n:  # the cone of slopes that every boundary so far allows
            run = np.arange(reach, min(reach + window, n)) - at
            rise = offsets[reach:reach + len(run)] - offsets[at]
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            closed = np.flatnonzero(lows > highs)
            good = closed[0] if len(closed) else len(run)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            reach, window = reach + good, window * 2
            if len(closed):
                break
        ranks.append(at)
        slopes.append((low + high) / 2 if np.isfinite(low) else 0.0)
        at = reach
    index = RankIndex(np.array(ranks, np.int64), offsets[ranks], np.array(slopes, np.float64), None)
    index.residuals = (offsets - index.predict(np.arange(n))).astype(np.int8)
    return index


def draws(doc_id, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned integers from the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[RankIndex, str, str, int | None, int | None]:
    """(index, form, output, code points of the prefix, of the middle) of a text."""
    index = fit(boundaries(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= rate:
        return index, "plain", text, None, None
    n = len(index)
    first, second = (int(x) for x in index.offset(sorted((h1 % (n + 1), h2 % (n + 1)))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return index, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, second - first
    return index, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, second - first


def restore(output: str, form: str) -> str:
    """The text of an output, by its marks alone."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"no {form} output")
    second = output.index(two)
    third = output.index(MIDDLE)
    a, b, middle = output[len(one):second], output[second + len(two):third], output[third + len(MIDDLE):]
    return a + middle + b if form == "psm" else b + middle + a


def _rows(docs: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _mapped(docs: DataFrame, row, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """row(doc_id, text) of every text, a few texts at a time."""
    names, types = [n for n, _, _ in fields], [t for _, _, t in fields]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                out = [row(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["doc_id", *names])

    return _rows(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {kind}" for n, kind, _ in fields))


def indexed(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, n (lines) and the index itself: ranks, starts and slopes of the segments, residuals (a signed byte a boundary)."""
    def row(_, text):
        index = fit(boundaries(text), error)
        return len(index), index.ranks, index.starts, index.slopes, index.residuals.tobytes()

    return _mapped(docs, row, [("n", "long", pa.int64()), ("ranks", "array<long>", pa.list_(pa.int64())), ("starts", "array<long>", pa.list_(pa.int64())),
                               ("slopes", "array<double>", pa.list_(pa.float64())), ("residuals", "binary", pa.binary())])


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, n_segments, form, prefix_chars, middle_chars (null if plain) and the output text."""
    def row(doc_id, text):
        index, form, output, prefix, middle = transform(doc_id, text, seed, rate, spm_rate)
        return len(index), len(index.ranks), form, prefix, middle, output

    return _mapped(docs, row, [("n", "long", pa.int64()), ("n_segments", "long", pa.int64()), ("form", "string", pa.string()),
                               ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()), ("output", "string", pa.string())])


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of transformed() with ``text``, put together again from output and form alone."""
    names = outputs.columns
    at, how = names.index("output"), names.index("form")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                texts = [restore(o, f) for o, f in zip(part.column(at).to_pylist(), part.column(how).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(run, f"{kinds}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """transformed() with the SHA-256 of output and restored text in place of the texts."""
    rows = restored(transformed(docs))
    return rows.select("doc_id", "n", "n_segments", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode("text", "UTF-8"), 256).alias("restored_sha256"))
