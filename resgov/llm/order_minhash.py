"""Document fingerprints by Order MinHash.

Every k-mer (k code points) of a text gets its occurrence number, so repeats
differ.  For each of m hash functions the l occurrences with the smallest
hashes are taken in text order, and the hash of that tuple is one entry of the
fingerprint: entries agree when the same k-mers come in the same order, which
follows edit distance, while plain MinHash ignores order.  Likeness is the
share of equal entries.

Equal texts have equal fingerprints.  Null is the empty text; the empty text
has a fingerprint of its own; a text shorter than k is one k-mer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import prepared
from .words import mix64

K, M, L = 8, 32, 2
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer came before, in text order."""
    out = np.zeros(len(kmers), dtype=np.uint64)
    ordered = np.sort(kmers)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        at = np.minimum(np.searchsorted(again, kmers), len(again) - 1)
        rows = np.flatnonzero(again[at] == kmers)
        rows = rows[np.argsort(kmers[rows], kind="stable")]
        values = kmers[rows]
        begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        out[rows] = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return out


def fingerprint(codes: np.ndarray, k: int = K, l: int = L) -> np.ndarray:
    """m 32-bit entries."""
    if not len(codes):
        return np.zeros(M, dtype=np.uint32)
    h, width = mix64(codes.astype(np.uint64) + _STEP), 1
    k = min(k, len(codes))
    while width < k:  # doubling: a k-mer's hash from those of two overlapping or adjoining parts
        part = min(width, k - width)
        h = (h[:len(h) - part] * _STEP) ^ (h[part:] + np.uint64(width))
        h ^= h >> np.uint64(29)
        width += part
    kmers = mix64(h)
    keys = mix64(kmers + occurrences(kmers) * _STEP)
    l = min(l, len(keys))
    out = np.empty(M, dtype=np.uint64)
    values = np.empty_like(keys)
    picked = np.empty(l, dtype=np.int64)
    top = np.uint64(2**64 - 1)
    for j in range(M):
        np.bitwise_xor(keys, _XOR[j], out=values)
        np.multiply(values, _MUL[j], out=values)
        for i in range(l):
            picked[i] = at = values.argmin()
            values[at] = top
        picked.sort()
        entry = _STEP
        for x in kmers[picked]:
            entry = (int(entry) * 0xD6E8FEB86659FD93 + int(x)) & 0xFFFFFFFFFFFFFFFF
            entry ^= entry >> 31
        out[j] = entry
    return (mix64(out) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint): one map over the whole texts, no shuffle."""
    prepared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            codes = [code_points(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, codes), pa.int64()), pa.array([fingerprint(c).tobytes().hex() for c in codes], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and the likeness to that and to the next document's.

    Edited: the last floor(n_chars / 2) code points give way to the first as many
    (or all) of the next document by descending doc_id; after the last comes the
    first.  Rows of one doc_id go by the hash of their texts; a null doc_id is last.

    Documents are dealt to ranges of doc_id and sorted there, so text moves once.
    The first row of each range is also sent to the end of the range before it;
    only those rows' keys (one a partition) pass through the driver.
    """
    spark = prepared(docs.sparkSession)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = -(2**63)
    key = F.coalesce("doc_id", F.lit(low))
    bounds = np.unique(np.array(rows.select(key.cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], dtype=np.float64))

    @F.pandas_udf("int")
    def part_of(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy().astype(np.float64), side="left").astype(np.int32))

    dealt = rows.withColumn("part", part_of(key)).withColumn("h", F.xxhash64("text"))
    firsts = dealt.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(low)).alias("d"), "h")).alias("top")).collect()
    firsts.sort(key=lambda r: -r.part)
    guests = [(firsts[i].part, firsts[(i + 1) % len(firsts)].top.d, firsts[(i + 1) % len(firsts)].top.h) for i in range(len(firsts))]
    if not guests:
        guests = [(0, low, 0)]
    guest = spark.createDataFrame(guests, "to int, d long, g long")
    ends = (rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(guest), (key == F.col("d")) & (F.col("h") == F.col("g")))
            .select("doc_id", "text", F.col("to").alias("part"), "h", F.lit(1).alias("guest")))
    every = (dealt.select("doc_id", "text", "part", "h", F.lit(0).alias("guest")).unionByName(ends)
             .repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("h")))

    def run(batches):
        held, part, done = None, None, []

        def finish(codes, print_, text):
            n, own = len(held[1]), held[0]
            half = n // 2
            edited = own[1][:n - half] + text[:half]
            other = fingerprint(code_points(edited))
            done.append((own[0], n, hashlib.sha256(edited.encode()).hexdigest(), held[2].tobytes().hex(), other.tobytes().hex(), likeness(held[2], other), likeness(held[2], print_)))

        for batch in batches:
            done = []
            ids, texts, parts_, guests_ = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i, text, at, is_guest in zip(ids, texts, parts_, guests_):
                if at != part:
                    held, part = None, at
                if is_guest and held is None:
                    continue  # a second copy of the guest
                codes = code_points(text)
                print_ = fingerprint(codes)
                if held is not None:
                    finish(codes, print_, text)
                held = None if is_guest else ((i, text), codes, print_)
            columns = list(zip(*done)) if done else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return every.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
