import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from resgov.llm import bloom_lm as B

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    """held_out, n_tokens, n_known, N, base score and model score (from quantised counts) of each (doc_id, text)."""
    words = [WORD.findall((t or "").translate(LOW)) + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    one = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    two = Counter(p for ws, h in zip(words, held) if not h for p in zip([None, *ws], ws))
    texts = held.count(False)
    n, v = sum(one.values()), len(one)
    middle = lambda c: 0 if not c else (2 ** int(math.log2(c)) + 2 ** (int(math.log2(c)) + 1) - 1) / 2
    out = []
    for ws, h in zip(words, held):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        score = 0.0
        for a, b in zip([None, *ws], ws):
            c0 = middle(texts if a is None else one[a])
            share = (middle(one[b]) + 0.1) / (n + 0.1 * (v + 1))
            score += math.log10((min(middle(two[a, b]), c0) + B.MU * share) / (c0 + B.MU))
        out.append((h, len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


def check(df, rows, exact):
    got = sorted(((r.doc_id or -1, r.n_tokens, r.base_score), r) for r in df.collect())
    want = sorted(((i or -1, w[1], w[4]), w) for (i, _), w in zip(rows, brute(rows)))
    assert len(got) == len(want)
    for (_, r), (_, (h, tokens, known, n, base, score)) in zip(got, want):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(score, abs=1e-6 if exact else 0.05 * tokens + 0.3)  # one probe in a hundred finds a pair that is not there


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


def test_scores_against_brute_force(documents):
    df, rows = documents
    check(B.score(df), rows, exact=False)


def test_many_segments_and_chunks(documents):
    """Tiny segments and chunks change nothing; with many bits an entry no probe errs and scores are those of the counts."""
    df, rows = documents
    check(B.score(df.repartition(3, "doc_id"), chunk_bytes=20_000, segment_bytes=4_000, bits_an_entry=600), rows, exact=True)
    check(B.score(df, bits_an_entry=600), rows, exact=True)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(B.score(odd), rows, exact=False)
    check(B.score(odd, chunk_bytes=1, bits_an_entry=600), rows, exact=True)
    assert B.score(nothing).collect() == []


def test_chunk_that_changes_is_an_error(spark):
    """Rows in another order at the second read would get the levels of other texts."""
    df = spark.range(400).withColumn("doc_id", F.col("id")).withColumn("text", F.concat(F.lit("word"), F.monotonically_increasing_id() + F.unix_micros(F.current_timestamp())))
    scored = B.score(df)
    time.sleep(0.1)
    with pytest.raises(Exception, match="changed between two reads"):
        scored.collect()


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 for r in B.score(df).collect())


def test_levels_are_never_too_low():
    keys = np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64)
    levels = np.random.default_rng(2).integers(0, 7, 4000)
    found = B.probed(keys, B.built(keys, levels))
    assert (found >= levels).all() and (found == levels).mean() > 0.98
    assert (B.probed(keys, B.built(keys, levels, 600)) == levels).all() and not B.probed(keys, B.built(keys[:0], levels[:0])).any()
    assert list(B.amount(np.array([0, 1, 2, 3]))) == [0.0, 1.0, 2.5, 5.5]
    assert list(B.level_of(np.array([0, 1, 2, 3, 4, 7, 8, 2**40]))) == [0, 1, 2, 2, 3, 3, 4, 41]


def test_keys_in_bytes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (B.unpacked_keys(B.packed_keys(keys)) == keys).all() and (B.unsqueezed(B.squeezed(keys)) == keys).all()
    assert len(B.packed_keys(keys)) < 7.2 * len(keys) and len(B.squeezed(np.ones(5000, int))) < 100
