import math
import random

import numpy as np
from pyspark.sql import functions as F

from resgov.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, q long, anchor string"


def brute(rows, positives=5, negatives=5, share=80, step=100):
    """All (vec_id, vector, label) rows against all anchors by the plain rule; repeated rows count once."""
    use = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
            use.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, la, va in use:
        if a % step:
            continue
        scored = {(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in use if len(v) == len(va)}
        near = sorted({(s, i) for s, i, label in scored if label == la and i != a})[:positives]
        others = sorted({(s, i) for s, i, label in scored if label != la})
        for p, pid in near:
            inside = [(s, i) for s, i in others if -share * p <= -100 * s <= -100 * p][:negatives]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)
    used = H.usable(df)
    out = H.hard_negatives(used.withColumn("label", H.noisy_label(F.col("id"), F.col("label"))), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def close_vectors(n, d, seed, labels=3):
    """Few directions and small changes, so that windows overlap, tie and fill."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, d))
    return [(int(i), [float(np.float32(x)) for x in np.round(centres[rng.integers(4)] + rng.normal(0, 0.15, d), 1)], int(rng.integers(labels))) for i in range(n)]


def test_against_brute_force(spark):
    rows = close_vectors(1500, 6, 1)
    want = brute(rows)
    assert len(want) > 300 and got(spark, rows) == want


def test_waves_and_other_sizes(spark):
    rows = close_vectors(700, 4, 2)
    assert got(spark, rows, step=25, positives=3, negatives=7, share=50, wave_bytes=1000) == brute(rows, 3, 7, 50, 25)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = close_vectors(300, 3, 3)
    rows += rows[:150]  # repeated rows
    rows += [(i, rows[100][1], rng.randrange(3)) for i in range(1000, 1900)]  # one hot vector
    rows += [(None, [1.0, 1.0, 1.0], 1), (400, None, 1), (401, [1.0, None, 0.0], 1), (402, [float("nan"), 0.0, 1.0], 1), (403, [float("inf"), 0.0, 1.0], 2), (404, [0.5, 0.5, 0.5], None),
             (500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (502, [1.0, 1.5], 2), (600, [], 1), (601, [], 1), (602, [], 2), (700, [0.0, 0.0, 0.0], 1), (100, [0.25, 0.5, -1.0], 0), (-100, [1.0, 1.0, 1.0], -3)]
    want = brute(rows)
    assert len(want) > 50 and got(spark, rows) == want


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [3e6, 3.0], 2), (3, [2.9e6, 1.0], 2), (4, [3e6, 1.0], 2)]
    assert got(spark, rows) == brute(rows) != []


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mined(empty).collect() == [] and H.mined(empty.limit(0)).columns[0] == "anchor_id"
    assert got(spark, [(100, [1.0], 1)]) == [] and got(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-2.0], 2)]) == []


def test_best_keeps_what_a_sort_keeps():
    rng = np.random.default_rng(7)
    limits = np.array([[50, 30, 10], [40, -H.LONG, -H.LONG]])
    best, every = H.Best(limits, np.array([5, -H.LONG]), 3), set()
    for _ in range(40):
        scores, ids = rng.integers(-20, 60, (2, 30)), rng.integers(0, 400, 30)
        best.add(0, scores, ids, np.ones(scores.shape, bool))
        for a in range(2):
            for s, i in zip(scores[a], ids):
                if s <= limits[a, 0] and s >= (5, -H.LONG)[a]:
                    every.add((a, int((limits[a] >= s).sum()) - 1, -int(s), int(i)))
    want = [e for e in sorted(every) if sum(o[:2] == e[:2] and o < e for o in every) < 3]
    assert [tuple(r) for r in best.rows.tolist()] == want


def test_rows_of_the_best_stay_bounded():
    best = H.Best(np.full((1, 1), H.LONG), np.full(1, -H.LONG), 5)
    for i in range(200):
        best.add(0, np.full((1, 100), i), np.arange(i * 100, i * 100 + 100), np.ones((1, 100), bool))
        assert len(best.rows) <= 5
    assert best.floor[0] == 199
