import numpy as np
import pytest
from pyspark.sql import functions as F

from resgov.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def brute(rows, threshold):
    x = [None if e is None or y is None or not len(e) or any(v is None or not np.isfinite(v) for v in e) or not np.linalg.norm(e) else np.array(np.float32(e), float) / np.linalg.norm(np.float32(e).astype(float)) for _, e, y, *_ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted(map(tuple, N.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("block", [4, 512])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=(60, 16))
        dense = base[0] + rng.normal(scale=0.05, size=(25, 16))
        pairs = base[1:20] + rng.normal(scale=0.06, size=(19, 16))
        for v in np.concatenate([base, dense, pairs, base[:3]]):
            rows.append((len(rows), [float(np.float32(a)) for a in v], label, 0))
    assert got(spark, rows) == brute(rows, 0.93)


def test_odd_rows(spark):
    rows = [(1, None, 1, 0), (2, [], 1, 0), (3, [0.0, 0.0], 1, 0), (4, [1.0, None], 1, 0), (5, [1.0, float("nan")], 1, 0), (6, [1.0, float("inf")], 1, 0),
            (7, [1.0, 0.0], None, 0), (8, [1.0, 0.0], 1, 0), (8, [1.0, 0.0], 1, 0), (9, [2.0, 0.0], 1, 0), (10, [1.0, 0.0, 0.0], 1, 0), (None, [0.0, 1.0], 2, 0), (11, [1.0, 0.0], 2, 0)]
    assert got(spark, rows) == brute(rows, 0.93)
    assert N.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert got(spark, rows[:3]) == brute(rows[:3], 0.93)


def two_dense_groups(size=30):
    """Two groups, cosine above 0.99 inside and 0.95 across: every list fills with members of the own group."""
    rng = np.random.default_rng(5)
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    centres = (a, 0.955 * a + np.sqrt(1 - 0.955**2) * b)
    return [(i, [float(np.float32(v)) for v in centres[i % 2] + rng.normal(scale=0.008, size=32)], 1, 0) for i in range(2 * size)]


@pytest.mark.parametrize("block", [8, 512])
def test_linked_dense_groups(spark, monkeypatch, block):
    """All links are known across two saturated groups, and one survivor stays."""
    monkeypatch.setattr(N, "BLOCK", block)
    rows = two_dense_groups()
    out = got(spark, rows)
    assert out == brute(rows, 0.93) and sum(kept for *_, kept in out) == 1


def test_short_recall_is_not_accepted(spark, monkeypatch):
    """Orderings that find nothing: rare links outside the first audit queries are still all found."""
    empty = lambda nodes, *_: nodes.sparkSession.createDataFrame([], N.EDGES)
    monkeypatch.setattr(N, "neighbours_by_order", empty)
    monkeypatch.setattr(N, "AUDIT_BYTES", 5000)
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "MOST", N.TABLES)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 24))
    rows = [(i, [float(np.float32(v)) for v in x], 1, 0) for i, x in enumerate(np.concatenate([base, base[:1] + 0.02]))]
    assert got(spark, rows) == brute(rows, 0.93)


def test_saturated_lists_double(spark):
    """Lists grow by doubling until their last entry is no link, up to the largest size; others keep K."""
    def edges(u, linked, rest):
        return [(u, 1000 + i, 0.99 - i / 1000, 0) for i in range(linked)] + [(u, 2000 + i, 0.5 - i / 1000, 0) for i in range(rest)]

    rows = edges(1, 0, 50) + edges(2, 7, 50) + edges(3, 8, 50) + edges(4, 15, 50) + edges(5, 16, 50) + edges(6, 31, 50) + edges(7, 60, 5) + edges(8, 20, 2) + edges(9, 3, 0)
    lists = N.nearest(spark.createDataFrame(rows + rows[:9], "u long, v long, sim double, born int"), 0.93)
    sizes = {r.u: (r["n"], r.links) for r in lists.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("sim") >= 0.93).alias("links")).collect()}
    assert sizes == {1: (8, 0), 2: (8, 7), 3: (16, 8), 4: (16, 15), 5: (32, 16), 6: (32, 31), 7: (32, 32), 8: (22, 20), 9: (3, 3)}


def test_groups_between_the_sizes(spark, monkeypatch):
    """Groups of 9 to 30 members, linked all with all: their lists hold every link, none is counted in blocks."""
    monkeypatch.setattr(N, "dense_counts", lambda members, threshold: members.selectExpr("node", "cast(-1 as long) as links").limit(0))
    rng = np.random.default_rng(3)
    rows = []
    for size in range(9, 31, 3):
        centre = rng.normal(size=24)
        rows += [(len(rows) + i, [float(np.float32(v)) for v in centre + rng.normal(scale=0.01, size=24)], size % 2, 0) for i in range(size)]
    rows += [(len(rows) + i, [float(np.float32(v)) for v in rng.normal(size=24)], i % 2, 0) for i in range(200)]
    assert got(spark, rows) == brute(rows, 0.93)


def test_audit_of_stated_ids(spark, monkeypatch):
    monkeypatch.setattr(N, "AUDIT_LEAST", 5)
    nodes = spark.range(1000).selectExpr("id as node", "id as first_id", "'a' as label", "cast(1 as long) as weight")
    raw = [(i, np.array([1.0, float(i % 3)]).tobytes()) for i in range(1000)]
    nodes = nodes.join(spark.createDataFrame(raw, "node long, raw binary"), "node")
    truth = {r.node: r.truth for r in N.audit(nodes, 0.93).collect()}
    assert set(truth) == set(range(0, 1000, 100)) and all(n == sum(j % 3 == i % 3 or {i % 3, j % 3} == {1, 2} and 3 / 10**0.5 >= 0.93 for j in range(1000)) - 1 for i, n in truth.items())


def test_recall_weighs_links(spark):
    truth = spark.createDataFrame([(i, 1) for i in range(99)] + [(99, 100)], "node long, truth long")
    counts = spark.createDataFrame([(i, 1) for i in range(99)], "node long, links long")
    assert N.recall(truth, counts) < 0.5 and N.recall(truth, truth.withColumnRenamed("truth", "links")) == 1
