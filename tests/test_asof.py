import bisect
import random

import pytest
from conftest import ts
from pyspark.sql import functions as F
from test_plans import SF, plan

from resgov.operators import asof as O
from resgov.plans.queries import queries

Q = "id long, k1 string, k2 long, at timestamp_ntz, value string, `odd name` int"
FACT = "k1 string, k2 long, t timestamp_ntz, seq long, value string, n long"


def brute(questions, facts):
    held = {}
    for k1, k2, t, seq, value, n in facts:
        if None not in (k1, k2, t):
            held.setdefault((k1, k2), []).append((t, seq, value, n))
    for rows in held.values():
        rows.sort(key=lambda r: r[:2])
    out = []
    for i, k1, k2, at, *_ in questions:
        rows = held.get((k1, k2), []) if at is not None else []
        at_most = bisect.bisect_right([r[0] for r in rows], at) if rows else 0
        out.append((i, *(rows[at_most - 1][2:] if at_most else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7, 40, None])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions or 0)
    time = lambda: ts(f"2024-01-{rng.randrange(1, 29):02d} 0{rng.randrange(10)}:00:00")
    key = lambda: (rng.choice(["hot", "hot", "hot", "a", "b", "", None]), rng.choice([1, 1, 2, None]))
    questions = [(i, *key(), rng.choice([time(), time(), time(), None]), "q", 1) for i in range(900)]
    facts = [(*key(), rng.choice([time(), time(), time(), None]), i, f"v{i}", None if i % 9 == 0 else i) for i in range(300)]
    got = O.as_of(spark.createDataFrame(questions, Q), spark.createDataFrame(facts, FACT), ["k1", "k2"], "at", "t", ["seq"], ["value", "n"], prefix="held_", partitions=partitions)
    assert got.columns == ["id", "k1", "k2", "at", "value", "odd name", "held_value", "held_n"]
    assert sorted((r.id, r.held_value, r.held_n) for r in got.collect()) == brute(questions, facts)


def test_a_hot_key_is_cut_and_carried_over_partitions_without_facts(spark):
    """One fact, then questions of one key over many partitions: most of them hold no fact."""
    facts = [("hot", 1, ts("2024-01-01 00:00:00"), 1, "first", 1), ("a", 1, ts("2024-01-01 00:00:00"), 2, "other", 2)]
    questions = [(i, "hot", 1, ts(f"2024-02-{1 + i % 28:02d} 00:00:00"), "q", 1) for i in range(4000)]
    q, f = spark.createDataFrame(questions, Q), spark.createDataFrame(facts, FACT)
    parts = O.timeline(q, f, ["k1", "k2"], "at", "t", ["seq"], ["value"], 16)
    sizes = [r["count"] for r in parts.where("_k0 = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 2 * 4000 / 16
    got = O.as_of(q, f, ["k1", "k2"], "at", "t", ["seq"], ["value"], prefix="held_", partitions=16)
    assert got.groupBy("held_value").count().collect() == [("first", 4000)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_pieces_are_bounded_whatever_the_partitions(spark, partitions):
    rng = random.Random(partitions)
    time = lambda: rng.choice([ts(f"2024-01-{rng.randrange(1, 29):02d} 00:00:00")] * 9 + [None])
    questions = [(i, rng.choice(["hot", "hot", "a", None]), 1, time(), "q", 1) for i in range(700)]
    facts = [("hot", 1, time(), i, f"v{i}", i) for i in range(40)] + [("a", 1, ts("2024-01-01 00:00:00"), 99, "a", 99)]
    q, f = spark.createDataFrame(questions, Q), spark.createDataFrame(facts, FACT)
    parts = O.timeline(q, f, ["k1", "k2"], "at", "t", ["seq"], ["value"], partitions, piece_rows=16)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert max(sizes) == 16 and sum(sizes) == len(questions) + sum(r[2] is not None for r in facts)
    got = O.as_of(q, f, ["k1", "k2"], "at", "t", ["seq"], ["value", "n"], prefix="held_", partitions=partitions, piece_rows=16)
    # one piece, two by the sampled cuts, a task
    assert got.where("id is not null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 4 * 16
    assert sorted((r.id, r.held_value, r.held_n) for r in got.collect()) == brute(questions, facts)


def test_empty_sides(spark):
    q, f = spark.createDataFrame([(1, "a", 1, ts("2024-01-01 00:00:00"), "q", 1)], Q), spark.createDataFrame([], FACT)
    assert [r.held_value for r in O.as_of(q, f, ["k1", "k2"], "at", "t", ["seq"], ["value"], prefix="held_").collect()] == [None]
    assert O.as_of(q.limit(0), f, ["k1", "k2"], "at", "t", ["seq"], ["value"], prefix="held_").collect() == []


def test_no_join_on_time(spark):
    text = plan(queries()["decision_as_of"](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" not in text
    assert {line.strip() for line in text.splitlines() if line.strip().startswith("Join condition")} <= {"Join condition: None"}
    assert text.count("Exchange hashpartitioning") <= 2
