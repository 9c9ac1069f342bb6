"""Stored layouts: folders pruned at run time, joins without exchange, only touched folders rewritten."""

import contextlib
import os
import random
import re
import uuid

import pytest
from conftest import ts
from pyspark.sql import functions as F
from test_plans import SF, plan

from resgov.functions.times import ntz
from resgov.operators import layout as W
from resgov.operators import snapshots as K
from resgov.operators import status as J
from resgov.plans import queries as Q
from resgov.schemas import LEDGER, REGISTRY_COLUMNS
from resgov.sources import fixtures as X


@contextlib.contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@pytest.fixture()
def folder(run_dir):
    return f"{run_dir}/{uuid.uuid4().hex}"


# ------------------------------------------------------------ by workspace

def test_folders_are_pruned_by_a_filtered_dimension(spark, folder):
    reg = Q.registry(spark, SF)
    stored = W.read_partitioned(spark, W.write_partitioned(reg, folder))
    assert stored.columns == REGISTRY_COLUMNS and dict(stored.dtypes)["workspace_id"] == "string"
    assert K.difference_counts(reg, stored).select("only_left", "only_right").first() == (0, 0)
    dim = f"{folder}-dim"
    X.nation(spark, SF).write.parquet(dim)
    some = spark.read.parquet(dim).where("n_nationkey % 5 = 2").selectExpr("cast(n_nationkey as string) as workspace_id")
    picked = W.pick_workspaces(stored, some)
    text = plan(picked)
    assert "dynamicpruning" in text and re.search(r"PartitionFilters: \[.*dynamicpruning", text)
    ids = {r.workspace_id for r in some.collect()}
    assert ids and {r.workspace_id for r in picked.collect()} == ids & {r.workspace_id for r in reg.select("workspace_id").distinct().collect()}


def test_a_small_value_is_one_file_and_numbers_stay_text(spark, folder):
    rows = spark.range(2000).select(F.col("id").alias("n"), F.when(F.col("id") < 1990, "007").when(F.col("id") < 1995, "8").when(F.col("id") < 1998, "").alias("workspace_id")).repartition(9)
    schema = rows.schema
    W.write_partitioned(rows, folder)
    back = W.read_partitioned(spark, folder, schema)
    assert sorted(r["count"] for r in back.groupBy("workspace_id").count().collect()) == [5, 5, 1990]
    assert {r.workspace_id for r in back.select("workspace_id").distinct().collect()} == {"007", "8", None}
    assert len([f for f in os.listdir(f"{folder}/workspace_id=8") if f.endswith(".parquet")]) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_partitioned(rows, folder)


# ----------------------------------------------------------------- by key

def test_bucketed_join_has_no_exchange(spark, folder):
    inv = W.write_bucketed(X.inventory(spark, SF), f"inv_{uuid.uuid4().hex}", f"{folder}/inv", 4)
    reg = W.write_bucketed(Q.registry(spark, SF), f"reg_{uuid.uuid4().hex}", f"{folder}/reg", 4)
    assert len([f for f in os.listdir(f"{folder}/reg") if f.endswith(".parquet")]) == 4  # one file a bucket
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = plan(J.resource_status(inv, reg, ntz(X.AS_OF), on=[W.ROW_KEY]))
        assert "SortMergeJoin" in text and "Exchange" not in text
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        found = W.lookup(reg, ("64", "21"))
        text = plan(found)
        assert "SelectedBucketsCount: 1 out of 4" in text
    key = Q.registry(spark, SF).select("resource_id", "workspace_id").first()
    assert [tuple(r) for r in W.lookup(reg, key).select("resource_id", "workspace_id").collect()] == [tuple(key)]
    assert W.lookup(reg, ("no", "such")).count() == 0


def test_row_keys_are_unambiguous(spark):
    rows = spark.createDataFrame([("1", "23"), ("12", "3"), ("1:2", "3"), ("1", ":23"), ("", "123"), (None, "1"), ("1", None)], "resource_id string, workspace_id string")
    keys = [r[0] for r in rows.select(W.row_key()).collect()]
    assert len(set(keys[:5])) == 5 and keys[5:] == [None, None]


# -------------------------------------------------------------- by version

def ledger(spark, rows):
    full = [(k, v, "d", "sql", f"c{v}", status, ts(f"2024-01-0{day} 00:00:00"), 1.0, None, None, None, "a", "a") for k, v, status, day in rows]
    return spark.createDataFrame(full, LEDGER)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) if "version=" in d for f in names if f.endswith(".parquet")}


def content(spark, folder):
    return sorted((r.schema_key, r.version or 0, r.status, r.applied_at.day) for r in W.read_ledger(spark, folder).collect())


ROWS = [("s", 1, "failed", 1), ("s", 1, "applied", 2), ("t", 1, "applied", 1), ("s", 2, "failed", 1), ("s", 2, "applied", 2), ("s", 3, "failed", 1), ("t", 3, "failed", 1), ("u", None, "failed", 1)]


def test_only_the_folder_of_the_version_is_rewritten(spark, folder):
    W.write_ledger(ledger(spark, ROWS), folder)
    before = files(folder)
    W.delete_failed(spark, folder, 1)
    after = files(folder)
    assert content(spark, folder) == sorted((k, v or 0, s, d) for k, v, s, d in ROWS if (v, s) != (1, "failed"))
    touched = lambda a, b: {os.path.basename(os.path.dirname(f)) for f, _ in set(a.items()) ^ set(b.items())}
    assert touched(before, after) == {"version=1"}
    W.delete_failed(spark, folder, 3)  # no row of the folder stays
    assert touched(after, files(folder)) == {"version=3"}
    assert content(spark, folder) == sorted((k, v or 0, s, d) for k, v, s, d in ROWS if (v, s) not in ((1, "failed"), (3, "failed")))
    last = files(folder)
    W.delete_failed(spark, folder, 99)
    assert files(folder) == last


def test_a_second_append_adds_nothing(spark, folder):
    W.write_ledger(ledger(spark, ROWS[:4]), folder)
    for _ in range(2):
        W.append_new(ledger(spark, ROWS + ROWS[-2:]), folder)
    assert content(spark, folder) == sorted((k, v or 0, s, d) for k, v, s, d in ROWS)


def test_append_reads_only_the_folders_of_its_versions(spark, folder):
    W.write_ledger(ledger(spark, ROWS), folder)
    before = files(folder)
    W.append_new(ledger(spark, [("n", 2, "applied", 5)]), folder)
    assert set(before.items()) <= set(files(folder).items())
    assert content(spark, folder) == sorted([(k, v or 0, s, d) for k, v, s, d in ROWS] + [("n", 2, "applied", 5)])


def in_parts(df, parts, number):
    """df dealt over ``parts`` partitions by the number ``number``, as it comes."""
    return df.sparkSession.createDataFrame(df.rdd.keyBy(lambda r: number(r)).partitionBy(parts, lambda k: k % parts).values(), df.schema)


def test_ledger_rows_are_written_where_they_are(spark, folder):
    rows = [(f"s{i}", v, "applied", 1) for i in range(50) for v in (1, 2, 3)]
    dealt = in_parts(ledger(spark, rows), 5, lambda r: int(r.schema_key[1:]))
    W.write_ledger(dealt.filter("version < 3"), folder)
    W.append_new(dealt, folder)
    assert content(spark, folder) == sorted((k, v, s, d) for k, v, s, d in rows)
    assert [sum(f"version={v}/" in f for f in files(folder)) for v in (1, 2, 3)] == [5, 5, 5]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_append_against_brute_force(spark, folder, threshold):
    """Keys shared by new rows, keys stored already, keys with nulls, in versions with and without a folder; a long list of keys is not broadcast."""
    rng = random.Random(7)
    some = lambda n, versions: [(rng.choice(["s", "1:s", "", None]), rng.choice(versions), rng.choice(["d", "e", None]), "sql", rng.choice(["c", "-", None]), rng.choice(["applied", "failed"]),
                                 rng.choice([None, ts("2024-01-01 00:00:00.000001"), ts("2024-01-01 00:00:00")]), 1.0, None, None, None, "a", "a") for _ in range(n)]
    old, new = some(30, [1, 2, None]), some(300, [2, 3, 4, None]) + some(9, [17])
    key = lambda r: (r[0], r[1], r[4], r[6])
    order = lambda r: [(x is not None, x or "") for x in (r[2], r[3], r[5])]
    want, stored = list(old), {key(r) for r in old}
    best = {}
    for r in new:
        if key(r) not in stored:
            best[key(r)] = max(best.get(key(r), r), r, key=order)
    want += best.values()
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", threshold):
        W.write_ledger(spark.createDataFrame(old, LEDGER), folder)
        for _ in range(2):
            W.append_new(spark.createDataFrame(new, LEDGER).repartition(3), folder)
    # empty texts come back as they are; only the version is a folder
    got = [tuple(r) for r in W.read_ledger(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ------------------------------------------------------------ fingerprints

def test_fingerprints_find_changed_lost_and_doubled_rows(spark):
    rows = spark.createDataFrame([(w, i, None if i % 3 else "x", float(i)) for w in "abcd" for i in range(50)], "w string, i int, s string, f double")
    moved = rows.repartition(7).select("f", "s", "i", "w")
    assert {r.same for r in K.compare_fingerprints(rows, moved, ["w"]).collect()} == {True}
    damage = {
        "changed": rows.withColumn("s", F.when((F.col("w") == "b") & (F.col("i") == 7), "y").otherwise(F.col("s"))),
        "lost": rows.filter("not (w = 'b' and i = 7)"),
        "doubled": rows.unionByName(rows.filter("w = 'b' and i = 7")),
        "doubled and lost": rows.filter("not (w = 'b' and i = 8)").unionByName(rows.filter("w = 'b' and i = 7")),
        "tripled": rows.unionByName(rows.filter("w = 'b' and i = 7")).unionByName(rows.filter("w = 'b' and i = 7")),
        "null moved to another column": rows.withColumn("f", F.when((F.col("w") == "b") & (F.col("i") == 7), F.lit(None)).otherwise(F.col("f")))}
    for what, other in damage.items():
        found = {r.w: r.same for r in K.compare_fingerprints(rows, other, ["w"]).collect()}
        assert found == {"a": True, "b": False, "c": True, "d": True}, what
        apart = K.differing_rows(rows, other, ["w"]).collect()
        assert apart and {r.w for r in apart} == {"b"} and all(r.n_left != r.n_right for r in apart), what
    gone = K.compare_fingerprints(rows, rows.filter("w <> 'c'"), ["w"]).where("not same").collect()
    assert [(r.w, r.n_left, r.n_right) for r in gone] == [("c", 50, 0)]
    assert K.compare_fingerprints(rows, rows.limit(0), []).collect()[0].same is False


def test_nulls_in_different_columns_differ(spark):
    a = spark.createDataFrame([(None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, None)], "x int, y int")
    assert K.compare_fingerprints(a, b, []).first().same is False


def test_fingerprints_exchange_no_rows(spark, run_dir):
    path = f"{run_dir}/{uuid.uuid4().hex}"
    K.write_snapshot(Q.registry(spark, SF), path)
    text = plan(K.fingerprint(spark.read.parquet(path), ["workspace_id"]), "simple")
    lines = [line.strip() for line in text.splitlines()]
    at = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert "partial_bit_xor" in lines[at + 1] and sum("Exchange" in line for line in lines) == 1
