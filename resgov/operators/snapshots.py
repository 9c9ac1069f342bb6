"""Registry snapshots: plain Parquet folders that are written once.

A snapshot or backup goes to a path its caller names and that must not exist
yet, so no reader ever sees a half-replaced table and nothing stored is lost.
Time travel is the fold of the decision log up to an instant
(``decisions.registry_as_of``), not a store of versions.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write ``df`` to the new folder ``path`` (an existing one is an error); returns the path."""
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def backup(spark: SparkSession, path: str, dest: str) -> str:
    """Copy a snapshot to the new folder ``dest`` (CREATE TABLE … AS SELECT)."""
    return write_snapshot(read_snapshot(spark, path), dest)


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of each side, and rows (repeats counted) only one side has.

    Both sides meet in one aggregation on all columns, so each is read once.
    """
    columns = left.columns
    sides = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.select(*columns).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    per_row = sides.groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_row.agg(total("_l").alias("n_left"), total("_r").alias("n_right"),
                       total(F.greatest(F.col("_l") - F.col("_r"), F.lit(0))).alias("only_left"),
                       total(F.greatest(F.col("_r") - F.col("_l"), F.lit(0))).alias("only_right"))


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per value of ``by``: rows and an order-free fingerprint of their content.

    Two seeded 64-bit hashes of each row are added up (in halves, which cannot
    overflow) and xored; repeats count, as sums see them where xors cancel.  All
    parts merge, so only partial aggregates are exchanged, never rows.  Columns are taken by name, in name order.
    """
    columns = sorted(df.columns)
    # a null leaves Spark's row hash as it is, so which columns are null is hashed, too
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    one, two = (F.xxhash64(F.lit(seed), nulls, *columns) for seed in (11, 1789))
    low = lambda h: F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = lambda h: F.sum(F.shiftrightunsigned(h, 32))
    return (df.select(*by, one.alias("_one"), two.alias("_two")).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_rows"), low(F.col("_one")).alias("one_low"), high(F.col("_one")).alias("one_high"), F.bit_xor("_one").alias("one_xor"),
                 low(F.col("_two")).alias("two_low"), high(F.col("_two")).alias("two_high"), F.bit_xor("_two").alias("two_xor")))


FINGERPRINT = ("n_rows", "one_low", "one_high", "one_xor", "two_low", "two_high", "two_xor")


def compare_fingerprints(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per value of ``by`` on either side: n_left, n_right and whether the contents are the same."""
    packed = lambda df: fingerprint(df, by).select(*by, F.struct(*FINGERPRINT).alias("_p"))
    sides = packed(left).withColumn("_side", F.lit(0)).unionByName(packed(right).withColumn("_side", F.lit(1)))
    side = lambda i: F.max(F.when(F.col("_side") == i, F.col("_p")))
    met = sides.groupBy(*by).agg(side(0).alias("_l"), side(1).alias("_r"))
    return met.select(*by, F.coalesce("_l.n_rows", F.lit(0)).cast("long").alias("n_left"), F.coalesce("_r.n_rows", F.lit(0)).cast("long").alias("n_right"),
                      F.col("_l").eqNullSafe(F.col("_r")).alias("same"))


def differing_rows(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (with n_left, n_right) that one side has more often; rows are compared only where fingerprints differ."""
    apart = compare_fingerprints(left, right, by).filter(~F.col("same")).select(*[F.col(c).alias(f"_{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    columns = left.columns
    some = lambda df, n, m: df.select(*columns).join(apart, same, "left_semi").withColumn("n_left", F.lit(n)).withColumn("n_right", F.lit(m))
    return (some(left, 1, 0).unionByName(some(right, 0, 1)).groupBy(*columns)
            .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).filter(F.col("n_left") != F.col("n_right")))
