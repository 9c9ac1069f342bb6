"""Stored layouts: a registry partitioned by workspace, tables bucketed by row key, a ledger partitioned by version.

All are written by Spark's own writers.  Partition folders let a filtered
workspace dimension prune at run time; buckets let the status join run without
an exchange and a lookup read one file; dynamic partition overwrite rewrites
only the partitions a change touches.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql import types as T

from ..schemas import KEY, LEDGER, REGISTRY
from ..session import shared_dir
from .ledger import FAILED

ROW_KEY = "row_key"
LEDGER_KEY = ["schema_key", "version", "checksum", "applied_at"]
# Versions a task writes at once; only rows of further versions are sorted before they are written.
OPEN_FOLDERS = 16


# ------------------------------------------------------------- by workspace

def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("workspace_id",)) -> str:
    """Write df to the new folder ``path``, a subfolder a value of ``by``.

    Rows are rebalanced by value first, so a small workspace is one file and a hot one is split over several tasks.
    A null or empty value is stored in the default folder and read back as null.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).mode("errorifexists").parquet(path)
    return path


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType = REGISTRY) -> DataFrame:
    """Read with a given schema: folder names would otherwise be read as numbers."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def pick_workspaces(stored: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Rows of the given workspaces: a semi-join whose filter prunes folders at run time."""
    return stored.join(workspaces.select("workspace_id").distinct(), "workspace_id", "left_semi")


# ------------------------------------------------------------------ by key

def row_key(keys: Sequence[str] = KEY) -> Column:
    """One text for a key of several columns: lengths make it unambiguous; null if a part is."""
    parts = []
    for k in keys:
        parts += [F.char_length(k).cast("string"), F.lit(":"), F.col(k)]
    return F.concat(*parts)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Save df with its row key as the table ``table`` at ``path``, one sorted file a bucket.

    The exchange before the write deals rows as the buckets do, so each bucket is written by one task.
    """
    keyed = df.withColumn(ROW_KEY, row_key(keys))
    keyed.repartition(buckets, ROW_KEY).write.bucketBy(buckets, ROW_KEY).sortBy(ROW_KEY).option("path", path).mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)


def lookup(bucketed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of one key: the filter on the row key leaves one bucket to read."""
    text = "".join(f"{len(k)}:{k}" for k in key)
    return bucketed.filter(F.col(ROW_KEY) == text).drop(ROW_KEY)


# -------------------------------------------------------------- by version

def _by_version(spark: SparkSession, writer: DataFrameWriter, path: str) -> None:
    """Write a subfolder a version, each task its rows where they are: neither exchanged nor, up to OPEN_FOLDERS versions, sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FOLDERS))
    try:
        writer.partitionBy("version").parquet(path)
    finally:
        spark.conf.set(name, before)


def write_ledger(rows: DataFrame, path: str) -> str:
    """Store ledger rows in the new folder ``path``, a subfolder a version."""
    _by_version(rows.sparkSession, rows.write.mode("errorifexists"), path)
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_partitioned(spark, path, LEDGER)


def key_digest(keys: Sequence[str] = LEDGER_KEY) -> Column:
    """SHA-256 of a key of several columns, nulls being values: 32 bytes in place of the key."""
    text = [F.col(k).cast("string") for k in keys]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def append_new(rows: DataFrame, path: str) -> None:
    """INSERT of the rows not stored yet, by (schema_key, version, checksum, applied_at); a second run adds nothing.

    Only the folders of the versions to be added are read.  Of new rows that share a key the greatest is added.

    What is exchanged are digests of keys, of new and stored rows together.  They tell the exceptions, which are written
    as a table: keys that are new to a version with a folder, and keys that several rows of a version without a folder
    share.  Other rows of versions without a folder are added where they are, other rows of versions with one are stored
    already.  A short table of exceptions is broadcast, a long one joined by digest.
    """
    spark = rows.sparkSession
    rest = [c for c in LEDGER.fieldNames() if c not in LEDGER_KEY]
    kept = read_ledger(spark, path)
    folders = kept.select(F.col("version").alias("_v")).distinct().withColumn("_met", F.lit(True))  # a row a version
    fresh = (rows.select(*LEDGER.fieldNames()).withColumn("_key", key_digest())
             .join(F.broadcast(folders), F.col("version").eqNullSafe(F.col("_v")), "left").withColumn("_met", F.col("_met").isNotNull()).drop("_v"))
    versions = rows.select(F.col("version").alias("_v")).distinct()
    stored = kept.join(F.broadcast(versions), F.col("version").eqNullSafe(F.col("_v")), "left_semi")
    seen = fresh.select("_key", "_met", F.lit(False).alias("_old")).union(stored.select(key_digest().alias("_key"), F.lit(True), F.lit(True)))
    counted = seen.groupBy("_key").agg(F.max("_met").alias("_met"), F.max("_old").alias("_old"), F.count(F.lit(1)).alias("_n"))
    table = shared_dir(spark, f"ledger-keys-{uuid.uuid4().hex}")
    counted.filter(~F.col("_old") & (F.col("_met") | (F.col("_n") > 1))).select("_key").write.parquet(table)
    listed = spark.read.parquet(table)
    alone = fresh.filter(~F.col("_met")).join(listed, "_key", "left_anti").select(*LEDGER.fieldNames())
    greatest = (fresh.join(listed, "_key", "left_semi").groupBy("_key", *LEDGER_KEY).agg(F.max(F.struct(*rest)).alias("_r"))
                .select(*[F.col(c) if c in LEDGER_KEY else F.col(f"_r.{c}").alias(c) for c in LEDGER.fieldNames()]))
    _by_version(spark, alone.union(greatest).write.mode("append"), path)


def delete_failed(spark: SparkSession, path: str, version: int) -> None:
    """DELETE of the failed rows of one version: only that version's folder is read and rewritten.

    The folder is replaced when the job commits.  A folder that keeps no row gets an empty file, as overwriting by
    partition leaves folders alone for which no row is written.
    """
    kept = read_ledger(spark, path).filter((F.col("version") == version) & ~F.coalesce(F.col("status") == FAILED, F.lit(False)))
    if kept.limit(1).count():
        _by_version(spark, kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic"), path)
    elif read_ledger(spark, path).filter(F.col("version") == version).limit(1).count():
        kept.drop("version").limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")
