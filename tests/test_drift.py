import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resgov.operators import drift as R

WANT = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("at", T.TimestampNTZType())])


def test_every_file_is_told_by_its_own_schema(spark, run_dir):
    """Lacking, extra and otherwise typed columns, null columns, odd folder names, a foreign and a damaged file."""
    folder = f"{run_dir}/drift {uuid.uuid4().hex}"
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    parts = {
        "whole": spark.range(3).select(F.col("id").cast("string"), F.lit(1).cast("long").alias("n"), at.alias("at")),
        "all null": spark.range(2).select(F.col("id").cast("string"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("timestamp_ntz").alias("at")),
        "lacks+n": spark.range(5).select(F.col("id").cast("string"), at.alias("at")),
        "int%n": spark.range(7).select(F.col("id").cast("string"), F.lit(1).alias("n"), at.alias("at"), F.array(F.lit(1)).alias("more")),
        "empty": spark.range(0).select(F.col("id").cast("string"), F.lit("x").alias("n"), at.alias("at"))}
    for name, df in parts.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    os.makedirs(f"{folder}/foreign")
    pq.write_table(pa.table({"id": ["a"], "n": pa.array([1], pa.int64())}), f"{folder}/foreign/f.parquet")
    files = R.file_columns(spark, folder)
    assert files.count() == 6
    folders = lambda r: os.path.basename(os.path.dirname(r.file))
    got = {(folders(r), r.name, r.expected, r.actual, r.problem, r.n_rows) for r in R.drift_report(spark, folder, WANT).collect()}
    assert got == {("lacks+n", "n", "bigint", None, "missing", 5), ("int%n", "n", "bigint", "int", "type", 7), ("int%n", "more", None, "array<int>", "extra", 7), ("empty", "n", "bigint", "string", "type", 0),
                   ("foreign", "at", "timestamp_ntz", None, "missing", 1), ("foreign", "n", "bigint", "int64", "type", 1)}
    with open(f"{folder}/foreign/broken.parquet", "wb") as f:
        f.write(b"no parquet")
    broken = R.file_drift(R.file_columns(spark, folder), WANT).where("problem = 'unreadable'").collect()
    assert [os.path.basename(r.file) for r in broken] == ["broken.parquet"]


def test_many_files_are_read_by_many_tasks(spark, run_dir, monkeypatch):
    monkeypatch.setattr(R, "FILES_A_TASK", 4)
    folder = f"{run_dir}/{uuid.uuid4().hex}"
    spark.range(30).repartition(30).write.parquet(folder)
    files = R.file_columns(spark, folder)
    n = files.count()
    assert n > 8 and files.rdd.getNumPartitions() == -(-n // 4)
    assert R.file_drift(files, T.StructType([T.StructField("id", T.LongType())])).count() == 0
