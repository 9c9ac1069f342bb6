"""Schema drift of stored files: which files lack a column, have another one or give it another type.

A folder written under several schema versions can be read as one
(``ledger.read_conformed``) only while its types agree, and a merged read does
not tell a file without a column from one whose values are null.  This report
reads each file's own footer: files are listed by Spark (names, no content) and
dealt to tasks, which read a few kilobytes of each.  Spark writes its own schema
into the footer, so types are Spark's; for files of other writers they are Arrow's.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.paths import plain_path

FILES_A_TASK = 50


def file_columns(spark: SparkSession, folder: str) -> DataFrame:
    """(file, columns): name and type of every column of each Parquet file below ``folder``; columns is null where a footer cannot be read."""
    def run(batches):  # all that tasks need is in here: executors need not have this package
        import json

        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql import types as T

        schemes = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}

        def columns(uri: str):
            scheme, sign, rest = uri.partition("://")
            if sign:
                system, path = fs.FileSystem.from_uri(f"{schemes.get(scheme, scheme)}://{rest}")
            else:
                system, path = fs.LocalFileSystem(), uri.removeprefix("file:")
            try:
                with system.open_input_file(path) as f:
                    schema = pq.read_schema(f)
            except pa.ArrowInvalid:  # no Parquet file
                return None
            own = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
            if own:
                return [{"name": c.name, "type": c.dataType.simpleString()} for c in T.StructType.fromJson(json.loads(own)).fields]
            return [{"name": c.name, "type": str(c.type)} for c in schema]

        kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([columns(p) for p in paths], kind)], ["file", "columns"])

    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
              .select(F.col("path").alias("file")))
    tasks = max(1, -(-listed.count() // FILES_A_TASK))
    return listed.repartition(tasks).mapInArrow(run, "file string, columns array<struct<name: string, type: string>>")


def file_drift(files: DataFrame, schema: T.StructType) -> DataFrame:
    """(file, name, expected, actual, problem) of every column that is missing from a file, extra in it or of another type.

    A file whose footer cannot be read has one row, problem ``unreadable``.
    """
    want = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in schema.fields])
    row = lambda name, expected, actual, problem: F.struct(name.alias("name"), expected.alias("expected"), actual.alias("actual"), F.lit(problem).alias("problem"))
    nothing = F.lit(None).cast("string")
    found = lambda c: F.get(F.filter("columns", lambda h: h["name"] == c["name"]), 0)
    missing = F.transform(F.filter(want, lambda c: found(c).isNull()), lambda c: row(c["name"], c["type"], nothing, "missing"))
    other = F.transform(F.filter(want, lambda c: found(c)["type"] != c["type"]), lambda c: row(c["name"], c["type"], found(c)["type"], "type"))
    names = [f.name for f in schema.fields]
    extra = F.transform(F.filter("columns", lambda h: ~h["name"].isin(*names)), lambda h: row(h["name"], nothing, h["type"], "extra"))
    broken = F.array(row(nothing, nothing, nothing, "unreadable"))
    problems = F.when(F.col("columns").isNull(), broken).otherwise(F.concat(missing, other, extra))
    return files.select("file", F.explode(problems).alias("p")).select("file", "p.*")


def rows_by_file(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(file, n_rows) of the Parquet files below ``folder``; one string column is named and none is read."""
    rows = spark.read.schema(T.StructType([T.StructField(column, T.StringType())])).option("recursiveFileLookup", "true").parquet(folder)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def drift_report(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """file_drift() of a folder with the number of rows that each file holds."""
    rows = rows_by_file(spark, folder, schema.fieldNames()[0]).select(plain_path(F.col("file"), escaped=True).alias("_f"), "n_rows")
    drift = file_drift(file_columns(spark, folder), schema).withColumn("_f", plain_path(F.col("file")))
    return drift.join(rows, "_f", "left").drop("_f").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
