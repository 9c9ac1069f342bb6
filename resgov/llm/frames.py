"""Helpers on DataFrames: tables in the shared folder, batch sizes, connected components."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, shared_dir

BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The library's session settings, and Arrow batches small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, *taken) -> str:
    """``name``, with underscores before it as long as one of the columns ``taken`` has it (case counts for nothing)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def sent(spark: SparkSession, model):
    """Broadcast a fitted model; the function returned gives it back inside a task.

    A Python worker keeps a broadcast's value between tasks, so the model (and
    what it caches) is unpickled once a worker, not once a task.
    """
    held = spark.sparkContext.broadcast({"raw": cloudpickle.dumps(model)})

    def get():
        value = held.value
        if "model" not in value:
            value["model"] = pickle.loads(value["raw"])
        return value["model"]

    return get


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, label): label is the smallest node reachable over the undirected edges (a, b).

    Minimum labels spread to neighbours, then each label is replaced by its own
    label, so paths shorten at every round and rounds grow with the logarithm of
    the longest path.  Each round is a written table.  Hubs are met by partial
    aggregation (min) and by skew splitting of the joins.
    Empty edges give an empty result; self-loops and repeats change nothing.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near")))
        spread = (labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        stepped = written(spread.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("old")), "labels")
        changed = stepped.where("label <> old").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
