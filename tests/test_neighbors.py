import random

import pandas as pd
from pyspark.sql import functions as F

from resgov.operators.neighbors import with_neighbor


def brute(rows, direction):
    df = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
    df["nb"] = df.groupby("k")["v"].shift(-1 if direction == "next" else 1)
    return {(r.k, r.t): (None if pd.isna(r.nb) else int(r.nb)) for r in df.itertuples()}


def test_hot_key_across_partitions(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"        # a third of all rows on one key
        rows.append((k, i, rng.randrange(10_000)))
    df = spark.createDataFrame(rows, "k string, t long, v long")
    for direction in ("next", "prev"):
        out = with_neighbor(df, ["k"], ["t"], ["v"], direction, prefix="nb_", partitions=7)
        got = {(r.k, r.t): r.nb_v for r in out.collect()}
        assert got == brute(rows, direction)
    # the hot key really is spread over several tasks
    spread = (df.repartitionByRange(7, "k", "t").withColumn("p", F.spark_partition_id())
              .filter(F.col("k") == "hot").select("p").distinct().count())
    assert spread > 1
