"""As-of lookup: for each question, the last fact of its key at or before its time.

A join on ``fact.at <= question.at`` pairs every question with all earlier
facts of its key, and a window per key puts a hot key into one task.  Here
questions and facts are united, range-partitioned on (key, time, side, ...) (a
hot key is cut over several partitions), sorted, and cut into numbered pieces of
at most ``PIECE_ROWS`` rows in a written table, so that all later steps see the
same cuts.  Within a piece the last fact so far is carried forward; what a piece
takes over from the ones before is a running last value over one row a piece.
The only joins are on the piece's number, against that table.

Pieces are dealt by range to about one task each, so the rows that a task sorts
and holds do not grow with the input.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_dir

# Rows of a piece, a power of two.
PIECE_ROWS = 1 << 18


def timeline(questions: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fact_at: str,
             order: Sequence[str], values: Sequence[str], partitions: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Both sides in order of key and time, with the number of their piece of a range partition (a written table).

    ``_row`` numbers the rows in their order, ``_part`` rises with it; a piece has at most ``piece_rows`` rows (a power of two, 2 ** 33 at most).
    ``_q`` holds a question's row, ``_f`` a fact's key and values.  At equal times facts come first, in ``order``.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    usable = F.col(fact_at).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    q = questions.select(*own, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"),
                         F.struct(*questions.columns).alias("_q"))
    f = facts.filter(usable).select(*own, F.col(fact_at).alias("_at"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                                    F.struct(*own, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]).alias("_f"))
    both = f.unionByName(q, allowMissingColumns=True)
    sort = [*names, "_at", "_side", *[f"_o{i}" for i in range(len(order))], "_tie"]
    ranged = both.repartitionByRange(partitions, *sort) if partitions else both.repartitionByRange(*sort)
    spark = questions.sparkSession
    path = shared_dir(spark, f"timeline-{uuid.uuid4().hex}")
    # the id is the partition's number times 2 ** 33 and the row's place in the sorted partition
    row = ranged.sortWithinPartitions(*sort).withColumn("_row", F.monotonically_increasing_id())
    row.withColumn("_part", F.shiftright("_row", piece_rows.bit_length() - 1)).write.parquet(path)
    return spark.read.parquet(path).select("_part", "_row", *sort, "_q", "_f")


def as_of(questions: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fact_at: str, order: Sequence[str],
          values: Sequence[str], prefix: str = "", partitions: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The questions with ``{prefix}{v}`` for each value of the fact that holds at their time.

    Of facts with equal times the last by ``order`` holds.  Questions before the first fact of their key, with a null
    key or a null time, get nulls; facts with a null key or time hold nowhere; every question stays once.
    """
    rows = timeline(questions, facts, keys, at, fact_at, order, values, partitions, piece_rows)
    names = [c for c in rows.columns if c.startswith("_k")]
    facts_only = rows.filter(F.col("_f").isNotNull())
    last = rows.groupBy("_part").agg(F.max(F.when(F.col("_f").isNotNull(), F.col("_row"))).alias("_row"))
    found = facts_only.select("_part", "_row", F.col("_f").alias("_last")).join(F.broadcast(last.select("_row")), "_row", "left_semi").select("_part", "_last")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    taken_over = last.select("_part").join(F.broadcast(found), "_part", "left").select("_part", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    pieces = max(1, rows.select("_part").distinct().count())
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.select("_part", "_row", *names, "_at", "_q", "_f").repartitionByRange(pieces, "_part")
    carried = dealt.withColumn("_now", F.last("_f", ignorenulls=True).over(within)).filter(F.col("_q").isNotNull())
    # one row a piece
    held = carried.join(F.broadcast(taken_over), "_part").withColumn("_held", F.coalesce("_now", "_before"))
    same = F.col("_at").isNotNull()
    for n in names:
        same = same & F.coalesce(F.col(n) == F.col(f"_held.{n}"), F.lit(False))
    return held.select(*[F.col(f"_q.`{c}`").alias(c) for c in questions.columns],
                       *[F.when(same, F.col(f"_held._v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)])
