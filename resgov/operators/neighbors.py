"""Next / previous row within ordered groups, without one task per group.

``Window.partitionBy(key)`` sends a whole group to one task, so a key holding
a third of all rows would serialise a third of the job.  Here the rows are
range-partitioned on (key, order…) — a hot key is cut across several balanced
partitions — and sorted inside each partition.  The first row of every
partition (found with ``monotonically_increasing_id``, whose low 33 bits
count rows within the partition) is copied once into the preceding partition
as a sentinel that sorts after all of that partition's rows; one window over
(partition, order) then yields each row's successor, including across
partition edges.  The plan is a single line of operators (one range exchange,
one hash exchange), so every branch sees the same partition boundaries.

Order columns should make rows unique within a key (e.g. end with a sequence
number): range partitioning cannot split rows whose whole sort key is equal.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROW_BITS = 33


def _same(keys: Sequence[str], other: Column) -> Column:
    cond = other.isNotNull()
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(other[k])
    return cond


def with_neighbor(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  direction: str = "next", prefix: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Add ``{prefix}{v}`` for each v in ``values``: the value on the next (or
    previous) row of the same ``keys`` group ordered by ``order``; null at the
    group's end."""
    if direction not in ("next", "prev"):
        raise ValueError("direction must be 'next' or 'prev'")
    prefix = prefix if prefix is not None else f"{direction}_"
    sort_cols = list(keys) + list(order)
    forward = direction == "next"
    # the edge row of a partition is its first row (for next) or its last (for prev)
    local_order = [F.col(c).asc_nulls_first() if forward else F.col(c).desc_nulls_last() for c in sort_cols]
    range_cols = [F.col(c).asc_nulls_first() for c in sort_cols]
    # without an explicit count AQE sizes the range partitions from runtime bytes
    ranged = ((df.repartitionByRange(partitions, *range_cols) if partitions else df.repartitionByRange(*range_cols))
              .sortWithinPartitions(*local_order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), _ROW_BITS)
    is_edge = (F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))) == 0
    target = pid - 1 if forward else pid + 1
    kind = 1 if forward else -1
    copies = F.array(F.struct(pid.alias("tpid"), F.lit(0).alias("kind")),
                     F.when(is_edge, F.struct(target.alias("tpid"), F.lit(kind).alias("kind"))))
    spread = (ranged.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
              .withColumn("_tpid", F.col("_copy.tpid")).withColumn("_kind", F.col("_copy.kind")))
    packed = F.struct(*[F.col(c) for c in dict.fromkeys(list(keys) + list(values))])
    w = Window.partitionBy("_tpid").orderBy(F.col("_kind"), *[F.col(c).asc_nulls_first() for c in sort_cols])
    step = F.lead if forward else F.lag
    near = spread.withColumn("_near", step(packed).over(w)).filter(F.col("_kind") == 0)
    pick = F.when(_same(keys, F.col("_near")), F.col("_near"))
    return near.select(*df.columns, *[pick[v].alias(f"{prefix}{v}") for v in values])
