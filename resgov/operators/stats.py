"""Approval statistics.  Every aggregate is partial-aggregated map-side, so a
type or workspace holding most rows costs one combined row per task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import MONITORED_TYPES


def known_types(inventory: DataFrame, types: Sequence[str] = MONITORED_TYPES) -> DataFrame:
    """Rows of the monitored types; other types belong to no section and no total."""
    return inventory.filter(F.col("type").isin(list(types)))


def _counts(status: DataFrame):
    return [F.count(F.lit(1)).alias("total"),
            F.count_if(F.coalesce(F.col("is_approved"), F.lit(False))).alias("approved")]


def stats_by_type(status: DataFrame, types: Sequence[str] = MONITORED_TYPES) -> DataFrame:
    """total / approved / unapproved per monitored type; all types present even when 0.

    One global conditional aggregate (partial per task, a single tiny final
    merge) unpivoted into one row per type: no grouped shuffle and no join,
    whatever the share of rows a type holds.
    """
    approved = F.coalesce(F.col("is_approved"), F.lit(False))
    aggs = []
    for i, t in enumerate(types):
        aggs += [F.count_if(F.col("type") == t).alias(f"_t{i}"),
                 F.count_if((F.col("type") == t) & approved).alias(f"_a{i}")]
    one = status.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("type"), F.col(f"_t{i}").cast("long").alias("total"),
                 F.col(f"_a{i}").cast("long").alias("approved"), F.lit(i).alias("type_order"))
        for i, t in enumerate(types)]))
    return (one.select(rows.alias("_r"))
            .select("_r.type", "_r.total", "_r.approved", (F.col("_r.total") - F.col("_r.approved")).alias("unapproved"),
                    "_r.type_order"))


def stats_overall(status: DataFrame, types: Sequence[str] = MONITORED_TYPES) -> DataFrame:
    """Totals over the monitored types and the approval rate in percent (1 decimal, 0 when empty)."""
    agg = known_types(status, types).agg(*_counts(status))
    rate = F.when(F.col("total") > 0, F.round(F.col("approved") / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return agg.select(F.col("total").cast("long").alias("total"), F.col("approved").cast("long").alias("approved"),
                      (F.col("total") - F.col("approved")).cast("long").alias("unapproved"),
                      rate.alias("approval_rate"))


def stats_rollup(status: DataFrame) -> DataFrame:
    """Cross-workspace report: (workspace, type), per workspace, and grand total."""
    return (status.rollup("workspace_name", "type")
            .agg(*_counts(status), F.grouping_id().alias("level")))


def section_counts(status: DataFrame, types: Sequence[str] = MONITORED_TYPES) -> DataFrame:
    """Visible sections of the listing: monitored types with at least one row."""
    return stats_by_type(status, types).filter(F.col("total") > 0).select("type", "total")


def resource_counts(inventory: DataFrame) -> DataFrame:
    """Number of resources a refresh reports."""
    return inventory.agg(F.count(F.lit(1)).alias("n_resources"))
