"""Approval status of inventory rows (active scan, status join, lookups, card view)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import (approver_label, card_class, date_label, expiry_flag, row_key,
                                state_class, type_label)
from ..schemas import ACTIVE_COLUMNS, KEY, STATUS_COLUMNS

# The automatic approval given to foundation models.
SYSTEM_APPROVER = "system"
FOUNDATION_JUSTIFICATION = "Automatically approved - Databricks Foundation Model"
APPROVAL_FIELDS = ["is_approved", "approval_date", "approved_by", "expiration_date", "justification"]
LOOKUP_PRIORITY = {"app": 0, "serving_endpoint": 1}


def filter_workspace(df: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Optional workspace filter; None or '' means all workspaces."""
    return df.filter(F.col("workspace_id") == workspace_id) if workspace_id else df


def active_approvals(registry: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Approved and not revoked (expired rows stay: expiry is applied by the status join)."""
    act = registry.filter((F.col("is_approved") == F.lit(True)) & F.col("revoked_date").isNull())
    return filter_workspace(act, workspace_id).select(*ACTIVE_COLUMNS)


def drop_approval_columns(inventory: DataFrame) -> DataFrame:
    return inventory.drop(*[c for c in APPROVAL_FIELDS if c in inventory.columns])


def not_expired(expiration: Column, as_of: Column) -> Column:
    """Still valid at ``as_of``: no expiry, or expiry at/after it (strictly earlier expires)."""
    return expiration.isNull() | (expiration >= as_of)


def resource_status(inventory: DataFrame, registry: DataFrame, as_of: Column,
                    workspace_id: str | None = None, on: Sequence[str] = KEY) -> DataFrame:
    """Inventory ⟕ active approvals on (resource_id, workspace_id), or on a column that stands for both.

    Foundation models are approved by ``system`` at ``as_of`` with no expiry,
    whatever the registry says; others are approved when an active approval
    exists and has not expired.  Approval columns are null unless approved.
    Every inventory row is kept once (the registry holds one row per key).
    Join strategy (broadcast vs shuffle) is left to AQE's runtime sizes.
    """
    inv = filter_workspace(drop_approval_columns(inventory), workspace_id)
    act = (filter_workspace(registry.filter((F.col("is_approved") == F.lit(True)) & F.col("revoked_date").isNull()), workspace_id)
           .select(*on, F.lit(True).alias("_match"),
                   F.col("approval_date").alias("_date"), F.col("approved_by").alias("_by"),
                   F.col("expiration_date").alias("_exp"), F.col("justification").alias("_why")))
    j = inv.join(act, list(on), "left")
    fm = F.coalesce(F.col("is_foundation_model"), F.lit(False))
    live = F.coalesce(F.col("_match"), F.lit(False)) & not_expired(F.col("_exp"), as_of)
    out = {
        "is_foundation_model": fm,
        "is_approved": fm | live,
        "approval_date": F.when(fm, as_of).when(live, F.col("_date")),
        "approved_by": F.when(fm, F.lit(SYSTEM_APPROVER)).when(live, F.col("_by")),
        "expiration_date": F.when(fm, F.lit(None).cast("timestamp_ntz")).when(live, F.col("_exp")),
        "justification": F.when(fm, F.lit(FOUNDATION_JUSTIFICATION)).when(live, F.col("_why")),
    }
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in STATUS_COLUMNS])


def approved_only(inventory: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Approved resources only: inventory ⋈ live approvals ∪ foundation rows.

    A filter on the derived status cannot pass below an outer join; this path
    uses an inner join so the (small, active) registry side prunes the inventory.
    """
    fm = F.coalesce(F.col("is_foundation_model"), F.lit(False))
    inv = drop_approval_columns(inventory)
    live = (active_approvals(registry).filter(not_expired(F.col("expiration_date"), as_of))
            .select(*KEY, "approval_date", "approved_by", "expiration_date", "justification"))
    regular = (inv.filter(~fm).join(live, KEY, "inner")
               .withColumn("is_approved", F.lit(True)).withColumn("is_foundation_model", F.lit(False)))
    found = (inv.filter(fm).select(
        *[c for c in inv.columns if c != "is_foundation_model"],
        F.lit(True).alias("is_foundation_model"), F.lit(True).alias("is_approved"),
        as_of.alias("approval_date"), F.lit(SYSTEM_APPROVER).alias("approved_by"),
        F.lit(None).cast("timestamp_ntz").alias("expiration_date"),
        F.lit(FOUNDATION_JUSTIFICATION).alias("justification")))
    return regular.select(*STATUS_COLUMNS).unionByName(found.select(*STATUS_COLUMNS))


def check_approved(keys: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Batch form of the single-key approval check: (key, approved, details or nulls)."""
    act = active_approvals(registry).select(
        *KEY, F.lit(True).alias("_match"), "approved_by", "approval_date", "expiration_date", "justification")
    j = keys.select(*KEY).join(act, KEY, "left")
    ok = F.coalesce(F.col("_match"), F.lit(False)) & not_expired(F.col("expiration_date"), as_of)
    return j.select(*KEY, ok.alias("is_approved"),
                    *[F.when(ok, F.col(c)).alias(c)
                      for c in ["approved_by", "approval_date", "expiration_date", "justification"]])


def lookup_by_name(names: DataFrame, inventory: DataFrame) -> DataFrame:
    """Resource details by name: an app first, else a serving endpoint, else not found.

    Candidates are reduced to one per name with a mergeable ``min_by`` before
    joining the requested names, so a popular name cannot skew the join.
    """
    prio = F.when(F.col("type") == "app", 0).when(F.col("type") == "serving_endpoint", 1)
    fields = ["resource_id", "workspace_id", "workspace_name", "type", "state", "creator", "description"]
    best = (inventory.filter(prio.isNotNull())
            .groupBy("name")
            .agg(F.min_by(F.struct(*fields), F.struct(prio, F.col("workspace_id"), F.col("resource_id")))
                 .alias("_hit")))
    j = names.select("name").join(best, "name", "left")
    return j.select("name", F.col("_hit").isNotNull().alias("found"),
                    *[F.col(f"_hit.{c}").alias(c) for c in fields])


def listing_header(status: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Header of a listing: workspace id (or ``current``) and the first row's
    workspace name (or ``Unknown``); first = feed order, then resource id."""
    order = (F.when(F.col("type") == "app", 0).when(F.col("type") == "serving_endpoint", 1)
             .when(F.col("type") == "vector_search", 2).when(F.col("type") == "postgres", 3).otherwise(4))
    rows = filter_workspace(status, workspace_id)
    first = rows.agg(F.min_by("workspace_name", F.struct(order, F.col("resource_id"), F.col("workspace_id")))
                     .alias("_first"), F.count(F.lit(1)).alias("n_resources"))
    return first.select(F.lit(workspace_id or "current").alias("workspace_id"),
                        F.coalesce("_first", F.lit("Unknown")).alias("workspace_name"), "n_resources")


def card_view(status: DataFrame, as_of: Column) -> DataFrame:
    """What each resource card shows: key, labels, classes and expiry flag."""
    return status.select(
        row_key(F.col("resource_id"), F.col("workspace_id")).alias("row_key"),
        "name", "type",
        type_label(F.col("type")).alias("type_label"),
        state_class(F.col("state")).alias("state_class"),
        card_class(F.col("is_approved"), F.col("is_foundation_model")).alias("card_class"),
        approver_label(F.col("approved_by")).alias("approver_label"),
        expiry_flag(F.col("expiration_date"), as_of).alias("expiry_flag"),
        date_label(F.col("approval_date")).alias("approval_date_label"),
        date_label(F.col("expiration_date"), with_time=True).alias("expiration_date_label"),
    )


def expiring(registry: DataFrame, as_of: Column, soon_days: int = 7) -> DataFrame:
    """Active approvals that have expired or expire within ``soon_days``."""
    flag = expiry_flag(F.col("expiration_date"), as_of, soon_days)
    return (active_approvals(registry).select(*KEY, "resource_name", "expiration_date", flag.alias("expiry_flag"))
            .filter(F.col("expiry_flag").isNotNull()))


def recent_approvals(registry: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Registry rows approved strictly after the start of ``as_of``'s day minus ``days``."""
    cutoff = F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")
    return registry.filter(F.col("approval_date") > cutoff)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Row keys that occur more than once (the listing would collide on them)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1)
            .select(row_key(F.col(keys[0]), F.col(keys[1])).alias("row_key"), *keys, "n"))
