"""Per-row labels the listing shows next to each resource."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values shown by the listing.
RUNNING_STATES = ["RUNNING", "READY", "ACTIVE", "ONLINE"]
STOPPED_STATES = ["STOPPED", "READ_ONLY"]
TYPE_LABELS = {
    "serving_endpoint": "Model Serving Endpoint",
    "vector_search": "Vector Search Endpoint",
    "postgres": "Lakehouse Postgres",
}
DEFAULT_TYPE_LABEL = "Databricks App"
SYSTEM_APPROVER = "system"
SYSTEM_APPROVER_LABEL = "System (Foundation Model)"
SOON_SECONDS = 7 * 24 * 60 * 60
ALREADY_EXISTS_MARKERS = ["ALREADY_EXISTS", "FIELD_ALREADY_EXISTS", "already exists"]
NOT_FOUND_MARKERS = ["not found", "does not exist", "table_or_view_not_found"]
EXPECTED_MARKERS = ["ALREADY_EXISTS", "FIELD_ALREADY_EXISTS", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND"]


def state_class(state: Column) -> Column:
    """running / stopped / unknown from a free-text state (case-insensitive)."""
    up = F.upper(state)
    return (F.when(up.isin(RUNNING_STATES), "running")
            .when(up.isin(STOPPED_STATES), "stopped")
            .otherwise("unknown"))


def type_label(type_col: Column) -> Column:
    """Display label of a resource type; unknown types get the app label."""
    lookup = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(lookup, type_col), F.lit(DEFAULT_TYPE_LABEL))


def card_class(approved: Column, foundation: Column) -> Column:
    return (F.when(approved & foundation, "auto-approved")
            .when(approved, "approved")
            .otherwise("unapproved"))


def approver_label(approved_by: Column) -> Column:
    return F.when(approved_by == SYSTEM_APPROVER, SYSTEM_APPROVER_LABEL).otherwise(approved_by)


def expiry_flag(expiration: Column, as_of: Column, soon_days: int = 7) -> Column:
    """``expired`` / ``soon`` / null.  Soon is strictly less than N days ahead."""
    delta = F.unix_micros(expiration.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    soon = F.lit(soon_days * 86_400 * 1_000_000)
    return (F.when(expiration < as_of, "expired")
            .when(delta < soon, "soon"))


def expiry_warning(expiration: Column, as_of: Column) -> Column:
    """True when a requested expiry date lies before the as-of day (a hint, never a reject)."""
    return F.to_date(expiration) < F.to_date(as_of)


def error_class(message: Column) -> Column:
    """already_exists (case-sensitive) / not_found (lower-cased) / other; null when no error."""
    lowered = F.lower(message)
    exists = None
    for marker in ALREADY_EXISTS_MARKERS:
        term = message.contains(marker)
        exists = term if exists is None else exists | term
    missing = None
    for marker in NOT_FOUND_MARKERS:
        term = lowered.contains(marker)
        missing = term if missing is None else missing | term
    return (F.when(message.isNull(), F.lit(None).cast("string"))
            .when(exists, "already_exists")
            .when(missing, "not_found")
            .otherwise("other"))


def expected_error(message: Column) -> Column:
    """True when an error is one the executor treats as expected (logged, not
    alarmed): its text contains one of the expected markers (case-sensitive)."""
    hit = F.lit(False)
    for marker in EXPECTED_MARKERS:
        hit = hit | message.contains(marker)
    return F.when(message.isNotNull(), F.coalesce(hit, F.lit(False)))


def row_key(resource_id: Column, workspace_id: Column) -> Column:
    """``resource_id-workspace_id`` as the listing keys its rows."""
    return F.concat_ws("-", resource_id, workspace_id)


def date_label(ts: Column, with_time: bool = False) -> Column:
    """``MMM dd, yyyy`` (optionally ``HH:mm``); null when there is no date."""
    return F.date_format(ts, "MMM dd, yyyy HH:mm" if with_time else "MMM dd, yyyy")
