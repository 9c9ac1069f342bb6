"""Decisions: approval rows, upsert, revoke, log folding, history, time travel.

Without a table format that supports MERGE/UPDATE, the registry changes are
DataFrame algebra:

* upsert   = one ``groupBy(key)`` over target ∪ source, source rows rank higher
* revoke   = one ``groupBy(key)`` over target ∪ revokes, fields replaced where both met
* fold     = one ``groupBy(key)`` with ``max(struct(at, seq, …))`` per action —
  a mergeable aggregate, so map-side partial aggregation collapses hot keys
  before the shuffle and no group is ever materialised in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import midnight_as_written, trunc_seconds
from ..schemas import KEY, REGISTRY, REGISTRY_COLUMNS
from .neighbors import with_neighbor
from .validate import valid_decisions

ORDER = ["at", "seq"]


def _registry_row(cols: dict) -> list[Column]:
    """Registry columns in table order, carrying the table's column comments."""
    return [cols[c].alias(c, metadata=REGISTRY[c].metadata) for c in REGISTRY_COLUMNS]

_APPROVE_FIELDS = ["resource_name", "workspace_name", "resource_creator", "actor", "reason", "expiration_date"]
_REVOKE_FIELDS = ["actor", "reason"]


def approval_rows(valid_log: DataFrame) -> DataFrame:
    """Valid approve decisions as registry rows (plus their ``seq``/``at``).

    Expiration → midnight of the date as written; approval and update times
    truncated to seconds; approved with no revocation.
    """
    at = trunc_seconds(F.col("at"))
    return (valid_log.filter(F.col("action") == "approve")
            .select(
                "seq", "at",
                F.col("resource_name"), F.col("resource_id"), F.col("workspace_id"),
                F.col("workspace_name"), F.col("resource_creator"),
                F.col("actor").alias("approved_by"),
                at.alias("approval_date"),
                midnight_as_written(F.col("expiration_date")).alias("expiration_date"),
                F.col("reason").alias("justification"),
                F.lit(True).alias("is_approved"),
                F.lit(None).cast("timestamp_ntz").alias("revoked_date"),
                F.lit(None).cast("string").alias("revoked_by"),
                at.alias("updated_at"),
                F.lit(None).cast("string").alias("revoked_reason"),
            ))


def _latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last row per key by ``order`` — a max over a struct led by the order columns."""
    rest = [c for c in cols if c not in keys and c not in order]
    packed = F.max(F.struct(*[F.col(c) for c in list(order) + rest])).alias("_last")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in list(order) + rest])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str] = KEY,
           order: Sequence[str] = ORDER) -> DataFrame:
    """MERGE … WHEN MATCHED UPDATE * WHEN NOT MATCHED INSERT * on ``keys``.

    Source rows are full registry rows, so a match is a full replacement (a
    re-approval clears an earlier revocation).  Several source rows per key:
    the last by ``order`` wins, as if applied one after another.
    """
    rest = [c for c in REGISTRY_COLUMNS if c not in keys]
    stored = target.select(*keys, F.lit(0).alias("_rank"), *[F.lit(None).cast(source.schema[c].dataType).alias(f"_{c}") for c in order], *rest)
    new = source.select(*keys, F.lit(1).alias("_rank"), *[F.col(c).alias(f"_{c}") for c in order], *rest)
    last = (stored.unionByName(new).groupBy(*keys)
            .agg(F.max(F.struct("_rank", *[f"_{c}" for c in order], *rest)).alias("_last")))
    return last.select(*_registry_row({c: F.col(c) if c in keys else F.col(f"_last.{c}") for c in REGISTRY_COLUMNS}))


def latest_revokes(valid_log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    revokes = valid_log.filter(F.col("action") == "revoke")
    return _latest(revokes, keys, ORDER, list(keys) + _REVOKE_FIELDS)


def apply_revokes(target: DataFrame, valid_log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """UPDATE … SET is_approved=false, revoked_* WHERE key matches (last revoke wins).

    Keys without a registry row are a silent no-op, as in the reference (see
    ``unmatched_revokes``).  Other fields are kept.
    """
    rest = [c for c in REGISTRY_COLUMNS if c not in keys]
    row, hit = F.struct(*rest), F.struct(trunc_seconds(F.col("at")).alias("_at"), F.col("seq").alias("_seq"), F.col("actor").alias("_by"), F.col("reason").alias("_reason"))
    stored = target.select(*keys, row.alias("_row"))
    # ordered by the exact time and seq; the time kept is truncated
    revokes = (valid_log.filter(F.col("action") == "revoke")
               .select(*keys, F.struct(F.col("at"), F.col("seq"), hit.alias("hit")).alias("_revoke")))
    met = (stored.unionByName(revokes, allowMissingColumns=True).groupBy(*keys)
           .agg(F.max("_row").alias("_row"), F.max("_revoke").alias("_revoke")).filter(F.col("_row").isNotNull()))
    found, r = F.col("_revoke").isNotNull(), F.col("_revoke")["hit"]
    replaced = {"is_approved": F.lit(False), "revoked_date": r["_at"], "revoked_by": r["_by"], "revoked_reason": r["_reason"], "updated_at": r["_at"]}
    cols = {c: F.col(c) if c in keys else F.col(f"_row.{c}") for c in REGISTRY_COLUMNS}
    cols |= {c: F.when(found, v).otherwise(cols[c]) for c, v in replaced.items()}
    return met.select(*_registry_row(cols))


def unmatched_revokes(target: DataFrame, valid_log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Revocations whose key has no registry row (the reference reports success for them)."""
    revokes = valid_log.filter(F.col("action") == "revoke")
    return revokes.join(target.select(*keys), list(keys), "left_anti")


def fold_state(valid_log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per key: the last approve and the last revoke, each with its (at, seq).

    The state is closed under merging — folding (state ∪ new decisions) again
    gives the state of the longer log — which is what incremental and
    streaming maintenance use.
    """
    is_approve = F.col("action") == "approve"
    is_revoke = F.col("action") == "revoke"
    approve = F.struct(*[F.col(c) for c in ORDER + _APPROVE_FIELDS])
    revoke = F.struct(*[F.col(c) for c in ORDER + _REVOKE_FIELDS])
    return (valid_log.groupBy(*keys)
            .agg(F.max(F.when(is_approve, approve)).alias("last_approve"),
                 F.max(F.when(is_revoke, revoke)).alias("last_revoke")))


def merge_states(*states: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Combine fold states (e.g. stored registry state and a new batch's state)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return (out.groupBy(*keys)
            .agg(F.max("last_approve").alias("last_approve"), F.max("last_revoke").alias("last_revoke")))


def registry_from_state(state: DataFrame) -> DataFrame:
    """Registry rows from a fold state; keys never approved produce no row."""
    a = F.col("last_approve")
    r = F.col("last_revoke")
    later = r.isNotNull() & ((r["at"] > a["at"]) | ((r["at"] == a["at"]) & (r["seq"] > a["seq"])))
    a_at = trunc_seconds(a["at"])
    r_at = trunc_seconds(r["at"])
    cols = {
        "resource_name": a["resource_name"],
        "resource_id": F.col("resource_id"),
        "workspace_id": F.col("workspace_id"),
        "workspace_name": a["workspace_name"],
        "resource_creator": a["resource_creator"],
        "approved_by": a["actor"],
        "approval_date": a_at,
        "expiration_date": midnight_as_written(a["expiration_date"]),
        "justification": a["reason"],
        "is_approved": ~later,
        "revoked_date": F.when(later, r_at),
        "revoked_by": F.when(later, r["actor"]),
        "updated_at": F.when(later, r_at).otherwise(a_at),
        "revoked_reason": F.when(later, r["reason"]),
    }
    return state.filter(a.isNotNull()).select(*_registry_row(cols))


def fold(log: DataFrame, keys: Sequence[str] = KEY, validate: bool = True) -> DataFrame:
    """Registry equal to replaying the decision log in (at, seq) order."""
    valid = valid_decisions(log) if validate else log
    return registry_from_state(fold_state(valid, keys))


def registry_as_of(log: DataFrame, ts: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Time travel: the registry as it stood at ``ts`` (decisions at or before it)."""
    return fold(log.filter(F.col("at") <= ts), keys)


def history(log: DataFrame, keys: Sequence[str] = KEY, partitions: int | None = None) -> DataFrame:
    """Every valid decision with its validity interval [valid_from, valid_to).

    ``valid_to`` is the time of the key's next decision (null while current);
    computed with the range-partitioned neighbour operator, so a hot key is
    spread over many tasks.
    """
    valid = valid_decisions(log).select("seq", "at", "action", *keys, "actor", "reason")
    nxt = with_neighbor(valid, keys, ORDER, ["at", "seq"], "next", prefix="next_", partitions=partitions)
    return nxt.select("seq", *keys, "action", "actor", "reason",
                      F.col("at").alias("valid_from"), F.col("next_at").alias("valid_to"),
                      F.col("next_seq"))
