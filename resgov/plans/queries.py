"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame
built from the driver tables through ``sources.fixtures``.  The as-of clock
is one literal per query (``fixtures.AS_OF``), so plans are deterministic."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.times import midnight_as_written, ntz
from ..operators import asof as O
from ..operators import decisions as D
from ..operators import drift as R
from ..operators import layout as W
from ..operators import ledger as L
from ..operators import snapshots as K
from ..operators import stats as A
from ..operators import status as J
from ..operators import validate as V
from ..schemas import LEDGER
from ..schemas import REGISTRY as REGISTRY_SCHEMA
from ..session import configure, shared_dir
from ..sources import feeds as S
from ..sources import fixtures as X
from ..sources import decode as C
from ..sources.decode import decode_result
from ..sources.tables import table
from ..functions.foundation import is_foundation, endpoint_description
from ..functions.labels import state_class

Query = Callable[[SparkSession, str], DataFrame]
WORKSPACE = "7"
# Buckets of the stored tables; on a cluster about the table's size over 128 MB.
BUCKETS = 8
# Columns that tell the fixture's ledger rows apart.
IDS = ("tie1", "tie2")
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


# ---------------------------------------------------------------- shared inputs

def registry(spark, sf) -> DataFrame:
    return D.fold(X.decision_log(spark, sf))


def status(spark, sf) -> DataFrame:
    return J.resource_status(X.inventory(spark, sf), registry(spark, sf), X.as_of())


def feed_inventory(spark, sf) -> DataFrame:
    return S.union_inventory(
        S.normalise_apps(X.apps_raw(spark, sf)),
        S.normalise_endpoints(X.endpoints_raw(spark, sf), X.FIXTURE_PREFIXES),
        S.normalise_vector_search(X.vector_raw(spark, sf)),
        S.normalise_databases(X.databases_raw(spark, sf)))


def _before_cut(spark, sf):
    return X.decision_log(spark, sf).filter(F.col("at") < ntz(X.CUT))


def _after_cut_valid(spark, sf):
    return V.valid_decisions(X.decision_log(spark, sf).filter(F.col("at") >= ntz(X.CUT)))


# ---------------------------------------------------------------- status & stats

@query
def resource_status(spark, sf):
    """Every inventory row with its effective approval."""
    return status(spark, sf)


@query
def status_by_workspace(spark, sf):
    """F1 + J1 for one workspace."""
    return J.resource_status(X.inventory(spark, sf), registry(spark, sf), X.as_of(), WORKSPACE)


@query
def approved_only(spark, sf):
    """J1 restricted to approved rows via the inner-join path."""
    return J.approved_only(X.inventory(spark, sf), registry(spark, sf), X.as_of())


@query
def stats_by_type(spark, sf):
    """A1: total / approved / unapproved per monitored type."""
    return A.stats_by_type(status(spark, sf)).drop("type_order")


@query
def stats_overall(spark, sf):
    """A2: totals and approval rate over the monitored types."""
    return A.stats_overall(status(spark, sf))


@query
def stats_rollup(spark, sf):
    """A3: rollup over (workspace, type)."""
    return A.stats_rollup(status(spark, sf))


@query
def section_counts(spark, sf):
    """Non-empty sections."""
    return A.section_counts(status(spark, sf))


@query
def resource_counts(spark, sf):
    """A4: inventory size of a refresh."""
    return A.resource_counts(feed_inventory(spark, sf))


@query
def active_approvals(spark, sf):
    """Approved and not revoked."""
    return J.active_approvals(registry(spark, sf))


@query
def active_approvals_by_workspace(spark, sf):
    """S1 with the workspace filter."""
    return J.active_approvals(registry(spark, sf), WORKSPACE)


@query
def check_approved(spark, sf):
    """Batch approval check; every other key asks for the wrong workspace."""
    c = table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").cast("string").alias("resource_id"),
                    ((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).cast("string").alias("workspace_id"))
    return J.check_approved(keys, registry(spark, sf), X.as_of())


@query
def lookup_by_name(spark, sf):
    """Detail lookup by name (app first, then serving endpoint)."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return J.lookup_by_name(names, X.inventory(spark, sf))


@query
def listing_header(spark, sf):
    """Listing header: workspace id or 'current', first row's workspace name."""
    return J.listing_header(status(spark, sf))


@query
def card_view(spark, sf):
    """Card labels and classes per resource."""
    return J.card_view(status(spark, sf), X.as_of())


@query
def state_classes(spark, sf):
    """state class per feed resource."""
    inv = feed_inventory(spark, sf)
    return inv.select("type", "resource_id", "workspace_id", "state", state_class(F.col("state")).alias("state_class"))


@query
def expiring_soon(spark, sf):
    """active approvals expired or expiring within 7 days of as_of."""
    return J.expiring(registry(spark, sf), X.as_of())


@query
def recent_approvals(spark, sf):
    """approvals within the last 7 days before as_of."""
    return J.recent_approvals(registry(spark, sf), X.as_of())


@query
def duplicate_keys(spark, sf):
    """listing keys occurring more than once in the feed inventory."""
    return J.duplicate_keys(feed_inventory(spark, sf))


# ---------------------------------------------------------------- decisions

@query
def approve_rejects(spark, sf):
    """rejected approve decisions with their first error."""
    rej = V.rejected_decisions(X.decision_log(spark, sf))
    return rej.filter(F.col("action") == "approve").select("seq", "resource_id", "workspace_id", "error")


@query
def revoke_rejects(spark, sf):
    """F8: rejected revoke decisions with their first error."""
    rej = V.rejected_decisions(X.decision_log(spark, sf))
    return rej.filter(F.col("action") == "revoke").select("seq", "resource_id", "workspace_id", "error")


@query
def expiry_warnings(spark, sf):
    """approvals asking for an expiry before the as-of day."""
    return V.expiry_warnings(X.decision_log(spark, sf), X.as_of())


@query
def approval_rows(spark, sf):
    """Valid approvals normalised to registry rows."""
    return D.approval_rows(V.valid_decisions(X.decision_log(spark, sf))).drop("at")


@query
def registry_fold(spark, sf):
    """Registry from folding the whole decision log."""
    return registry(spark, sf)


@query
def upsert_registry(spark, sf):
    """Registry before the cut, upserted with the later approvals."""
    target = D.fold(_before_cut(spark, sf))
    return D.upsert(target, D.approval_rows(_after_cut_valid(spark, sf)))


@query
def revoke_registry(spark, sf):
    """D3: registry before the cut with the later revocations applied."""
    target = D.fold(_before_cut(spark, sf))
    return D.apply_revokes(target, _after_cut_valid(spark, sf))


@query
def unmatched_revokes(spark, sf):
    """Later revocations that match no registry row."""
    target = D.fold(_before_cut(spark, sf))
    return D.unmatched_revokes(target, _after_cut_valid(spark, sf)).select("seq", "resource_id", "workspace_id")


@query
def decision_history(spark, sf):
    """Every valid decision with its validity interval."""
    return D.history(X.decision_log(spark, sf))


@query
def registry_as_of(spark, sf):
    """K4: time travel to TRAVEL_TO by folding the log up to it."""
    return D.registry_as_of(X.decision_log(spark, sf), ntz(X.TRAVEL_TO))


# ---------------------------------------------------------------- feeds

@query
def feed_apps(spark, sf):
    """Apps feed normalised."""
    return S.normalise_apps(X.apps_raw(spark, sf))


@query
def feed_endpoints(spark, sf):
    """S3: serving-endpoint feed normalised."""
    return S.normalise_endpoints(X.endpoints_raw(spark, sf), X.FIXTURE_PREFIXES)


@query
def feed_vector_search(spark, sf):
    """Vector-search feed normalised."""
    return S.normalise_vector_search(X.vector_raw(spark, sf))


@query
def feed_databases(spark, sf):
    """Database-instance feed normalised."""
    return S.normalise_databases(X.databases_raw(spark, sf))


@query
def inventory_union(spark, sf):
    """The four feeds as one inventory."""
    return feed_inventory(spark, sf)


@query
def feed_health(spark, sf):
    """A5: rows per feed and incomplete rows."""
    return S.feed_health(feed_inventory(spark, sf))


@query
def inventory_landed(spark, sf):
    """The inventory parsed from landed JSON text, without its unreadable lines."""
    return S.landed_inventory(X.landed(spark, sf), X.FIXTURE_PREFIXES)


@query
def feed_rejects(spark, sf):
    """A5: landed lines that could not be read."""
    return S.rejects(X.landed(spark, sf)).select("type", "line_no")


@query
def landed_health(spark, sf):
    """A5: landed lines, readable or not, per feed."""
    return S.landed_health(X.landed(spark, sf))


@query
def foundation_endpoints(spark, sf):
    """Endpoints serving a foundation model."""
    raw = X.endpoints_raw(spark, sf)
    flag = is_foundation(F.col("config.served_entities"), X.FIXTURE_PREFIXES)
    return raw.filter(flag).select("name", F.size("config.served_entities").alias("n_entities"))


@query
def endpoint_descriptions(spark, sf):
    """endpoint descriptions from own text, served entities or legacy models."""
    raw = X.endpoints_raw(spark, sf)
    return raw.select("name", endpoint_description(F.col("description"), F.col("config.served_entities"),
                                                   F.col("config.served_models"), X.FIXTURE_PREFIXES)
                      .alias("description"))


@query
def decode_result_rows(spark, sf):
    """Warehouse string results decoded to typed rows by column name."""
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("is_open", T.BooleanType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType())])
    return decode_result(X.result_raw(spark, sf), schema).drop("row_pos")


@query
def workspace_names(spark, sf):
    """Workspace name from each page's host."""
    return X.pages(spark, sf).select("page_id", S.workspace_name(F.col("url")).alias("workspace_name"))


@query
def workspaces(spark, sf):
    """Workspaces seen in the feed inventory, with the URL their feeds came from."""
    return S.workspaces(X.apps_raw(spark, sf), X.endpoints_raw(spark, sf), X.vector_raw(spark, sf), X.databases_raw(spark, sf))


# ---------------------------------------------------------------- ledger

def _ledger(spark, sf):
    return X.ledger(spark, sf)


def _defs(spark, sf):
    return X.definitions(spark, sf)


@query
def ledger_applied(spark, sf):
    """Applied ledger rows."""
    return L.applied(_ledger(spark, sf))


@query
def ledger_applied_versions(spark, sf):
    """Distinct applied versions per schema."""
    return L.applied_versions(_ledger(spark, sf))


@query
def ledger_missing_fields(spark, sf):
    """G1: definitions with missing fields."""
    return L.missing_fields(_defs(spark, sf))


@query
def ledger_duplicates(spark, sf):
    """Duplicate versions per schema."""
    return L.duplicate_versions(_defs(spark, sf))


@query
def ledger_not_sequential(spark, sf):
    """Schemas whose versions are not 1..n (schemas known from the ledger included)."""
    return L.non_sequential(_defs(spark, sf), _ledger(spark, sf))


@query
def ledger_out_of_order(spark, sf):
    """Definitions listed after a higher version."""
    return L.out_of_order(_defs(spark, sf))


@query
def ledger_drift(spark, sf):
    """Checksum drift."""
    return L.checksum_drift(_ledger(spark, sf))


@query
def ledger_latest(spark, sf):
    """Latest attempt per schema version."""
    return L.latest_status(_ledger(spark, sf), order=("applied_at", *IDS))


@query
def ledger_outcomes(spark, sf):
    """Outcome of every attempt."""
    return L.outcomes(_ledger(spark, sf), IDS)


@query
def ledger_error_classes(spark, sf):
    """F16: error class of failed attempts."""
    return L.error_classes(_ledger(spark, sf), IDS)


@query
def ledger_timing(spark, sf):
    """Execution-time profile per version."""
    t = L.timing(_ledger(spark, sf)).drop("p95_seconds")  # approximate; tested by rank error
    return t.withColumns({c: F.round(c, 6) for c in ("avg_seconds", "total_seconds")})


@query
def ledger_pending(spark, sf):
    """Defined versions never applied."""
    return L.pending(_defs(spark, sf), _ledger(spark, sf))


@query
def ledger_summary(spark, sf):
    """Per-schema ledger summary."""
    return L.summary(_defs(spark, sf), _ledger(spark, sf))


@query
def ledger_without_failed(spark, sf):
    """K5: ledger without the failed rows of version 1."""
    return L.drop_failed(_ledger(spark, sf), 1).drop(*IDS)


@query
def conform_v1_to_v2(spark, sf):
    """Registry data in the v1 layout conformed to v2."""
    return L.conform(registry(spark, sf).drop("revoked_reason"), 2)


@query
def conform_with_backfill(spark, sf):
    """v1 data conformed to v2, the new column filled by a CASE."""
    why = F.when(F.col("is_approved"), F.lit(None)).when(F.col("revoked_by").isNotNull(), F.concat(F.lit("Revoked by "), F.col("revoked_by"))).otherwise("No reason recorded")
    return L.conform(registry(spark, sf).drop("revoked_reason"), 2, {"revoked_reason": why})


@query
def backup_equals_source(spark, sf):
    """K1/K3: write the registry, back the copy up, compare the backup with the registry."""
    base = shared_dir(spark, f"registry-{uuid.uuid4().hex}")
    reg = registry(spark, sf)
    K.write_snapshot(reg, f"{base}/snapshot")
    K.backup(spark, f"{base}/snapshot", f"{base}/backup")
    return K.difference_counts(reg, K.read_snapshot(spark, f"{base}/backup"))


@query
def unknown_actions(spark, sf):
    """Decisions that are neither approvals nor revocations."""
    rej = V.rejected_decisions(X.decision_log(spark, sf))
    return rej.filter(~F.col("action").isin("approve", "revoke")).select("seq", "resource_id", "workspace_id", "error")


@query
def ledger_report(spark, sf):
    """Every ledger row's version, description, time, duration, status and error, whatever its status."""
    return L.report(_ledger(spark, sf))


@query
def ledger_definition_drift(spark, sf):
    """Applied rows whose checksum matches no statement defined for their version."""
    return L.definition_drift(_ledger(spark, sf), _defs(spark, sf), IDS)


# ---------------------------------------------------------------- as-of and stored layouts

@query
def decision_as_of(spark, sf):
    """The decision in force, and whether it was a live approval, when each line shipped."""
    facts = V.valid_decisions(X.decision_log(spark, sf)).withColumn("expires", midnight_as_written(F.col("expiration_date")))
    held = O.as_of(X.approval_questions(spark, sf), facts, D.KEY, "asked_at", "at", ["seq"], ["seq", "action", "actor", "expires"])
    live = (F.col("action") == "approve") & J.not_expired(F.col("expires"), F.col("asked_at"))
    return held.withColumn("was_approved", F.coalesce(live, F.lit(False))).drop("expires")


@query
def registry_of_region(spark, sf):
    """The stored registry's rows of one region's workspaces, other folders pruned at run time."""
    path = W.write_partitioned(registry(spark, sf), shared_dir(spark, f"registry-by-workspace-{uuid.uuid4().hex}"))
    return W.pick_workspaces(W.read_partitioned(spark, path), X.workspaces_of_region(spark, sf, "ASIA"))


def _bucketed(spark, df, what):
    name = f"{what}_{uuid.uuid4().hex}"
    return W.write_bucketed(df, name, shared_dir(spark, name), BUCKETS)


@query
def resource_status_bucketed(spark, sf):
    """J1 over inventory and registry stored in buckets of their row key: joined without an exchange."""
    inv, reg = (_bucketed(spark, df, what) for df, what in ((X.inventory(spark, sf), "inventory"), (registry(spark, sf), "registry")))
    return J.resource_status(inv, reg, X.as_of(), on=[W.ROW_KEY])


@query
def registry_lookup(spark, sf):
    """K1: the registry row of one key (that of the lowest resource number), read from its bucket."""
    stored = _bucketed(spark, registry(spark, sf), "registry")
    key = stored.agg(F.min(F.struct(F.col("resource_id").cast("long").alias("number"), "resource_id", "workspace_id")).alias("k")).select("k.resource_id", "k.workspace_id").first()
    return W.lookup(stored, tuple(k or "" for k in key))


@query
def stored_schema_drift(spark, sf):
    """A registry folder written under three layouts: which columns its files lack, add or type otherwise."""
    reg, folder = registry(spark, sf), shared_dir(spark, f"registry-layouts-{uuid.uuid4().hex}")
    of = lambda *ids: reg.filter(F.col("workspace_id").isin(*ids)).coalesce(1)
    of("1", "2").drop("revoked_reason").write.parquet(f"{folder}/part=1")
    of("3", "4").write.parquet(f"{folder}/part=2")
    of("5").withColumn("is_approved", F.col("is_approved").cast("string")).withColumn("note", F.lit("x")).write.parquet(f"{folder}/part=3")
    report = R.drift_report(spark, folder, REGISTRY_SCHEMA)
    return report.groupBy("name", "expected", "actual", "problem").agg(F.countDistinct("file").alias("n_files"), F.sum("n_rows").alias("n_rows"))


@query
def stored_ledger_maintained(spark, sf):
    """K2/K5: a ledger stored by version, appended to twice, then without the failed rows of version 1: rows per version and status."""
    rows = _ledger(spark, sf).select(*LEDGER.fieldNames())
    path = W.write_ledger(rows.filter(F.col("version") <= 3), shared_dir(spark, f"ledger-{uuid.uuid4().hex}"))
    for _ in range(2):
        W.append_new(rows.filter(F.col("version") > 2), path)
    W.delete_failed(spark, path, 1)
    return W.read_ledger(spark, path).groupBy("version", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("schema_key").alias("n_schemas"))


@query
def backup_fingerprints(spark, sf):
    """K3: registry and a damaged copy compared by content fingerprints per workspace."""
    reg = registry(spark, sf)
    return K.compare_fingerprints(reg, X.damaged(reg), ["workspace_id"])


@query
def backup_differences(spark, sf):
    """K3: the rows that differ, compared only in the workspaces whose fingerprints do."""
    reg = registry(spark, sf)
    return K.differing_rows(reg, X.damaged(reg), ["workspace_id"]).select("resource_id", "workspace_id", "approved_by", "n_left", "n_right")


@query
def result_variants(spark, sf):
    """Results typed by their own manifests, one VARIANT a row; fields read out again."""
    rows = C.decode_variants(X.result_mixed(spark, sf))
    got = lambda name, kind: F.try_variant_get("row", f"$.{name}", kind)
    return rows.select("result_id", got("o_orderkey", "string").alias("o_orderkey"), got("o_orderstatus", "string").alias("o_orderstatus"), got("is_open", "boolean").alias("is_open"),
                       F.round(got("o_totalprice", "double"), 2).alias("o_totalprice"), got("o_orderdate", "timestamp_ntz").alias("o_orderdate"))


@query
def result_variant_schemas(spark, sf):
    """The schema that each result's rows turn out to have (decimals without their digits), and how many results share it."""
    per_result = C.result_schemas(C.decode_variants(X.result_mixed(spark, sf)))
    per_result = per_result.withColumn("row_schema", F.regexp_replace("row_schema", r"DECIMAL\(\d+,\d+\)", "DECIMAL"))
    return per_result.groupBy("row_schema").agg(F.count(F.lit(1)).alias("n_results"), F.sum("n_rows").alias("n_rows"))


@query
def result_type_clashes(spark, sf):
    """Columns whose type differs from result to result."""
    return C.type_clashes(X.result_mixed(spark, sf))


@query
def ledger_durations(spark, sf):
    """Ledger rows from attempts with a start and an end: time taken per version."""
    attempts = (_ledger(spark, sf).filter(F.col("version").isNotNull()).drop("execution_time_seconds").withColumn("started_at", F.col("applied_at")).drop("applied_at")
                .withColumn("finished_at", F.col("started_at") + F.make_dt_interval(secs=(F.col("version") * F.lit(3601.25)).cast("decimal(18,6)"))))
    return L.ledger_rows(attempts).groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.min("execution_time_seconds"), 6).alias("least"), F.round(F.max("execution_time_seconds"), 6).alias("most"))


@query
def ledger_percentiles(spark, sf):
    """Per version, whether percentiles from merged daily sketches lie within 2 % of their exact ranks."""
    led = _ledger(spark, sf).filter(F.col("execution_time_seconds").isNotNull())
    got = L.timing_percentiles(L.timing_sketches(led)).withColumnRenamed("n", "n_times")
    t = F.col("execution_time_seconds")
    met = led.select("version", t).join(F.broadcast(got.withColumnRenamed("version", "_v")), F.col("version").eqNullSafe(F.col("_v")))
    checks = []
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = F.count_if(t < F.col(name)) / F.count(t), F.count_if(t <= F.col(name)) / F.count(t)
        checks.append(((below <= p + 0.02) & (upto >= p - 0.02)).alias(f"{name}_ok"))
    return met.groupBy("version").agg(F.max("n_times").alias("n_times"), *checks)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
