"""Migration-ledger audit across a fleet of schemas (keyed by ``schema_key``).

The reference checks one list of definitions in memory and records one row
per attempt; here every check is a grouped DataFrame operation over all
schemas at once.  Grouping is two-staged where counts of distinct versions
are needed, so partial aggregation absorbs a schema holding most rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import ALREADY_EXISTS_MARKERS, error_class, expected_error
from ..schemas import REGISTRY, REGISTRY_V1
from .neighbors import with_neighbor

# Ledger statuses and the note recorded for an existing target.
APPLIED = "applied"
FAILED = "failed"
EXISTS_NOTE = "Target already exists (expected)"
CRITICAL_MARKER = "CREATE TABLE"
REQUIRED_FIELDS = {"version": "version", "description": "description", "sql": "sql"}


def applied(ledger: DataFrame, ordered: bool = False) -> DataFrame:
    """Applied rows (version, description, applied_at, status); ordered by version on request."""
    out = (ledger.filter(F.col("status") == APPLIED)
           .select("schema_key", "version", "description", "applied_at", "status"))
    return out.orderBy("schema_key", "version") if ordered else out


def applied_versions(ledger: DataFrame) -> DataFrame:
    """Distinct applied versions per schema, cast to int; unusable values skipped."""
    v = F.col("version").cast("string").try_cast("int")
    return (ledger.filter(F.col("status") == APPLIED)
            .select("schema_key", v.alias("version"))
            .filter(F.col("version").isNotNull()).distinct())


def missing_fields(defs: DataFrame) -> DataFrame:
    """Definitions lacking version, description or SQL."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(label)) for c, label in REQUIRED_FIELDS.items()])
    return (defs.select("schema_key", "position", "version", missing.alias("missing"))
            .filter(F.col("missing") != ""))


def duplicate_versions(defs: DataFrame) -> DataFrame:
    return (defs.filter(F.col("version").isNotNull())
            .groupBy("schema_key", "version").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def version_profile(defs: DataFrame) -> DataFrame:
    """Per schema: rows, distinct versions, min and max version (two-stage aggregate)."""
    per_version = (defs.filter(F.col("version").isNotNull())
                   .groupBy("schema_key", "version").agg(F.count(F.lit(1)).alias("c")))
    return (per_version.groupBy("schema_key")
            .agg(F.sum("c").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                 F.min("version").alias("min_version"), F.max("version").alias("max_version")))


def non_sequential(defs: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Schemas whose sorted versions are not exactly 1..n.

    With ``schemas`` (a frame of schema keys, e.g. from the ledger) a schema
    without any definition is reported too (n_rows 0), as an empty list is invalid.
    """
    p = version_profile(defs)
    if schemas is not None:
        keys = schemas.select("schema_key").union(defs.select("schema_key")).distinct()
        p = keys.join(p, "schema_key", "left").select(
            "schema_key", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
            F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), "min_version", "max_version")
    ok = (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_distinct")) & (F.col("min_version") == 1) & \
         (F.col("max_version") == F.col("n_rows"))
    return p.filter(~F.coalesce(ok, F.lit(False)))


def out_of_order(defs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Definitions listed after a higher version (list order ≠ version order)."""
    d = defs.filter(F.col("version").isNotNull()).select("schema_key", "position", "version")
    prev = with_neighbor(d, ["schema_key"], ["position"], ["version", "position"], "prev",
                         prefix="prev_", partitions=partitions)
    return prev.filter(F.col("prev_version") > F.col("version"))


def checksum_drift(ledger: DataFrame) -> DataFrame:
    """Ledger rows whose recorded checksum is not the SHA-256 of their statement."""
    expected = F.sha2(F.col("sql_statement"), 256)
    return (ledger.filter(~F.col("checksum").eqNullSafe(expected))
            .select("schema_key", "version", "applied_at", "status", "checksum", expected.alias("expected")))


def latest_status(ledger: DataFrame, order: Sequence[str] = ("applied_at",)) -> DataFrame:
    """Latest attempt per (schema, version) — a failed version is retried, so
    versions can have many rows; the max over a struct led by ``order`` picks
    the last one with a mergeable aggregate."""
    packed = F.struct(*[F.col(c) for c in order], F.col("status"), F.col("error_message"),
                      F.col("execution_time_seconds"))
    return (ledger.groupBy("schema_key", "version")
            .agg(F.max(packed).alias("_l"), F.count(F.lit(1)).alias("n_attempts"))
            .select("schema_key", "version", "n_attempts",
                    F.col("_l.applied_at").alias("applied_at"), F.col("_l.status").alias("status"),
                    F.col("_l.error_message").alias("error_message")))


def outcomes(attempts: DataFrame, id_columns: Sequence[str] = ()) -> DataFrame:
    """Outcome of each attempt from its error text: an existing target counts as
    applied with a note; other errors fail; a failing CREATE TABLE is critical."""
    err = F.col("error_message")
    exists = F.lit(False)
    for marker in ALREADY_EXISTS_MARKERS:
        exists = exists | err.contains(marker)
    exists = F.coalesce(exists, F.lit(False))
    failed = err.isNotNull() & ~exists
    return attempts.select(
        "schema_key", "version", *id_columns,
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(APPLIED)).alias("outcome"),
        F.when(exists, F.lit(EXISTS_NOTE)).when(failed, err).alias("note"),
        (failed & F.coalesce(F.col("sql_statement").contains(CRITICAL_MARKER), F.lit(False))).alias("critical"))


def error_classes(ledger: DataFrame, id_columns: Sequence[str] = ()) -> DataFrame:
    return (ledger.filter(F.col("error_message").isNotNull())
            .select("schema_key", "version", *id_columns,
                    error_class(F.col("error_message")).alias("error_class"),
                    expected_error(F.col("error_message")).alias("expected")))


def conform(df: DataFrame, schema_version: int = 2, backfill: dict[str, Column] | None = None) -> DataFrame:
    """Bring registry data written under an older schema (v1: no revoked_reason) to version N.

    A column the data lacks is null, or the expression ``backfill`` names for it
    (a CASE over the other columns); where the column is there, its nulls are
    filled by that expression.
    """
    target = REGISTRY if schema_version >= 2 else REGISTRY_V1
    fill = backfill or {}
    cols = []
    for f in target.fields:
        own = [F.col(f.name)] if f.name in df.columns else []
        c = F.coalesce(*own, fill.get(f.name, F.lit(None)))
        cols.append(c.cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*cols)


def read_conformed(spark, *paths: str, schema_version: int = 2, backfill: dict[str, Column] | None = None) -> DataFrame:
    """Read registry files written under different schema versions together
    (``mergeSchema``: old files get nulls for newer columns) in the version-N layout."""
    return conform(spark.read.option("mergeSchema", "true").parquet(*paths), schema_version, backfill)


def timing(ledger: DataFrame, accuracy: int = 1000) -> DataFrame:
    """Execution-time profile per version across the fleet (mergeable aggregates).

    ``p95_seconds`` is approximate: its rank is off by at most n / ``accuracy``.
    """
    t = F.col("execution_time_seconds")
    return (ledger.groupBy("version")
            .agg(F.count(t).alias("n"), F.avg(t).alias("avg_seconds"),
                 F.min(t).alias("min_seconds"), F.max(t).alias("max_seconds"), F.sum(t).alias("total_seconds"),
                 F.percentile_approx(t, 0.95, accuracy).alias("p95_seconds")))


def timing_sketches(ledger: DataFrame, by: Sequence[str] = ("version", "day"), k: int = 200) -> DataFrame:
    """Per version and day: attempts and a mergeable KLL sketch of their execution times, fit to be stored.

    ``k`` sets the sketch's size; at 200 a rank is off by about 1.7 % at most (99 % confidence).  Null times count in neither.
    """
    t = F.col("execution_time_seconds")
    days = ledger.withColumn("day", F.to_date("applied_at")).filter(t.isNotNull() & ~F.isnan(t))
    return days.groupBy(*by).agg(F.count(t).alias("n"), F.kll_sketch_agg_double(t, k).alias("sketch"))


def timing_percentiles(sketches: DataFrame, points: Sequence[float] = (0.5, 0.95, 0.99), by: Sequence[str] = ("version",),
                       since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Percentiles over any span of days [since, until), from stored sketches alone: by, n and p50, p95, ..."""
    day, span = F.col("day"), sketches
    if since is not None:
        span = span.filter(day >= since)
    if until is not None:
        span = span.filter(day < until)
    merged = span.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"p{round(p * 100):d}") for p in points])


def report(ledger: DataFrame) -> DataFrame:
    """Status report over all ledger rows, whatever their status."""
    return ledger.select("schema_key", "version", "description", "applied_at", "execution_time_seconds",
                         "status", "error_message")


def definition_drift(ledger: DataFrame, defs: DataFrame, id_columns: Sequence[str] = ()) -> DataFrame:
    """Applied rows of defined versions whose checksum is that of no statement
    now defined for them: the migration was edited after it ran.

    Two semi/anti joins on (schema, version) and (schema, version, checksum);
    several definitions of a version make no pairs.
    """
    known = defs.filter(F.col("version").isNotNull() & F.col("sql").isNotNull())
    now = known.select("schema_key", "version", F.sha2("sql", 256).alias("checksum")).distinct()
    applied_rows = ledger.filter(F.col("status") == APPLIED).select("schema_key", "version", *id_columns, "applied_at", "checksum")
    return (applied_rows.join(now.select("schema_key", "version").distinct(), ["schema_key", "version"], "left_semi")
            .join(now, ["schema_key", "version", "checksum"], "left_anti")
            .select("schema_key", "version", *id_columns, "applied_at", "checksum"))


def pending(defs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Defined versions with no applied row."""
    defined = defs.filter(F.col("version").isNotNull()).select("schema_key", "version").distinct()
    return defined.join(applied_versions(ledger), ["schema_key", "version"], "left_anti")


def summary(defs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per schema: ledger rows, failed attempts, defined / applied versions, and of
    the defined ones those skipped (already applied) and pending.

    Each side is reduced once to one row per (schema, version); the two are
    joined on that key (both already hash-partitioned by it) and rolled up per
    schema — one scan of each input, three shuffles of pre-aggregated rows.
    """
    v = F.col("version").cast("string").try_cast("int")
    done = (F.col("status") == APPLIED) & v.isNotNull()
    per_ledger = ledger.groupBy("schema_key", v.alias("version")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == FAILED).alias("failed"),
        F.max(done).alias("applied"))
    per_def = (defs.filter(F.col("version").isNotNull()).groupBy("schema_key", "version")
               .agg(F.lit(True).alias("defined")))
    both = per_ledger.join(per_def, ["schema_key", "version"], "full")
    defined = F.coalesce(F.col("defined"), F.lit(False))
    applied = F.coalesce(F.col("applied"), F.lit(False))
    return (both.groupBy("schema_key")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("n_rows"),
                 F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("n_failed_attempts"),
                 F.count_if(defined).cast("long").alias("n_defined"),
                 F.count_if(applied).cast("long").alias("n_applied"),
                 F.count_if(defined & applied).cast("long").alias("n_skipped"),
                 F.count_if(defined & ~applied).cast("long").alias("n_pending")))


def drop_failed(ledger: DataFrame, version: int) -> DataFrame:
    """``DELETE WHERE version = N AND status = 'failed'`` as a null-safe complement."""
    cond = (F.col("version") == version) & (F.col("status") == FAILED)
    return ledger.filter(~F.coalesce(cond, F.lit(False)))


def ledger_rows(attempts: DataFrame, actor: str = "system") -> DataFrame:
    """Attempt records → ledger rows: SHA-256 of the statement, times truncated
    to seconds, audit columns filled (values are columns, never spliced SQL).
    Attempts carrying ``started_at``/``finished_at`` get their execution time
    (and applied time) from them."""
    from ..functions.times import elapsed_seconds, trunc_seconds
    if "execution_time_seconds" not in attempts.columns and {"started_at", "finished_at"} <= set(attempts.columns):
        attempts = attempts.withColumn("execution_time_seconds",
                                       elapsed_seconds(F.col("started_at"), F.col("finished_at")))
    if "applied_at" not in attempts.columns and "started_at" in attempts.columns:
        attempts = attempts.withColumn("applied_at", F.col("started_at"))
    at = trunc_seconds(F.col("applied_at"))
    return attempts.select(
        "schema_key", F.col("version").cast("int").alias("version"), "description", "sql_statement",
        F.sha2(F.col("sql_statement"), 256).alias("checksum"), "status", at.alias("applied_at"),
        F.col("execution_time_seconds").cast("double").alias("execution_time_seconds"), "error_message",
        at.alias("created_at"), at.alias("updated_at"),
        F.lit(actor).alias("created_by"), F.lit(actor).alias("updated_by"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows to the ledger dataset at ``path`` (INSERT INTO); a rerun appends them again.

    ``layout.append_new`` adds only rows that are not stored yet.
    """
    rows.write.mode("append").parquet(path)


def schema_profile(df: DataFrame) -> DataFrame:
    """Column listing of a dataset (DESCRIBE TABLE): position, name, type, nullable, comment.

    Built from the schema (metadata), so it costs no scan of the data.
    """
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean, comment string")


def schema_conformance(df: DataFrame, schema_version: int = 2) -> DataFrame:
    """Columns missing from, extra to, or typed differently than registry schema version N."""
    target = REGISTRY if schema_version >= 2 else REGISTRY_V1
    want = {f.name: f.dataType.simpleString() for f in target.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(n, want.get(n), have.get(n),
             "missing" if n not in have else "extra" if n not in want else "type")
            for n in list(want) + [h for h in have if h not in want]
            if want.get(n) != have.get(n)]
    return df.sparkSession.createDataFrame(rows, "name string, expected string, actual string, problem string")
