import datetime as dt
import hashlib

from resgov.operators import ledger as L
from resgov.schemas import DEFINITIONS, LEDGER, REGISTRY_V1, REGISTRY

T0 = dt.datetime(2024, 1, 1)


def defs(spark, rows):
    return spark.createDataFrame(rows, DEFINITIONS)


def ledger(spark, rows):
    """rows: (schema, version, status, minutes, error[, sql, checksum])"""
    out = []
    for r in rows:
        key, v, status, minute, err = r[:5]
        sql = r[5] if len(r) > 5 else f"ALTER TABLE t ADD COLUMN c{v} STRING"
        chk = r[6] if len(r) > 6 else hashlib.sha256(sql.encode()).hexdigest()
        at = T0 + dt.timedelta(minutes=minute)
        out.append((key, v, f"step {v}", sql, chk, status, at, 0.5 * (v or 0), err, at, at, "system", "system"))
    return spark.createDataFrame(out, LEDGER)


def test_definition_checks(spark):
    d = defs(spark, [
        ("ok", 1, 1, "a", "s"), ("ok", 2, 2, "b", "s"),
        ("dup", 1, 1, "a", "s"), ("dup", 2, 1, "b", "s"),
        ("gap", 1, 1, "a", "s"), ("gap", 2, 3, "b", "s"),
        ("start2", 1, 2, "a", "s"), ("start2", 2, 3, "b", "s"),
        ("order", 1, 2, "a", "s"), ("order", 2, 1, "b", "s"),
        ("missing", 1, 1, None, "s"), ("missing", 2, None, "b", None),
    ])
    assert {(r.schema_key, r.position, r.missing) for r in L.missing_fields(d).collect()} == \
        {("missing", 1, "description"), ("missing", 2, "version,sql")}
    assert {(r.schema_key, r.version, r.n) for r in L.duplicate_versions(d).collect()} == {("dup", 1, 2)}
    assert {r.schema_key for r in L.non_sequential(d).collect()} == {"dup", "gap", "start2"}
    ooo = L.out_of_order(d, partitions=3).collect()
    assert [(r.schema_key, r.position, r.version, r.prev_version) for r in ooo] == [("order", 2, 1, 2)]


def test_ledger_checks(spark):
    lg = ledger(spark, [
        ("s", 1, "applied", 0, None),
        ("s", 2, "failed", 1, "[TABLE_OR_VIEW_NOT_FOUND] t"),
        ("s", 2, "applied", 5, None),                                   # failed then applied
        ("s", 3, "failed", 2, "[FIELD_ALREADY_EXISTS] c3"),
        ("s", 4, "failed", 3, "boom", "CREATE TABLE x (a INT)"),
        ("s", 5, "failed", 4, "column already exists"),
        ("s", 6, "applied", 6, None, "ALTER TABLE t ADD COLUMN z STRING", "deadbeef"),
    ])
    latest = {r.version: (r.status, r.n_attempts) for r in L.latest_status(lg).collect()}
    assert latest[2] == ("applied", 2) and latest[4] == ("failed", 1)
    outs = {(r.version, r.outcome, r.critical) for r in L.outcomes(lg).collect()}
    assert (3, "applied", False) in outs and (4, "failed", True) in outs and (5, "applied", False) in outs
    assert (2, "failed", False) in outs
    classes = {r.version: (r.error_class, r.expected) for r in L.error_classes(lg).collect()}
    assert classes == {2: ("not_found", True), 3: ("already_exists", True), 4: ("other", False),
                       5: ("already_exists", False)}
    assert [r.version for r in L.checksum_drift(lg).collect()] == [6]
    d = defs(spark, [("s", i, i, "d", "x") for i in range(1, 8)] + [("t", 1, 1, "d", "x")])
    assert sorted(r.version for r in L.pending(d, lg).collect() if r.schema_key == "s") == [3, 4, 5, 7]
    summ = {r.schema_key: r for r in L.summary(d, lg).collect()}
    s = summ["s"]
    assert (s.n_rows, s.n_failed_attempts, s.n_defined, s.n_applied, s.n_skipped, s.n_pending) == \
        (7, 4, 7, 3, 3, 4)
    assert summ["t"].n_rows == 0 and summ["t"].n_pending == 1
    assert L.drop_failed(lg, 2).count() == 6
    assert {r.version for r in L.applied_versions(lg).collect()} == {1, 2, 6}
    t = {r.version: r.n for r in L.timing(lg).collect()}
    assert t[2] == 2


def test_conform(spark):
    v1 = spark.createDataFrame([tuple([None] * len(REGISTRY_V1.fields))], REGISTRY_V1)
    out = L.conform(v1, 2)
    assert out.columns == [f.name for f in REGISTRY.fields]
    assert out.schema["revoked_reason"].metadata.get("comment") == "why it was revoked"


def test_append_profile_conformance(spark, tmp_path):
    attempts = spark.createDataFrame(
        [("s", 1, "d", "CREATE TABLE x (a INT)", "applied", dt.datetime(2024, 1, 1, 0, 0, 0, 500000), 0.2, None)],
        "schema_key string, version int, description string, sql_statement string, status string, "
        "applied_at timestamp_ntz, execution_time_seconds double, error_message string")
    rows = L.ledger_rows(attempts)
    path = str(tmp_path / "ledger")
    L.append_ledger(rows, path)
    L.append_ledger(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and L.checksum_drift(back).count() == 0
    assert back.first().applied_at == dt.datetime(2024, 1, 1)
    prof = {r.name: r.type for r in L.schema_profile(rows).collect()}
    assert prof["version"] == "int" and prof["checksum"] == "string"
    reg_v1 = spark.createDataFrame([tuple([None] * len(REGISTRY_V1.fields))], REGISTRY_V1)
    issues = {(r.name, r.problem) for r in L.schema_conformance(reg_v1, 2).collect()}
    assert issues == {("revoked_reason", "missing")}
    assert L.schema_conformance(L.conform(reg_v1, 2), 2).count() == 0


def test_schema_without_definitions_is_reported(spark):
    d = defs(spark, [("a", 1, 1, "x", "s")])
    lg = ledger(spark, [("a", 1, "applied", 0, None), ("empty", 1, "applied", 0, None)])
    got = {r.schema_key: r.n_rows for r in L.non_sequential(d, lg).collect()}
    assert got == {"empty": 0}
    d2 = defs(spark, [("a", 1, 1, "x", "s"), ("only-defs", 1, 2, "x", "s")])
    got = {r.schema_key for r in L.non_sequential(d2, lg).collect()}
    assert got == {"empty", "only-defs"}


def test_read_mixed_schema_versions(spark, tmp_path):
    from resgov.plans.queries import registry
    reg = registry(spark, "/root/testdata/sf0.001")
    old_dir, new_dir = str(tmp_path / "v1"), str(tmp_path / "v2")
    reg.drop("revoked_reason").limit(20).write.parquet(old_dir)        # written before migration 2
    reg.write.parquet(new_dir)
    both = L.read_conformed(spark, old_dir, new_dir)
    assert both.columns == [f.name for f in REGISTRY.fields]
    assert both.count() == reg.count() + 20
    assert L.read_conformed(spark, old_dir).filter("revoked_reason IS NOT NULL").count() == 0


def test_ledger_rows_from_timed_attempts(spark):
    attempts = spark.createDataFrame(
        [("s", 1, "d", "ALTER TABLE t ADD COLUMN x STRING", "applied",
          dt.datetime(2024, 1, 1, 0, 0, 0, 250000), dt.datetime(2024, 1, 1, 0, 0, 2, 750000), None)],
        "schema_key string, version int, description string, sql_statement string, status string, "
        "started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
    r = L.ledger_rows(attempts).first()
    assert r.execution_time_seconds == 2.5 and r.applied_at == dt.datetime(2024, 1, 1)


def test_percentiles_from_merged_sketches(spark):
    """Ranks stay within 2 % whatever the span, hot days and orders; sketches of days merge."""
    from pyspark.sql import functions as F
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 10 if i % 3 else 0) for i in range(30_000)]
    rows = spark.createDataFrame([(1 + i % 2, float((i * 7919) % 30_011), days[i]) for i in range(30_000)] + [(1, None, days[0]), (9, None, days[0]), (1, float("nan"), days[0])],
                                 "version int, execution_time_seconds double, applied_at timestamp_ntz")
    sketches = L.timing_sketches(rows)
    assert {r.version for r in sketches.collect()} == {1, 2}
    for since, until in ((None, None), (dt.date(2024, 1, 3), dt.date(2024, 1, 8))):
        got = {r.version: r for r in L.timing_percentiles(sketches, since=since and F.lit(since), until=until and F.lit(until)).collect()}
        for version in (1, 2):
            want = sorted(float((i * 7919) % 30_011) for i in range(30_000) if 1 + i % 2 == version and (since is None or since <= days[i].date() < until))
            assert got[version].n == len(want)
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                rank = sum(x <= got[version][name] for x in want) / len(want)
                assert abs(rank - p) < 0.02
