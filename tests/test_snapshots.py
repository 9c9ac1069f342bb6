import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from resgov.functions.times import ntz
from resgov.operators import decisions as D
from resgov.operators import snapshots as K
from resgov.operators.validate import valid_decisions
from resgov.plans.queries import registry
from resgov.sources import fixtures as X
from resgov.sources.tables import table

SF = "/root/testdata/sf0.001"


def counts(a, b):
    return tuple(K.difference_counts(a, b).first())


def test_snapshot_and_backup(spark, run_dir):
    reg = registry(spark, SF)
    path = K.write_snapshot(reg, f"{run_dir}/snapshot")
    snap = K.read_snapshot(spark, path)
    n = reg.count()
    assert counts(reg, snap) == (n, n, 0, 0)
    assert snap.schema["revoked_reason"].metadata.get("comment") == "why it was revoked"   # comments persist
    copy = K.read_snapshot(spark, K.backup(spark, path, f"{run_dir}/backup"))
    assert counts(snap, copy) == (n, n, 0, 0)
    assert counts(reg, copy.limit(n - 1)) == (n, n - 1, 1, 0)


def test_an_existing_folder_is_never_replaced(spark, run_dir):
    reg = registry(spark, SF)
    path = K.write_snapshot(reg.limit(3), f"{run_dir}/once")
    for write in (lambda: K.write_snapshot(reg, path), lambda: K.backup(spark, path, path)):
        with pytest.raises(AnalysisException):
            write()
    assert K.read_snapshot(spark, path).count() == 3


def test_unmatched_revoke_leaves_a_stored_registry_readable(spark, run_dir):
    log = X.decision_log(spark, SF)
    target = D.fold(log.filter(F.col("at") < ntz(X.CUT)))
    stored = K.read_snapshot(spark, K.write_snapshot(target, f"{run_dir}/stored"))
    revoke = valid_decisions(log).filter(F.col("action") == "revoke").limit(1).withColumn("resource_id", F.lit("nobody"))
    after = K.read_snapshot(spark, K.write_snapshot(D.apply_revokes(stored, revoke), f"{run_dir}/after"))
    n = stored.count()
    assert counts(stored, after) == (n, n, 0, 0)


def test_files_added_later_are_read(spark, run_dir):
    """Queries define their inputs afresh, so a table that grew gives more rows in the same session."""
    sf = f"{run_dir}/sf"
    for name in ("orders", "customer", "nation"):
        table(spark, SF, name).write.parquet(f"{sf}/{name}.parquet")
    first = registry(spark, sf).count(), X.decision_log(spark, sf).count()
    table(spark, SF, "orders").withColumn("extra", F.lit(1)).write.mode("append").parquet(f"{sf}/orders.parquet")
    assert X.decision_log(spark, sf).count() == 2 * first[1] and registry(spark, sf).count() == first[0]
