import os

from pyspark.sql import functions as F

from resgov.operators import decisions as D
from resgov.operators.validate import rejected_decisions, valid_decisions, with_errors
from resgov.schemas import DECISION_LOG
from compare import _digest
from resgov.sources import fixtures as X
from resgov.streaming import (quarantine_stream, start_registry_stream, validated_stream)
from resgov.streaming import decisions as S
from resgov.streaming.decisions import RegistryState, decision_stream

SF = "/root/testdata/sf0.001"


def _land(spark, run_dir, name):
    """Land the decision log as three files in time order (three micro-batches)."""
    path = f"{run_dir}/{name}"
    log = X.decision_log(spark, SF)
    for i, (lo, hi) in enumerate([("1990-01-01", "1997-01-01"), ("1997-01-01", "1999-01-01"),
                                  ("1999-01-01", "2100-01-01")]):
        part = log.filter((F.col("at") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("at") < F.lit(hi).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"batch={i}"))
    return path, log


def _rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def test_stream_validation_equals_batch(spark, run_dir):
    path, log = _land(spark, run_dir, "stream-t1")
    src = decision_stream(spark, path, maxFilesPerTrigger=1, recursiveFileLookup="true")
    ok = validated_stream(src).writeStream.format("memory").queryName("t1_valid").start()
    bad = quarantine_stream(src).writeStream.format("memory").queryName("t1_bad").start()
    ok.processAllAvailable(); bad.processAllAvailable(); ok.stop(); bad.stop()
    assert _digest(*_rows(spark.table("t1_valid"))) == _digest(*_rows(valid_decisions(log)))
    assert _digest(*_rows(spark.table("t1_bad"))) == _digest(*_rows(rejected_decisions(log)))


def test_stream_fold_equals_batch_and_replay_is_idempotent(spark, run_dir):
    path, log = _land(spark, run_dir, "stream-t2")
    src = decision_stream(spark, path, maxFilesPerTrigger=1, recursiveFileLookup="true")
    q, state = start_registry_stream(src, base=f"{run_dir}/t2-state",
                                     checkpoint=f"{run_dir}/t2-checkpoint")
    q.awaitTermination()
    expected = D.fold(log)
    assert _same(state.registry(), expected)
    # appending a batch again (e.g. after a lost executor) changes nothing
    batch = spark.read.parquet(os.path.join(path, "batch=2"))
    state.commit(batch)
    assert _same(state.registry(), expected)
    # nor does a fresh checkpoint over the same folder, which reads everything again
    again, state = start_registry_stream(src, base=f"{run_dir}/t2-state", checkpoint=f"{run_dir}/t2-checkpoint-2")
    again.awaitTermination()
    assert _same(state.registry(), expected)
    compacted = state.compact(f"{run_dir}/t2-compact")
    assert _same(compacted.registry(), expected) and compacted.state().count() == spark.read.parquet(compacted.base).count()


def test_late_decisions_do_not_win(spark, run_dir):
    log = X.decision_log(spark, SF)
    state = RegistryState(spark, f"{run_dir}/t2-late")
    late, early = log.filter(F.col("seq") % 2 == 0), log.filter(F.col("seq") % 2 == 1)
    for part in (late, early):
        state.commit(part)
    assert _same(state.registry(), D.fold(log))


def _append_rows(spark, state):
    return spark.read.parquet(state.base).count()


def test_one_pass_feeds_both_sinks_and_is_observed(spark, run_dir):
    """Valid rows, rejects and counts by error text equal the batch query's; a damaged file does not end the stream."""
    path, log = _land(spark, run_dir, "stream-one-pass")
    with open(os.path.join(path, "batch=1", "damaged.parquet"), "wb") as f:
        f.write(b"PAR1 this is no parquet file PAR1")
    out = f"{run_dir}/one-pass"
    src = S.decision_stream(spark, path, maxFilesPerTrigger=1, recursiveFileLookup="true")
    q = S.start_validation_stream(src, out, f"{run_dir}/one-pass-checkpoint")
    q.awaitTermination()
    assert q.exception() is None
    for outcome, want in (("valid", valid_decisions(log)), ("rejected", rejected_decisions(log))):
        got = S.checked_rows(spark, out, outcome)
        assert _same(got.select(*want.columns), want)
        assert got.select("batch").distinct().count() > 1
    metrics = S.batch_metrics(q)
    assert len(metrics) == 4
    total = {name: sum(m[name] for m in metrics) for name in metrics[0] if name != "batch"}
    want = {r.error: r["count"] for r in with_errors(log).groupBy("error").count().collect()}
    assert total.pop("n_rows") == log.count() and total.pop("n_valid") == want.pop(None)
    assert {S.METRICS[name]: n for name, n in total.items() if n} == want
    assert [os.path.basename(r.file) for r in S.unread_files(spark, path, out).collect()] == ["damaged.parquet"]


def test_a_batch_that_runs_again_replaces_its_output(spark, run_dir):
    """A lost commit makes the stream run the last batch again: no row comes twice."""
    path, log = _land(spark, run_dir, "stream-again")
    out, checkpoint = f"{run_dir}/again", f"{run_dir}/again-checkpoint"
    src = lambda: S.decision_stream(spark, path, maxFilesPerTrigger=1, recursiveFileLookup="true")
    S.start_validation_stream(src(), out, checkpoint).awaitTermination()
    commits = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    os.remove(f"{checkpoint}/commits/{commits[-1]}")
    for f in os.listdir(f"{checkpoint}/commits"):
        if f.startswith(f".{commits[-1]}."):
            os.remove(f"{checkpoint}/commits/{f}")
    S.start_validation_stream(src(), out, checkpoint).awaitTermination()
    assert _same(S.checked_rows(spark, out, "valid").select(*log.columns), valid_decisions(log))


def test_redelivered_files_change_nothing(spark, run_dir):
    """A file landed twice, in one run or after a restart, changes neither the state nor the rows appended."""
    path, log = _land(spark, run_dir, "stream-twice")
    base, checkpoint = f"{run_dir}/twice-state", f"{run_dir}/twice-checkpoint"
    src = lambda: S.decision_stream(spark, path, maxFilesPerTrigger=1, recursiveFileLookup="true")

    def run():
        q, state = start_registry_stream(src(), base, checkpoint)
        q.awaitTermination()
        return state

    def deliver(name):
        spark.read.schema(DECISION_LOG).parquet(f"{path}/batch=1").coalesce(1).write.parquet(f"{path}/{name}")

    deliver("again-before")
    state = run()
    once = RegistryState(spark, f"{run_dir}/twice-once")
    for i in range(3):
        once.commit(spark.read.schema(DECISION_LOG).parquet(f"{path}/batch={i}"))
    assert _same(state.registry(), D.fold(log)) and _append_rows(spark, state) == _append_rows(spark, once)
    deliver("again-after")
    state = run()
    assert _same(state.registry(), D.fold(log)) and _append_rows(spark, state) == _append_rows(spark, once)


def test_late_decisions_pass_the_watermark(spark, run_dir):
    """Decisions much older than those seen before are folded, not dropped as late."""
    path = f"{run_dir}/stream-late"
    log = X.decision_log(spark, SF)
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    base, checkpoint = f"{run_dir}/late-state", f"{run_dir}/late-checkpoint"
    for i, part in enumerate((log.filter(F.col("at") >= cut), log.filter(F.col("at") < cut))):
        part.coalesce(1).write.parquet(f"{path}/batch={i}")
        q, state = start_registry_stream(decision_stream(spark, path, recursiveFileLookup="true"), base, checkpoint, delay="1 second")
        q.awaitTermination()
    assert _same(state.registry(), D.fold(log))


def test_a_state_can_be_read_before_the_first_batch(spark, run_dir):
    state = RegistryState(spark, f"{run_dir}/no-batch-yet")
    assert state.registry().count() == 0 and state.registry().columns == D.fold(X.decision_log(spark, SF)).columns


def _same(got, expected):
    return _digest(*_rows(got.select(*expected.columns))) == _digest(*_rows(expected))
