"""Plan-shape checks: pushdown reaches the scan, no cartesian products, no
Python evaluation, partial aggregation before shuffles, one range exchange
in the neighbour operator."""

import contextlib
import io
import re

import pytest

from resgov.functions.times import ntz
from resgov.operators import snapshots as K
from resgov.operators import status as J
from resgov.operators.neighbors import with_neighbor
from resgov.plans.queries import queries, registry
from resgov.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_no_python(spark, name):
    text = plan(queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in text, f"{name}: {bad}"


def test_active_filter_pushed_to_parquet(spark, run_dir):
    base = f"{run_dir}/plan-registry"
    K.write_snapshot(registry(spark, SF), base)
    stored = K.read_snapshot(spark, base)
    text = plan(J.active_approvals(stored, "7"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "EqualTo(is_approved,true)" in pushed and "IsNull(revoked_date)" in pushed
    assert "EqualTo(workspace_id,7)" in pushed
    status = J.resource_status(X.inventory(spark, SF), stored, ntz(X.AS_OF))
    text = plan(status)
    assert "IsNull(revoked_date)" in text
    # only the needed registry columns are read for the status join
    schema = [s for s in re.findall(r"ReadSchema: (struct<[^\n]*>)", text) if "is_approved" in s][0]
    assert "revoked_reason" not in schema and "updated_at" not in schema


def test_fold_aggregates_before_shuffle(spark, run_dir):
    text = plan(registry(spark, SF), "simple")
    partial = text.find("partial_max")
    assert partial > 0
    # the exchange on the key sits between the final and the partial aggregate
    assert re.search(r"max\(.*\n.*Exchange hashpartitioning\(resource_id", text, re.S)


def test_neighbor_has_one_range_exchange(spark, run_dir):
    df = X.decision_log(spark, SF).select("seq", "at", "resource_id", "workspace_id")
    text = plan(with_neighbor(df, ["resource_id", "workspace_id"], ["at", "seq"], ["seq"]), "simple")
    assert text.count("rangepartitioning") == 1
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["upsert_registry", "revoke_registry"])
def test_merge_has_one_key_exchange(spark, name):
    """Above the fold's own exchange there is none but the merge's; no join."""
    text = plan(queries()[name](spark, SF), "simple")
    keyed = text.count("hashpartitioning(resource_id")
    assert keyed <= (3 if name == "upsert_registry" else 2) and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith("ledger_") and n != "ledger_out_of_order"))
def test_ledger_has_no_window(spark, name):
    assert "Window" not in plan(queries()[name](spark, SF), "simple")


def test_workspaces_read_each_feed_once(spark):
    text = plan(queries()["workspaces"](spark, SF))
    for name in ("supplier", "events"):
        assert len(re.findall(rf"Location: InMemoryFileIndex \[file:[^\]]*/{name}.parquet\]", text)) == 1
