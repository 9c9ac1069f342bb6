import datetime as dt

from pyspark.sql import functions as F

from resgov.functions.times import ntz
from resgov.operators import stats as A
from resgov.operators import status as J
from resgov.schemas import INVENTORY, REGISTRY

AS_OF = dt.datetime(2024, 6, 1)


def inventory(spark, rows):
    full = [dict(name=None, resource_id=None, state="RUNNING", creator="u", created_at=None, workspace_id="ws1",
                 workspace_name="one", type="app", description="", is_foundation_model=False) | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in INVENTORY.fields) for r in full], INVENTORY)


def registry(spark, rows):
    base = dict(resource_name="n", resource_id=None, workspace_id="ws1", workspace_name="one",
                resource_creator="u", approved_by="admin", approval_date=dt.datetime(2024, 1, 1),
                expiration_date=None, justification="because it is needed", is_approved=True,
                revoked_date=None, revoked_by=None, updated_at=dt.datetime(2024, 1, 1), revoked_reason=None)
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in REGISTRY.fields) for r in full], REGISTRY)


def by_id(df):
    return {(r.resource_id, r.workspace_id): r for r in df.collect()}


def test_unapproved_without_approvals(spark):
    # the reference's listing test: one app and no approvals
    inv = inventory(spark, [dict(name="test-app", resource_id="test-app-id", workspace_id="test-workspace-123",
                                 workspace_name="test-workspace")])
    out = J.resource_status(inv, registry(spark, []), ntz(AS_OF)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.name, r.is_approved, r.approval_date, r.approved_by, r.justification) == \
        ("test-app", False, None, None, None)


def test_expiry_boundary_foundation_and_workspaces(spark):
    inv = inventory(spark, [
        dict(name="a", resource_id="exp-eq"), dict(name="b", resource_id="exp-before"),
        dict(name="c", resource_id="exp-null"), dict(name="f", resource_id="fm", is_foundation_model=True,
                                                      type="serving_endpoint"),
        dict(name="d", resource_id="dup", workspace_id="ws1"), dict(name="d", resource_id="dup", workspace_id="ws2"),
        dict(name="r", resource_id="revoked"), dict(name="x", resource_id="inactive"),
    ])
    reg = registry(spark, [
        dict(resource_id="exp-eq", expiration_date=AS_OF),
        dict(resource_id="exp-before", expiration_date=AS_OF - dt.timedelta(seconds=1)),
        dict(resource_id="exp-null"),
        dict(resource_id="fm", is_approved=False, revoked_date=dt.datetime(2024, 2, 1),
             expiration_date=dt.datetime(2020, 1, 1)),
        dict(resource_id="dup", workspace_id="ws2"),
        dict(resource_id="revoked", revoked_date=dt.datetime(2024, 2, 1)),
        dict(resource_id="inactive", is_approved=False),
        dict(resource_id="orphan"),
    ])
    got = by_id(J.resource_status(inv, reg, ntz(AS_OF)))
    assert len(got) == 8                                   # every inventory row once, orphan approval dropped
    assert got[("exp-eq", "ws1")].is_approved               # expiry equal to as_of still approved
    assert got[("exp-eq", "ws1")].expiration_date == AS_OF
    assert not got[("exp-before", "ws1")].is_approved       # one second before: expired
    assert got[("exp-before", "ws1")].expiration_date is None
    assert got[("exp-null", "ws1")].is_approved
    fm = got[("fm", "ws1")]
    assert fm.is_approved and fm.approved_by == "system" and fm.approval_date == AS_OF
    assert fm.expiration_date is None and fm.justification == J.FOUNDATION_JUSTIFICATION
    assert not got[("dup", "ws1")].is_approved and got[("dup", "ws2")].is_approved
    assert not got[("revoked", "ws1")].is_approved and not got[("inactive", "ws1")].is_approved

    only = by_id(J.approved_only(inv, reg, ntz(AS_OF)))
    assert set(only) == {k for k, r in got.items() if r.is_approved}

    ws = by_id(J.resource_status(inv, reg, ntz(AS_OF), workspace_id="ws2"))
    assert set(ws) == {("dup", "ws2")}

    keys = spark.createDataFrame([("exp-eq", "ws1"), ("exp-before", "ws1"), ("dup", "ws1"), ("fm", "ws1")],
                                 "resource_id string, workspace_id string")
    chk = by_id(J.check_approved(keys, reg, ntz(AS_OF)))
    assert chk[("exp-eq", "ws1")].is_approved and chk[("exp-eq", "ws1")].approved_by == "admin"
    assert not chk[("exp-before", "ws1")].is_approved and chk[("exp-before", "ws1")].approved_by is None
    assert not chk[("dup", "ws1")].is_approved
    assert not chk[("fm", "ws1")].is_approved              # the repository check has no foundation override


def test_active_scan_keeps_expired(spark):
    reg = registry(spark, [dict(resource_id="a", expiration_date=dt.datetime(2000, 1, 1)),
                           dict(resource_id="b", revoked_date=dt.datetime(2024, 2, 1)),
                           dict(resource_id="c", workspace_id="ws9")])
    act = J.active_approvals(reg)
    assert sorted(r.resource_id for r in act.collect()) == ["a", "c"]
    assert "updated_at" not in act.columns and len(act.columns) == 13
    assert [r.resource_id for r in J.active_approvals(reg, "ws9").collect()] == ["c"]
    assert J.active_approvals(reg, "").count() == 2


def test_stats_and_header(spark):
    inv = inventory(spark, [dict(resource_id="1", type="app"), dict(resource_id="2", type="app"),
                            dict(resource_id="3", type="postgres"), dict(resource_id="4", type="other")])
    reg = registry(spark, [dict(resource_id="1")])
    status = J.resource_status(inv, reg, ntz(AS_OF))
    got = {r.type: (r.total, r.approved, r.unapproved) for r in A.stats_by_type(status).collect()}
    assert got == {"app": (2, 1, 1), "serving_endpoint": (0, 0, 0), "vector_search": (0, 0, 0),
                   "postgres": (1, 0, 1)}
    o = A.stats_overall(status).first()
    assert (o.total, o.approved, o.approval_rate) == (3, 1, 33.3)
    assert {r.type for r in A.section_counts(status).collect()} == {"app", "postgres"}
    empty = status.limit(0)
    e = A.stats_overall(empty).first()
    assert (e.total, e.approved, e.approval_rate) == (0, 0, 0.0)
    h = J.listing_header(empty).first()
    assert (h.workspace_id, h.workspace_name) == ("current", "Unknown")
    only_other = J.resource_status(inventory(spark, [dict(resource_id="9", type="other")]), reg, ntz(AS_OF))
    assert A.stats_overall(only_other).first().total == 0
    roll = A.stats_rollup(status).filter(F.col("level") == 3).first()
    assert (roll.total, roll.approved) == (4, 1)


def test_card_view_and_lookup(spark):
    inv = inventory(spark, [
        dict(name="svc", resource_id="e1", type="serving_endpoint", state="ready", is_foundation_model=True),
        dict(name="svc", resource_id="a1", type="app", state="stopped", workspace_id="ws2"),
        dict(name="db", resource_id="p1", type="postgres", state=None),
        dict(name="vs", resource_id="v1", type="vector_search", state="ONLINE"),
    ])
    reg = registry(spark, [dict(resource_id="p1", expiration_date=AS_OF + dt.timedelta(days=6, hours=23))])
    cards = {r.row_key: r for r in J.card_view(J.resource_status(inv, reg, ntz(AS_OF)), ntz(AS_OF)).collect()}
    assert cards["e1-ws1"].card_class == "auto-approved" and cards["e1-ws1"].approver_label == "System (Foundation Model)"
    assert cards["e1-ws1"].type_label == "Model Serving Endpoint" and cards["e1-ws1"].state_class == "running"
    assert cards["a1-ws2"].type_label == "Databricks App" and cards["a1-ws2"].state_class == "stopped"
    assert cards["p1-ws1"].type_label == "Lakehouse Postgres" and cards["p1-ws1"].state_class == "unknown"
    assert cards["p1-ws1"].expiry_flag == "soon" and cards["p1-ws1"].card_class == "approved"
    assert cards["v1-ws1"].card_class == "unapproved" and cards["v1-ws1"].expiry_flag is None

    names = spark.createDataFrame([("svc",), ("db",), ("nope",)], "name string")
    got = {r.name: r for r in J.lookup_by_name(names, inv).collect()}
    assert got["svc"].found and got["svc"].type == "app"       # app wins over the serving endpoint
    assert not got["db"].found and not got["nope"].found       # other types are never found


def test_duplicates_recent_expiring(spark):
    inv = inventory(spark, [dict(resource_id="1"), dict(resource_id="1"), dict(resource_id="2")])
    d = J.duplicate_keys(inv).collect()
    assert [(r.row_key, r.n) for r in d] == [("1-ws1", 2)]
    reg = registry(spark, [dict(resource_id="old", approval_date=dt.datetime(2024, 5, 25)),
                           dict(resource_id="new", approval_date=dt.datetime(2024, 5, 25, 0, 0, 1)),
                           dict(resource_id="exp", expiration_date=dt.datetime(2024, 5, 31)),
                           dict(resource_id="soon", expiration_date=dt.datetime(2024, 6, 7, 23)),
                           dict(resource_id="later", expiration_date=dt.datetime(2024, 6, 8))])
    assert {r.resource_id for r in J.recent_approvals(reg, ntz(AS_OF)).collect()} == {"new"}
    assert {(r.resource_id, r.expiry_flag) for r in J.expiring(reg, ntz(AS_OF)).collect()} == \
        {("exp", "expired"), ("soon", "soon")}


def test_listing_header_first_row(spark):
    inv = inventory(spark, [dict(resource_id="9", type="postgres", workspace_name="later"),
                            dict(resource_id="5", type="app", workspace_name="first", workspace_id="w2"),
                            dict(resource_id="1", type="serving_endpoint", workspace_name="second")])
    status = J.resource_status(inv, registry(spark, []), ntz(AS_OF))
    h = J.listing_header(status).first()
    assert (h.workspace_id, h.workspace_name, h.n_resources) == ("current", "first", 3)
    h = J.listing_header(status, "w2").first()
    assert (h.workspace_id, h.workspace_name, h.n_resources) == ("w2", "first", 1)
