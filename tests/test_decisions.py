import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from resgov.functions.times import ntz
from resgov.operators import decisions as D
from resgov.operators.validate import valid_decisions
from resgov.schemas import DECISION_LOG, REGISTRY_COLUMNS

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (seq, day, action, resource_id, workspace_id, reason[, expiration])"""
    out = []
    for r in rows:
        seq, day, action, rid, ws, reason = r[:6]
        exp = r[6] if len(r) > 6 else None
        out.append((seq, T0 + dt.timedelta(days=day), action, f"name-{rid}", rid, ws, f"W{ws}", "creator",
                    f"actor{seq}", reason, exp))
    return spark.createDataFrame(out, DECISION_LOG)


OK = "a sufficiently long reason"


def replay(rows):
    """The reference's semantics applied one decision at a time (MERGE / UPDATE)."""
    table = {}
    for seq, day, action, rid, ws, reason in sorted(rows, key=lambda r: (r[1], r[0])):
        if len(reason.strip()) < 10:
            continue
        key = (rid, ws)
        at = T0 + dt.timedelta(days=day)
        if action == "approve":
            table[key] = dict(approved_by=f"actor{seq}", approval_date=at, is_approved=True, revoked_date=None,
                              revoked_by=None, revoked_reason=None, updated_at=at, justification=reason)
        elif key in table:
            table[key].update(is_approved=False, revoked_date=at, revoked_by=f"actor{seq}",
                              revoked_reason=reason, updated_at=at)
    return table


def as_table(df):
    cols = ["approved_by", "approval_date", "is_approved", "revoked_date", "revoked_by", "revoked_reason",
            "updated_at", "justification"]
    return {(r.resource_id, r.workspace_id): {c: r[c] for c in cols} for r in df.collect()}


def test_edge_sequences(spark):
    rows = [
        (1, 0, "approve", "a", "w", OK), (2, 1, "revoke", "a", "w", OK), (3, 2, "approve", "a", "w", OK),  # re-approve
        (4, 0, "revoke", "b", "w", OK), (5, 1, "approve", "b", "w", OK),          # revoke before approve vanishes
        (6, 0, "approve", "c", "w", OK), (7, 1, "revoke", "c", "w", "first revoke"),
        (8, 2, "revoke", "c", "w", "second revoke"),                               # last revoke wins
        (9, 3, "revoke", "zzz", "w", OK),                                          # unknown key
        (10, 0, "approve", "d", "w1", OK), (11, 0, "approve", "d", "w2", OK), (12, 1, "revoke", "d", "w1", OK),
        (14, 5, "approve", "e", "w", OK), (13, 5, "revoke", "e", "w", OK),         # same time: seq orders
        (15, 0, "approve", "f", "w", "short"),                                     # rejected
    ]
    reg = as_table(D.fold(log(spark, rows)))
    assert reg == replay(rows)
    assert reg[("a", "w")]["is_approved"] and reg[("a", "w")]["revoked_date"] is None
    assert reg[("b", "w")]["is_approved"]
    assert reg[("c", "w")]["revoked_reason"] == "second revoke"
    assert ("zzz", "w") not in reg and ("f", "w") not in reg
    assert not reg[("d", "w1")]["is_approved"] and reg[("d", "w2")]["is_approved"]
    assert reg[("e", "w")]["is_approved"]


def test_upsert_revoke_unmatched(spark):
    before = log(spark, [(1, 0, "approve", "a", "w", OK), (2, 0, "approve", "b", "w", OK),
                         (3, 1, "revoke", "b", "w", OK)])
    target = D.fold(before)
    later = valid_decisions(log(spark, [(4, 5, "approve", "b", "w", "re-approved again"),
                                        (5, 6, "approve", "c", "w", OK), (6, 7, "approve", "c", "w", "newest approval"),
                                        (7, 8, "revoke", "a", "w", "revoked later on"),
                                        (8, 9, "revoke", "a", "w", "revoked once more"),
                                        (9, 9, "revoke", "nope", "w", OK)]))
    up = as_table(D.upsert(target, D.approval_rows(later)))
    assert set(up) == {("a", "w"), ("b", "w"), ("c", "w")}
    assert up[("b", "w")]["is_approved"] and up[("b", "w")]["revoked_by"] is None   # re-approval clears revocation
    assert up[("c", "w")]["justification"] == "newest approval"
    rv = as_table(D.apply_revokes(target, later))
    assert not rv[("a", "w")]["is_approved"] and rv[("a", "w")]["revoked_reason"] == "revoked once more"
    assert rv[("b", "w")]["revoked_reason"] == OK                                     # untouched row kept
    assert len(rv) == 2                                                               # no-op for unknown key
    un = D.unmatched_revokes(target, later).collect()
    assert [r.resource_id for r in un] == ["nope"]
    assert D.upsert(target, D.approval_rows(later)).columns == REGISTRY_COLUMNS


def test_approval_rows_normalise(spark):
    rows = [(1, 0, "approve", "a", "w", OK, "2024-03-10T23:30:00-05:00"), (2, 0, "approve", "b", "w", OK, None)]
    df = log(spark, rows).withColumn("at", ntz("2024-01-01 10:11:12.987654"))
    got = {r.resource_id: r for r in D.approval_rows(valid_decisions(df)).collect()}
    assert got["a"].expiration_date == dt.datetime(2024, 3, 10)
    assert got["a"].approval_date == dt.datetime(2024, 1, 1, 10, 11, 12)
    assert got["b"].expiration_date is None and got["b"].is_approved


def test_history_and_time_travel(spark):
    rows = [(1, 0, "approve", "a", "w", OK), (2, 3, "revoke", "a", "w", OK), (3, 5, "approve", "a", "w", OK),
            (4, 1, "approve", "b", "w", OK)]
    h = {r.seq: r for r in D.history(log(spark, rows), partitions=3).collect()}
    assert h[1].valid_to == T0 + dt.timedelta(days=3) and h[1].next_seq == 2
    assert h[2].valid_to == T0 + dt.timedelta(days=5)
    assert h[3].valid_to is None and h[4].valid_to is None
    tt = as_table(D.registry_as_of(log(spark, rows), ntz(T0 + dt.timedelta(days=4))))
    assert not tt[("a", "w")]["is_approved"] and tt[("b", "w")]["is_approved"]


decision = st.tuples(st.sampled_from(["approve", "revoke"]), st.sampled_from(["k1", "k2", "k3"]),
                     st.sampled_from(["w1", "w2"]), st.integers(0, 6), st.sampled_from([OK, "short", "  ten chars "]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(decision, min_size=1, max_size=30))
def test_fold_equals_sequential_replay(spark, decisions):
    rows = [(i, day, action, rid, ws, reason) for i, (action, rid, ws, day, reason) in enumerate(decisions)]
    assert as_table(D.fold(log(spark, rows))) == replay(rows)
    # folding in two halves and merging the states gives the same registry
    half = len(rows) // 2
    s1 = D.fold_state(valid_decisions(log(spark, rows[:half]))) if half else None
    s2 = D.fold_state(valid_decisions(log(spark, rows[half:])))
    merged = D.merge_states(s1, s2) if s1 is not None else s2
    assert as_table(D.registry_from_state(merged)) == replay(rows)
