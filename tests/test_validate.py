from pyspark.sql import functions as F

from resgov.functions.text import PY_WHITESPACE, py_strip, stripped_length
from resgov.operators import validate as V

NBSP = "\xa0"


def _approvals(spark, rows):
    schema = "resource_name string, resource_id string, justification string, expiration_date string"
    return spark.createDataFrame(rows, schema)


def test_strip_matches_python(spark):
    samples = ["  abc  ", "\tabc\n", f"{NBSP}abc{NBSP}", "\u3000x ", "\x1cabc\x1f", "a b", "", "   ",
               "\x0babc\x0c", "\u200babc"]  # U+200B is not whitespace for Python
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r.s: (r.stripped, r.n) for r in df.select("s", py_strip(F.col("s")).alias("stripped"),
                                                     stripped_length(F.col("s")).alias("n")).collect()}
    for s in samples:
        assert got[s] == (s.strip(), len(s.strip())), repr(s)
    assert set(PY_WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_approval_rules_first_error_wins(spark):
    rows = [
        ("app", "id", "123456789", None),           # nine characters
        ("app", "id", "1234567890", None),          # ten characters: ok
        ("app", "id", "\t 123456789 \n", None),     # nine after stripping tab/newline
        ("app", "id", f"{NBSP}123456789{NBSP}", None),  # no-break space padding
        ("app", "id", None, None),
        ("", "id", "short", None),                  # name error wins over justification
        (None, "id", "long enough text", None),
        ("   ", "id", "long enough text", None),    # blank name is accepted
        ("app", "", "long enough text", None),
        ("app", "id", "long enough text", "not a date"),
        ("app", "id", "long enough text", "2024-03-10T23:30:00-05:00"),
        ("app", "id", "long enough text", ""),      # empty expiry = none
    ]
    valid, rejects = V.validate_approvals(_approvals(spark, rows))
    errors = [r.error for r in V.validate_approvals(_approvals(spark, rows))[1].collect()]
    got = {(r.resource_name, r.resource_id, r.justification, r.expiration_date): r.error
           for r in rejects.collect()}
    assert got == {
        ("app", "id", "123456789", None): V.JUSTIFICATION_TOO_SHORT,
        ("app", "id", "\t 123456789 \n", None): V.JUSTIFICATION_TOO_SHORT,
        ("app", "id", f"{NBSP}123456789{NBSP}", None): V.JUSTIFICATION_TOO_SHORT,
        ("app", "id", None, None): V.JUSTIFICATION_TOO_SHORT,
        ("", "id", "short", None): V.NAME_AND_ID_REQUIRED,
        (None, "id", "long enough text", None): V.NAME_AND_ID_REQUIRED,
        ("app", "", "long enough text", None): V.NAME_AND_ID_REQUIRED,
        ("app", "id", "long enough text", "not a date"): V.INVALID_EXPIRATION,
    }
    assert len(errors) == 8
    assert valid.count() == 4


def test_reference_messages(spark):
    # the reference's unit tests: missing name, short justification, short revoke reason
    _, rej = V.validate_approvals(_approvals(spark, [("", "id", "A valid justification", None)]))
    assert rej.first().error == "Resource name and ID are required"
    _, rej = V.validate_approvals(_approvals(spark, [("n", "id", "short", None)]))
    assert rej.first().error == "Justification must be at least 10 characters"
    revokes = spark.createDataFrame([("id", "ws", "short"), ("id", "ws", "long enough reason")],
                                    "resource_id string, workspace_id string, revoked_reason string")
    valid, rej = V.validate_revokes(revokes)
    assert rej.first().error == "Revocation reason must be at least 10 characters"
    assert valid.count() == 1


def test_revoke_rules(spark):
    rows = [(None, "ws", "long enough reason"), ("id", "", "long enough reason"), ("id", "ws", " 12345678 "),
            ("id", "ws", "1234567890")]
    df = spark.createDataFrame(rows, "resource_id string, workspace_id string, revoked_reason string")
    valid, rej = V.validate_revokes(df)
    assert sorted(r.error for r in rej.collect()) == sorted([V.IDS_REQUIRED, V.IDS_REQUIRED, V.REASON_TOO_SHORT])
    assert [r.revoked_reason for r in valid.collect()] == ["1234567890"]


def test_expiry_warnings_hint_only(spark):
    import datetime as dt
    from resgov.functions.times import ntz
    from resgov.schemas import DECISION_LOG
    at = dt.datetime(2024, 6, 1)
    rows = [(1, at, "approve", "n", "a", "w", "W", "c", "x", "long enough reason", "2024-05-31"),
            (2, at, "approve", "n", "b", "w", "W", "c", "x", "long enough reason", "2024-06-01T23:00:00-05:00"),
            (3, at, "approve", "n", "c", "w", "W", "c", "x", "long enough reason", None),
            (4, at, "approve", "n", "d", "w", "W", "c", "x", "short", "2000-01-01")]
    log = spark.createDataFrame(rows, DECISION_LOG)
    got = {r.resource_id: r.past_expiry for r in V.expiry_warnings(log, ntz("2024-06-01 10:00:00")).collect()}
    assert got == {"a": True, "b": False}          # no expiry: no row; rejected request: no row
    assert V.valid_decisions(log).count() == 3     # a past expiry is never a reject
