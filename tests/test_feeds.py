import datetime as dt
import json

from pyspark.sql import functions as F, types as T

from resgov.schemas import ENDPOINTS_RAW
from resgov.sources import decode as C
from resgov.sources import feeds as S
from resgov.sources.decode import decode_result

HOST = "https://my-workspace.cloud.example.com"


def test_workspace_name(spark):
    rows = [("https://my-workspace.cloud.example.com",), ("my-ws.example.com",), ("http://a.b/x?y=1",),
            ("localhost",), ("",), (None,), ("https://",)]
    got = [r.n for r in spark.createDataFrame(rows, "h string").select(S.workspace_name(F.col("h")).alias("n"))
           .collect()]
    assert got == ["my-workspace", "my-ws", "a", "localhost", "default-workspace", "default-workspace", ""]


def test_apps_state_rules(spark):
    rows = [
        ("obj", '{"state": "RUNNING"}', None),
        ("str", '"ACTIVE"', '{"state": "STOPPED"}'),
        ("fallback", '{"state": "UNKNOWN"}', '"DEPLOYING"'),
        ("fallback-obj", None, '{"state": "stopped"}'),
        ("missing", None, None),
        ("nostate", '{"other": 1}', None),
        ("lower", '{"state": "running"}', None),
    ]
    raw = spark.createDataFrame([(n, None, "2024-01-01T00:00:00Z" if n == "obj" else None, None, c, a, "1", HOST)
                                 for n, c, a in rows],
                                "name string, creator string, create_time string, description string, "
                                "compute_status string, app_status string, workspace_id string, workspace_host string")
    got = {r.name: r for r in S.normalise_apps(raw).collect()}
    assert got["obj"].state == "RUNNING" and got["obj"].created_at == dt.datetime(2024, 1, 1)
    assert got["str"].state == "ACTIVE"
    assert got["fallback"].state == "DEPLOYING"
    assert got["fallback-obj"].state == "stopped"
    assert got["missing"].state == "UNKNOWN" and got["nostate"].state == "UNKNOWN"
    assert got["lower"].state == "running"
    r = got["missing"]
    assert (r.resource_id, r.creator, r.description, r.type, r.workspace_name, r.is_foundation_model) == \
        ("missing", "unknown", "", "app", "my-workspace", False)


def _entity(name=None, entity_name=None, ext=None):
    return (name, entity_name, "1", (ext,) if ext is not None else None)


def test_endpoint_descriptions_and_foundation(spark):
    rows = [
        ("given", "Own text", [_entity("e", "databricks-llama-3")], []),
        ("entities", None, [_entity("first", "databricks-gpt-x"), _entity("second", "my-model")], []),
        ("legacy", "ignored own text", [], [("m1",), ("m2",)]),
        ("both", None, [_entity("e", "x-model")], [("m1",)]),
        ("noname", "", [_entity(None, None)], []),
        ("namefallback", None, [_entity("databricks-bge-small", None)], []),
        ("external", None, [_entity("e", "custom", ext="gpt-4")], []),
        ("empty", None, [], []),
        ("nonprefixed", None, [_entity("e", "databricks-other")], []),
    ]
    data = [(None if n == "given" else f"id-{n}", n, None, 0 if n == "empty" else 1_700_000_000_000, d,
             ("READY",) if n != "empty" else None, (ents, models), "1", HOST) for n, d, ents, models in rows]
    out = {r.name: r for r in S.normalise_endpoints(spark.createDataFrame(data, ENDPOINTS_RAW)).collect()}
    assert out["given"].description == "Own text" and out["given"].is_foundation_model
    assert out["given"].resource_id == "given"                    # id missing → name
    assert out["entities"].description == "Serving: databricks-gpt-x (Foundation Model), my-model"
    assert out["legacy"].description == "Serving models: m1, m2"   # legacy models replace own text
    assert out["both"].description == "Serving: x-model" and not out["both"].is_foundation_model
    assert out["noname"].description == "Serving: Unknown"
    assert out["namefallback"].description == "Serving: databricks-bge-small (Foundation Model)"
    assert out["external"].is_foundation_model and out["external"].description == "Serving: custom (Foundation Model)"
    assert out["empty"].description == "" and out["empty"].state == "UNKNOWN" and out["empty"].created_at is None
    assert not out["nonprefixed"].is_foundation_model
    assert out["entities"].creator == "unknown" and out["entities"].created_at == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_vector_and_database_rules(spark):
    vec = spark.createDataFrame(
        [("v1", None, None, "STANDARD", ("ONLINE",), "1", HOST), ("v2", "me", 5, "", None, "1", HOST),
         ("v3", "me", 5, None, (None,), "1", HOST)],
        "name string, creator string, creation_timestamp long, endpoint_type string, "
        "endpoint_status struct<state:string>, workspace_id string, workspace_host string")
    got = {r.name: r for r in S.normalise_vector_search(vec).collect()}
    assert got["v1"].description == "Type: STANDARD" and got["v1"].state == "ONLINE" and got["v1"].creator == "unknown"
    assert got["v2"].description == "" and got["v2"].state == "UNKNOWN"
    assert got["v3"].state == "UNKNOWN"
    db = spark.createDataFrame(
        [("u1", "n1", "c", None, "comment", "desc", "dns", None, None, "1", HOST),
         (None, "n2", "c", None, "", "desc", "dns", "STOPPED", "X", "1", HOST),
         ("u3", None, "c", None, None, "", "h.example.com", None, "STARTING", "1", HOST),
         (None, None, None, None, "", "", "", None, None, "1", HOST)],
        "uid string, name string, creator string, created_at string, comment string, description string, "
        "read_write_dns string, state string, status string, workspace_id string, workspace_host string")
    got = {r.resource_id: r for r in S.normalise_databases(db).collect()}
    assert got["u1"].description == "comment" and got["u1"].state == "RUNNING"
    assert got["n2"].description == "desc" and got["n2"].state == "STOPPED"
    assert got["u3"].description == "Host: h.example.com" and got["u3"].name == "u3" and got["u3"].state == "STARTING"
    assert got[""].description == "" and got[""].name == "" and got[""].creator == "unknown"


def test_union_and_health(spark):
    a = spark.createDataFrame([("x", "x", "UNKNOWN", "app")], "name string, resource_id string, state string, type string")
    b = spark.createDataFrame([("y", "", "READY", "postgres", True)],
                              "name string, resource_id string, state string, type string, is_foundation_model boolean")
    u = S.union_inventory(a, b)
    assert {r.name: r.is_foundation_model for r in u.collect()} == {"x": False, "y": True}
    h = {r.type: (r.n_rows, r.n_missing_id, r.n_unknown_state)
         for r in S.feed_health(u.withColumn("created_at", F.lit(None))).collect()}
    assert h == {"app": (1, 0, 1), "postgres": (1, 1, 0)}


def test_decode_result(spark):
    raw = spark.createDataFrame([
        (1, [("a", "LONG"), ("ok", "BOOLEAN"), ("t", "TIMESTAMP")], [["1", "TRUE", "2024-01-01 00:00:00"],
                                                                     ["x", "no", None]]),
        (2, [("t", "TIMESTAMP"), ("a", "LONG")], [["2024-02-02 10:00:00", "7"]]),
    ], "result_id long, columns array<struct<name:string,type_name:string>>, data_array array<array<string>>")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("ok", T.BooleanType()),
                           T.StructField("t", T.TimestampNTZType())])
    got = sorted((r.result_id, r.row_pos, r.a, r.ok, r.t) for r in decode_result(raw, schema).collect())
    assert got == [(1, 0, 1, True, dt.datetime(2024, 1, 1)), (1, 1, None, False, None),
                   (2, 0, 7, None, dt.datetime(2024, 2, 2, 10))]


def test_any_foundation_exploded(spark):
    from resgov.functions.foundation import any_foundation
    rows = spark.createDataFrame(
        [("e1", "x", "databricks-dbrx-instruct", None), ("e1", "y", "plain", None),
         ("e2", "z", "plain", None), ("e3", "z", None, ("gpt",))],
        "endpoint string, name string, entity_name string, external_model struct<name:string>")
    got = {r.endpoint: r.is_foundation_model for r in any_foundation(rows).collect()}
    assert got == {"e1": True, "e2": False, "e3": True}


def test_workspace_listing_with_urls(spark):
    inv = spark.createDataFrame([("1", "one"), ("1", "one"), ("2", "two")], "workspace_id string, workspace_name string")
    raw = spark.createDataFrame([("1", "https://one.example.com"), ("1", "https://one.example.com"),
                                 ("2", "https://two.example.com")], "workspace_id string, workspace_host string")
    got = {r.workspace_id: (r.workspace_name, r.url, r.n_resources)
           for r in S.workspaces(raw).collect()}
    assert got == {"1": ("one", "https://one.example.com", 2), "2": ("two", "https://two.example.com", 1)}


def variants(spark, rows):
    from resgov.schemas import RESULT_RAW
    schema = "result_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_RAW.fields)
    return C.decode_variants(spark.createDataFrame(rows, schema))


def test_variants_follow_each_results_own_types(spark):
    kinds = ["BOOLEAN", "BYTE", "int", "LONG", "FLOAT", "DOUBLE", "DECIMAL", "DATE", "TIMESTAMP", "STRING", "ARRAY", "STRUCT", "NOVEL", None]
    cells = ["TRUE", "7", "-3", "9007199254740993", "0.5", "1e3", "12.50", "2024-02-29", "2024-02-29 10:00:00", "x", "[1, \"a\"]", "{\"k\": null}", "as it is", "text"]
    bad = ["yes", "seven", "1.5", "", "a", "b", "c", "2024-02-30", "noon", None, "[1,", "{", None, None]
    manifest = [(f"c{i}", k) for i, k in enumerate(kinds)]
    rows = variants(spark, [(1, manifest, [cells, bad, cells[:2], []]), (2, [], [[]]), (3, manifest, []), (4, None, None)])
    got = {(r.result_id, r.row_pos): r for r in rows.select("result_id", "row_pos", F.to_json("row").alias("j"), F.schema_of_variant("row").alias("s")).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    first = json.loads(got[1, 0].j)
    assert [first[f"c{i}"] for i in range(14)] == [True, 7, -3, 9007199254740993, 0.5, 1000.0, 12.5, "2024-02-29", "2024-02-29 10:00:00", "x", [1, "a"], {"k": None}, "as it is", "text"]
    for part in ("c0: BOOLEAN", "c3: BIGINT", "c5: DOUBLE", "c6: DECIMAL(", "c7: DATE", "c8: TIMESTAMP_NTZ", "c9: STRING", "c10: ARRAY<VARIANT>", "c11: OBJECT<k: VOID>"):
        assert part in got[1, 0].s, part
    second = json.loads(got[1, 1].j)
    assert second["c0"] is False and all(second[f"c{i}"] is None for i in range(1, 14))
    third = json.loads(got[1, 2].j)
    assert third["c0"] is True and third["c1"] == 7 and third["c2"] is None and set(third) == set(first) and json.loads(got[1, 3].j)["c0"] is None and got[2, 0].j == "{}"


def test_variants_of_repeated_and_odd_names(spark):
    rows = variants(spark, [(1, [("a", "LONG"), ("b.c'd", "LONG"), ("a", "STRING"), (None, "LONG")], [["1", "2", "last", "4"]])])
    assert json.loads(rows.select(F.to_json("row")).first()[0]) == {"a": "last", "b.c'd": 2}
    out = C.typed(rows, T.StructType([T.StructField("b.c'd", T.LongType()), T.StructField("a", T.LongType()), T.StructField("gone", T.StringType())]))
    assert tuple(out.first()) == (1, 2, None, None)


def test_clashing_types_in_one_table(spark):
    raw = [(1, [("v", "LONG")], [["1"], ["2"]]), (2, [("v", "STRING"), ("w", "DATE")], [["x", "2024-01-01"]]), (3, [("v", "long")], [["3"]])]
    rows = variants(spark, raw)
    assert {r.result_id: r.row_schema for r in C.result_schemas(rows).collect()} == {1: "OBJECT<v: BIGINT>", 2: "OBJECT<v: STRING, w: DATE>", 3: "OBJECT<v: BIGINT>"}
    assert [r.row_schema for r in C.result_schemas(rows, ()).collect()] == ["OBJECT<v: VARIANT, w: DATE>"]
    assert sorted(r[0] for r in C.typed(rows, T.StructType([T.StructField("v", T.StringType())]), keep=()).collect()) == ["1", "2", "3", "x"]
    assert [tuple(r) for r in C.type_clashes(rows.sparkSession.createDataFrame(raw, "result_id int, columns array<struct<name:string,type_name:string>>, data_array array<array<string>>")).collect()] == [("v", "LONG,STRING", 2)]
