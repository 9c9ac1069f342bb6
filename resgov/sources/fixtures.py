"""Driver tables → domain tables.

Deterministic mapping (clock ``AS_OF``): customers are resources and nations
their workspaces; orders are approve/revoke decisions; lineitems are migration
ledger rows (one ledger per order, i.e. a fleet of schemas) and served
entities of endpoints; events, suppliers and parts land as the raw app,
vector-search and database feeds.  Every table here grows with the scale
factor; nothing is synthesised on the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import ntz
from .tables import table

AS_OF = _dt.datetime(1999, 1, 1)
# Foundation prefixes used with the driver tables (part names).
FIXTURE_PREFIXES = ("red", "blue")


def _s(col) -> Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def as_of() -> Column:
    return ntz(AS_OF)


def nation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return (c.join(nation(spark, sf), c.c_nationkey == F.col("n_nationkey"))
            .select(
                F.col("c_name").alias("name"),
                _s(key).alias("resource_id"),
                F.element_at(F.array(*[F.lit(s) for s in
                                       ("RUNNING", "ready", "STOPPED", "READ_ONLY", "UNKNOWN", "ACTIVE")]),
                             (key % 6 + 1).cast("int")).alias("state"),
                F.concat(F.lit("user"), _s(key % 20), F.lit("@example.com")).alias("creator"),
                F.lit(None).cast("timestamp_ntz").alias("created_at"),
                _s("c_nationkey").alias("workspace_id"),
                F.col("n_name").alias("workspace_name"),
                F.when(F.col("c_mktsegment") == "AUTOMOBILE", "app")
                 .when(F.col("c_mktsegment") == "BUILDING", "serving_endpoint")
                 .when(F.col("c_mktsegment") == "FURNITURE", "vector_search")
                 .when(F.col("c_mktsegment") == "HOUSEHOLD", "postgres")
                 .otherwise("other").alias("type"),
                F.lit("").alias("description"),
                ((F.col("c_mktsegment") == "BUILDING") & (key % 7 == 0)).alias("is_foundation_model"),
            ))


def _expiration_text(day: Column, key: Column) -> Column:
    date = F.date_format(day, "yyyy-MM-dd")
    return (F.when(key % 37 == 1, "2024-3-1").when(key % 37 == 2, "2024").when(key % 37 == 3, "10:00")
             .when(key % 37 == 4, "next spring").when(key % 37 == 5, "")
             .when(key % 3 == 0, F.concat(date, F.lit("T23:30:00-05:00")))
            .when(key % 3 == 1, date)
            .otherwise(F.concat(date, F.lit(" 12:00:00"))))


def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    key = F.col("o_orderkey")
    expiry_day = F.date_add(F.col("o_orderdate"), (key % 720).cast("int"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(nation(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("seq"),
                F.col("o_orderdate").alias("at"),
                F.when(key % 53 == 9, "extend").when(F.col("o_orderstatus") == "P", "revoke").otherwise("approve").alias("action"),
                F.when(key % 41 == 6, F.lit("")).when(key % 41 != 7, F.col("c_name")).alias("resource_name"),
                _s("c_custkey").alias("resource_id"),
                F.when((F.col("o_orderstatus") == "P") & (key % 43 == 8), F.lit("")).otherwise(_s("c_nationkey")).alias("workspace_id"),
                F.col("n_name").alias("workspace_name"),
                F.concat(F.lit("user"), _s(F.col("c_custkey") % 20), F.lit("@example.com")).alias("resource_creator"),
                F.concat(F.lit("clerk"), _s(key % 50)).alias("actor"),
                F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_orderstatus")).alias("reason"),
                F.when(F.col("o_orderstatus") == "O", _expiration_text(expiry_day, key)).alias("expiration_date"),
            ))


# Decisions before the cut build the starting registry; later ones are the
# batch applied to it (upsert / revoke operators).
CUT = _dt.datetime(1998, 1, 1)
# Instant for the time-travel query.
TRAVEL_TO = _dt.datetime(1997, 6, 30)


def _statement() -> Column:
    """What a ledger row ran: a table for every eleventh part, else a column."""
    part = _s("l_partkey")
    return (F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("CREATE TABLE t"), part, F.lit(" (id STRING)")))
            .otherwise(F.concat(F.lit("ALTER TABLE t ADD COLUMN c"), part, F.lit(" STRING"))))


def _version() -> Column:
    """Even keys their line number, odd keys one off for some parts; some have none."""
    return (F.when(F.col("l_suppkey") % 29 == 0, F.lit(None))
            .when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber"))
            .otherwise(F.col("l_linenumber") + (F.col("l_partkey") % 5 == 0).cast("int"))).cast("int")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One migration ledger per order, a row per line: a map over lineitem."""
    li = table(spark, sf, "lineitem")
    sql = _statement()
    failed = F.col("l_returnflag") == "R"
    return li.select(
        _s("l_orderkey").alias("schema_key"),
        _version().alias("version"),
        F.concat(F.lit("step "), _s("l_linenumber")).alias("description"),
        sql.alias("sql_statement"),
        F.when(F.col("l_partkey") % 13 == 0, F.sha2(F.concat(sql, F.lit(" ")), 256)).otherwise(F.sha2(sql, 256)).alias("checksum"),
        F.when(failed, "failed").otherwise("applied").alias("status"),
        F.col("l_shipdate").alias("applied_at"),
        (F.col("l_quantity") / 10.0).alias("execution_time_seconds"),
        F.when(failed & (F.col("l_linestatus") == "F"), "FIELD_ALREADY_EXISTS: c")
         .when(failed & (F.col("l_suppkey") % 3 == 0), "PERMISSION_DENIED: t")
         .when(failed, "TABLE_OR_VIEW_NOT_FOUND: t").alias("error_message"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").alias("updated_at"),
        F.lit("system").alias("created_by"),
        F.lit("system").alias("updated_by"),
        F.col("l_partkey").alias("tie1"),
        F.col("l_suppkey").alias("tie2"),
    )


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Migration definitions per schema, listed by ship day, line and part; some fields
    missing, every seventeenth schema without any, some statements edited since."""
    li = table(spark, sf, "lineitem").filter(F.col("l_orderkey") % 17 != 0)
    day = F.datediff(F.col("l_shipdate"), F.lit("1990-01-01")).cast("long")
    position = ((day * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    return li.select(
        _s("l_orderkey").alias("schema_key"),
        position.cast("long").alias("position"),
        _version().alias("version"),
        F.when(F.col("l_partkey") % 17 != 0, F.concat(F.lit("step "), _s("l_linenumber"))).alias("description"),
        F.when(F.col("l_suppkey") % 19 != 0,
               F.concat(_statement(), F.when(F.col("l_partkey") % 7 == 0, F.lit(" -- edited")).otherwise(F.lit("")))).alias("sql"),
    )


def _host(name: Column) -> Column:
    return F.concat(F.lit("https://"), F.lower(F.regexp_replace(name, " ", "-")), F.lit(".cloud.example.com"))


def _json_string(col: Column) -> Column:
    return F.concat(F.lit('"'), col, F.lit('"'))


def _json_state(col: Column) -> Column:
    return F.concat(F.lit('{"state": "'), col, F.lit('"}'))


def apps_raw(spark: SparkSession, sf: str) -> DataFrame:
    """App feed from events; status as JSON object, JSON string, fallback or missing."""
    e = table(spark, sf, "events")
    key = F.col("event_id")
    kind = key % 5
    ws = (F.col("user_id") % 25).cast("int")
    up = F.upper(F.col("event_type"))
    return (e.join(nation(spark, sf), ws == F.col("n_nationkey"))
            .select(
                key.alias("line_no"),
                F.concat(F.lit("app-"), _s(key)).alias("name"),
                F.when(key % 7 != 0, F.concat(F.lit("user"), _s("user_id"), F.lit("@example.com"))).alias("creator"),
                F.when(F.col("event_type") != "view",
                       F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("create_time"),
                F.when(key % 3 != 0, F.concat(F.lit("App for "), F.col("event_type"))).alias("description"),
                F.when(kind == 0, _json_state(up)).when(kind == 1, _json_string(up))
                 .when(kind == 3, _json_state(F.lit("UNKNOWN"))).alias("compute_status"),
                F.when(kind == 2, _json_state(F.lower(F.col("event_type"))))
                 .when(kind == 3, _json_string(F.lit("STOPPED"))).alias("app_status"),
                _s("n_nationkey").alias("workspace_id"),
                _host(F.col("n_name")).alias("workspace_host"),
            ))


def endpoints_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Serving-endpoint feed: one endpoint per order, one served entity per line."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    has_ext = (F.col("l_returnflag") == "R") & (F.col("p_size") > 45)
    entities = (li.join(p, li.l_partkey == p.p_partkey)
                .select(
                    F.col("l_orderkey").alias("endpoint_key"),
                    F.struct(
                        F.col("l_linenumber").alias("pos"),
                        F.col("p_name").alias("order_name"),
                        has_ext.alias("order_ext"),
                        F.struct(
                            F.concat(F.lit("entity-"), _s("l_linenumber")).alias("name"),
                            F.when(F.col("l_linenumber") % 3 != 0, F.col("p_name")).alias("entity_name"),
                            _s("p_size").alias("entity_version"),
                            F.when(has_ext, F.struct(F.col("p_name").alias("name"))).alias("external_model"),
                        ).alias("entity"),
                    ).alias("e"))
                .groupBy("endpoint_key")
                .agg(F.array_sort(F.collect_list("e")).alias("es"))
                .select("endpoint_key", F.transform("es", lambda x: x["entity"]).alias("served_entities")))
    key = F.col("o_orderkey")
    ready = (F.when(F.col("o_orderstatus") == "F", "READY")
             .when(F.col("o_orderstatus") == "O", "NOT_READY"))
    models = F.when(key % 2 == 0, F.array(F.struct(F.concat(F.lit("legacy-model-"), _s(key)).alias("model_name"))))
    return (o.join(entities, o.o_orderkey == entities.endpoint_key, "left")
            .join(c, o.o_custkey == c.c_custkey)
            .join(nation(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("line_no"),
                F.when(key % 10 != 0, F.concat(F.lit("ep-"), _s(key))).alias("id"),
                F.concat(F.lit("endpoint-"), _s(key)).alias("name"),
                F.when(key % 9 != 0, F.concat(F.lit("clerk"), _s(key % 50))).alias("creator"),
                F.when(key % 11 != 0, F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("creation_timestamp"),
                F.when(key % 4 == 0, F.concat(F.lit("Endpoint for order "), _s(key)))
                 .when(key % 4 == 1, F.lit("")).alias("description"),
                F.when(key % 13 != 0, F.struct(ready.alias("ready"))).alias("state"),
                F.struct(
                    F.coalesce(F.col("served_entities"),
                               F.array().cast("array<struct<name:string,entity_name:string,entity_version:string,"
                                              "external_model:struct<name:string>>>")).alias("served_entities"),
                    F.coalesce(models, F.array().cast("array<struct<model_name:string>>")).alias("served_models"),
                ).alias("config"),
                _s("n_nationkey").alias("workspace_id"),
                _host(F.col("n_name")).alias("workspace_host"),
            ))


def vector_raw(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    return (s.join(nation(spark, sf), s.s_nationkey == F.col("n_nationkey"))
            .select(
                key.alias("line_no"),
                F.col("s_name").alias("name"),
                F.when(key % 4 != 0, F.concat(F.lit("owner"), _s(key % 10))).alias("creator"),
                F.when(key % 6 != 0, F.lit(1_700_000_000_000) + key * 1000).alias("creation_timestamp"),
                F.when(F.col("s_acctbal") >= 0, F.lit("STANDARD")).alias("endpoint_type"),
                F.when(key % 3 == 0, F.struct(F.lit("ONLINE").alias("state")))
                 .when(key % 3 == 1, F.struct(F.lit(None).cast("string").alias("state"))).alias("endpoint_status"),
                _s("n_nationkey").alias("workspace_id"),
                _host(F.col("n_name")).alias("workspace_host"),
            ))


def databases_raw(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    kind = key % 4
    ws = (key % 25).cast("int")
    return (p.join(nation(spark, sf), ws == F.col("n_nationkey"))
            .select(
                key.alias("line_no"),
                F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit(""))
                 .otherwise(F.concat(F.lit("db-"), _s(key))).alias("uid"),
                F.when(key % 5 != 0, F.col("p_name")).alias("name"),
                F.col("p_brand").alias("creator"),
                F.when(key % 3 == 0, F.lit("2024-05-01T08:00:00Z")).alias("created_at"),
                F.when(kind == 0, F.col("p_type")).when(kind == 1, F.lit("")).alias("comment"),
                F.when(kind == 1, F.col("p_brand")).when(kind == 2, F.lit("")).alias("description"),
                F.when(kind == 2, F.concat(F.lit("db"), _s(key), F.lit(".example.com")))
                 .when(kind == 3, F.lit("")).alias("read_write_dns"),
                F.when(F.col("p_size") < 10, "STOPPED").when(F.col("p_size") >= 20, "AVAILABLE").alias("state"),
                F.when(F.col("p_size") % 2 == 0, F.lit("STARTING")).alias("status"),
                _s("n_nationkey").alias("workspace_id"),
                _host(F.col("n_name")).alias("workspace_host"),
            ))


def landed(spark: SparkSession, sf: str) -> DataFrame:
    """The four feeds as landed JSON text (type, line_no, line); every 61st line is cut off, every 67th is no JSON."""
    out = None
    for kind, raw in (("app", apps_raw(spark, sf)), ("serving_endpoint", endpoints_raw(spark, sf)),
                      ("vector_search", vector_raw(spark, sf)), ("postgres", databases_raw(spark, sf))):
        line = F.to_json(F.struct(*[c for c in raw.columns if c != "line_no"]))
        no = F.col("line_no")
        rows = raw.select(F.lit(kind).alias("type"), no.cast("long").alias("line_no"),
                          F.when(no % 61 == 0, F.substring(line, 1, 20)).when(no % 67 == 0, F.lit("<html>"))
                          .otherwise(line).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def result_raw(spark: SparkSession, sf: str, chunk_rows: int = 100) -> DataFrame:
    """Warehouse-style string results of an orders query, chunked to at most
    ``chunk_rows`` rows per result; odd chunks list their columns in reverse
    order so decoding must go by name, not position."""
    o = table(spark, sf, "orders")
    chunk = F.floor(F.col("o_orderkey") / chunk_rows)
    odd = chunk % 2 == 1
    cols = [("o_orderkey", "LONG", _s("o_orderkey")),
            ("o_orderstatus", "STRING", F.col("o_orderstatus")),
            ("is_open", "BOOLEAN", F.when(F.col("o_orderstatus") == "O", "TRUE").otherwise("false")),
            ("o_totalprice", "DOUBLE", _s("o_totalprice")),
            ("o_orderdate", "TIMESTAMP", _s("o_orderdate"))]
    manifest = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type_name")) for n, t, _ in cols])
    row = F.array(*[v for _, _, v in cols])
    # every 31st row ends after three fields
    cut = lambda r: F.when(F.col("o_orderkey") % 31 == 0, F.slice(r, 1, 3)).otherwise(r)
    return (o.select(chunk.alias("result_id"), odd.alias("odd"), F.col("o_orderkey"),
                     cut(F.when(odd, F.reverse(row)).otherwise(row)).alias("row"))
            .groupBy("result_id", "odd")
            .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))).alias("rows"))
            .select("result_id",
                    F.when(F.col("odd"), F.reverse(manifest)).otherwise(manifest).alias("columns"),
                    F.transform("rows", lambda r: r["row"]).alias("data_array")))


def result_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The string results with manifests that do not agree: prices are text, doubles or
    decimals by result, and every fifth result calls its order keys text."""
    price = F.element_at(F.array(*map(F.lit, ("STRING", "DOUBLE", "DECIMAL"))), (F.col("result_id") % 3 + 1).cast("int"))
    kind = lambda c: (F.when(c["name"] == "o_totalprice", price)
                      .when((c["name"] == "o_orderkey") & (F.col("result_id") % 5 == 0), F.lit("STRING")).otherwise(c["type_name"]))
    return result_raw(spark, sf).withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), kind(c).alias("type_name"))))


def approval_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Was the customer's resource approved when each of its lines shipped?"""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp_ntz").alias("asked_at"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("c_custkey"))
    owners = table(spark, sf, "customer").select("c_custkey", _s("c_custkey").alias("resource_id"), _s("c_nationkey").alias("workspace_id"))
    return lines.join(orders, "order_id").join(owners, "c_custkey").select("order_id", "line", "resource_id", "workspace_id", "asked_at")


def damaged(registry: DataFrame) -> DataFrame:
    """A copy with faults in the workspaces 3 (rows changed), 7 (rows lost) and 11 (rows doubled)."""
    nth, ws = F.col("resource_id").cast("long") % 5 == 0, F.col("workspace_id")
    changed = registry.withColumn("approved_by", F.when((ws == "3") & nth, F.lit("somebody")).otherwise(F.col("approved_by")))
    return changed.filter(~((ws == "7") & nth)).unionByName(registry.filter((ws == "11") & nth))


def workspaces_of_region(spark: SparkSession, sf: str, region: str) -> DataFrame:
    """Ids of a region's workspaces."""
    regions = table(spark, sf, "region").filter(F.col("r_name") == region).select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf, "nation").join(F.broadcast(regions), "n_regionkey").select(_s("n_nationkey").alias("workspace_id"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")
