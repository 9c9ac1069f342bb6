"""Domain schemas.

The registry and ledger layouts follow the reference's two tables (registry
with ``revoked_reason`` added by schema version 2).  Timestamps are
``TIMESTAMP_NTZ``: every instant is a UTC wall-clock value, which is what the
reference stores and what keeps results identical across session zones.
"""

from pyspark.sql import types as T

TS = T.TimestampNTZType()

KEY = ["resource_id", "workspace_id"]

MONITORED_TYPES = ["app", "serving_endpoint", "vector_search", "postgres"]


def _field(name, dtype, comment=None, nullable=True):
    meta = {"comment": comment} if comment else {}
    return T.StructField(name, dtype, nullable, meta)


INVENTORY = T.StructType([
    _field("name", T.StringType()),
    _field("resource_id", T.StringType()),
    _field("state", T.StringType()),
    _field("creator", T.StringType()),
    _field("created_at", TS),
    _field("workspace_id", T.StringType()),
    _field("workspace_name", T.StringType()),
    _field("type", T.StringType()),
    _field("description", T.StringType()),
    _field("is_foundation_model", T.BooleanType()),
])

DECISION_LOG = T.StructType([
    _field("seq", T.LongType()),
    _field("at", TS),
    _field("action", T.StringType(), "approve | revoke"),
    _field("resource_name", T.StringType()),
    _field("resource_id", T.StringType()),
    _field("workspace_id", T.StringType()),
    _field("workspace_name", T.StringType()),
    _field("resource_creator", T.StringType()),
    _field("actor", T.StringType()),
    _field("reason", T.StringType()),
    _field("expiration_date", T.StringType(), "as written by the requester"),
])

REGISTRY_V1 = T.StructType([
    _field("resource_name", T.StringType(), "what the resource is called"),
    _field("resource_id", T.StringType(), "id of the resource inside its workspace"),
    _field("workspace_id", T.StringType(), "id of the workspace it lives in"),
    _field("workspace_name", T.StringType(), "how the workspace is shown"),
    _field("resource_creator", T.StringType(), "who made the resource"),
    _field("approved_by", T.StringType(), "who said yes"),
    _field("approval_date", TS, "when it was approved (UTC)"),
    _field("expiration_date", TS, "day the approval ends, if any"),
    _field("justification", T.StringType(), "why it was approved"),
    _field("is_approved", T.BooleanType(), "false once revoked"),
    _field("revoked_date", TS, "when it was revoked (UTC)"),
    _field("revoked_by", T.StringType(), "who revoked it"),
    _field("updated_at", TS, "last change of the row (UTC)"),
])

REGISTRY = T.StructType(REGISTRY_V1.fields + [
    _field("revoked_reason", T.StringType(), "why it was revoked"),
])

# Column order of the registry as the reference's table ends up after
# ALTER TABLE ... ADD COLUMN (new column last).
REGISTRY_COLUMNS = [f.name for f in REGISTRY.fields]

# The 13 columns the active-approval scan hands on (updated_at dropped).
ACTIVE_COLUMNS = [c for c in REGISTRY_COLUMNS if c != "updated_at"]

STATUS_COLUMNS = [
    "name", "resource_id", "state", "creator", "created_at", "workspace_id",
    "workspace_name", "type", "description", "is_foundation_model", "is_approved",
    "approval_date", "approved_by", "expiration_date", "justification",
]

LEDGER = T.StructType([
    _field("schema_key", T.StringType(), "which schema this ledger belongs to"),
    _field("version", T.IntegerType(), "number of the migration, from 1"),
    _field("description", T.StringType()),
    _field("sql_statement", T.StringType()),
    _field("checksum", T.StringType(), "SHA-256 of sql_statement"),
    _field("status", T.StringType(), "applied | failed"),
    _field("applied_at", TS),
    _field("execution_time_seconds", T.DoubleType()),
    _field("error_message", T.StringType()),
    _field("created_at", TS),
    _field("updated_at", TS),
    _field("created_by", T.StringType()),
    _field("updated_by", T.StringType()),
])

DEFINITIONS = T.StructType([
    _field("schema_key", T.StringType()),
    _field("position", T.IntegerType(), "order in which the definitions are listed"),
    _field("version", T.IntegerType()),
    _field("description", T.StringType()),
    _field("sql", T.StringType()),
])

ENTITY = T.StructType([
    _field("name", T.StringType()),
    _field("entity_name", T.StringType()),
    _field("entity_version", T.StringType()),
    _field("external_model", T.StructType([_field("name", T.StringType())])),
])

ENDPOINTS_RAW = T.StructType([
    _field("id", T.StringType()),
    _field("name", T.StringType()),
    _field("creator", T.StringType()),
    _field("creation_timestamp", T.LongType(), "epoch milliseconds"),
    _field("description", T.StringType()),
    _field("state", T.StructType([_field("ready", T.StringType())])),
    _field("config", T.StructType([
        _field("served_entities", T.ArrayType(ENTITY)),
        _field("served_models", T.ArrayType(T.StructType([_field("model_name", T.StringType())]))),
    ])),
    _field("workspace_id", T.StringType()),
    _field("workspace_host", T.StringType()),
])

RESULT_RAW = T.StructType([
    _field("columns", T.ArrayType(T.StructType([
        _field("name", T.StringType()), _field("type_name", T.StringType())]))),
    _field("data_array", T.ArrayType(T.ArrayType(T.StringType()))),
])


# What is read from a landed JSON record of each feed; other fields are ignored.
_HOST = "workspace_id STRING, workspace_host STRING"
LANDED = {
    "app": f"name STRING, creator STRING, create_time STRING, description STRING, compute_status STRING, app_status STRING, {_HOST}",
    "serving_endpoint": "id STRING, name STRING, creator STRING, creation_timestamp BIGINT, description STRING, state STRUCT<ready: STRING>, "
                        "config STRUCT<served_entities: ARRAY<STRUCT<name: STRING, entity_name: STRING, entity_version: STRING, "
                        f"external_model: STRUCT<name: STRING>>>, served_models: ARRAY<STRUCT<model_name: STRING>>>, {_HOST}",
    "vector_search": f"name STRING, creator STRING, creation_timestamp BIGINT, endpoint_type STRING, endpoint_status STRUCT<state: STRING>, {_HOST}",
    "postgres": "uid STRING, name STRING, creator STRING, created_at STRING, comment STRING, description STRING, read_write_dns STRING, "
                f"state STRING, status STRING, {_HOST}",
}
