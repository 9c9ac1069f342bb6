"""DuckDB oracle SQL for the registered queries.

Independent re-statements of each query over the same parquet tables: the
domain mapping is written again as SQL CTEs, folds use ``row_number`` instead
of struct maxima, neighbours use ``lead``/``lag`` windows, descriptions use
``string_agg`` instead of nested arrays.  Column names match the Spark side.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"
CUT = "TIMESTAMP '1998-01-01 00:00:00'"
TRAVEL_TO = "TIMESTAMP '1997-06-30 00:00:00'"
WS = "'7'"

INV = """
inv AS (
  SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS resource_id,
    CASE c_custkey % 6 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'ready' WHEN 2 THEN 'STOPPED' WHEN 3 THEN 'READ_ONLY'
         WHEN 4 THEN 'UNKNOWN' ELSE 'ACTIVE' END AS state,
    concat('user', CAST(c_custkey % 20 AS VARCHAR), '@example.com') AS creator,
    CAST(NULL AS TIMESTAMP) AS created_at,
    CAST(c_nationkey AS VARCHAR) AS workspace_id, n_name AS workspace_name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'app' WHEN 'BUILDING' THEN 'serving_endpoint' WHEN 'FURNITURE' THEN 'vector_search'
         WHEN 'HOUSEHOLD' THEN 'postgres' ELSE 'other' END AS type,
    '' AS description,
    c_mktsegment = 'BUILDING' AND c_custkey % 7 = 0 AS is_foundation_model
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

LOG = """
log AS (
  SELECT o_orderkey AS seq, o_orderdate AS "at",
    CASE WHEN o_orderkey % 53 = 9 THEN 'extend' WHEN o_orderstatus = 'P' THEN 'revoke' ELSE 'approve' END AS action,
    CASE WHEN o_orderkey % 41 = 6 THEN '' WHEN o_orderkey % 41 <> 7 THEN c_name END AS resource_name,
    CAST(c_custkey AS VARCHAR) AS resource_id,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 43 = 8 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS workspace_id,
    n_name AS workspace_name, concat('user', CAST(c_custkey % 20 AS VARCHAR), '@example.com') AS resource_creator,
    concat('clerk', CAST(o_orderkey % 50 AS VARCHAR)) AS actor,
    concat(o_orderpriority, ' #', o_orderstatus) AS reason,
    CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 37 WHEN 1 THEN '2024-3-1' WHEN 2 THEN '2024' WHEN 3 THEN '10:00'
        WHEN 4 THEN 'next spring' WHEN 5 THEN '' ELSE
      strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 720 AS INTEGER), '%Y-%m-%d')
      || CASE o_orderkey % 3 WHEN 0 THEN 'T23:30:00-05:00' WHEN 1 THEN '' ELSE ' 12:00:00' END END END AS expiration_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
checked AS (
  SELECT *, CASE
    WHEN action = 'approve' THEN CASE
      WHEN resource_name IS NULL OR resource_name = '' OR resource_id IS NULL OR resource_id = ''
        THEN 'Resource name and ID are required'
      WHEN reason IS NULL OR length(trim(reason)) < 10 THEN 'Justification must be at least 10 characters'
      WHEN expiration_date IS NOT NULL AND expiration_date <> '' AND NOT regexp_matches(expiration_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')
        THEN 'Invalid expiration date' END
    WHEN action = 'revoke' THEN CASE
      WHEN resource_id IS NULL OR resource_id = '' OR workspace_id IS NULL OR workspace_id = ''
        THEN 'Resource ID and workspace ID are required'
      WHEN reason IS NULL OR length(trim(reason)) < 10 THEN 'Revocation reason must be at least 10 characters' END
    ELSE 'Unknown action' END AS error
  FROM log),
valid AS (SELECT * EXCLUDE (error) FROM checked WHERE error IS NULL)"""


def fold(src: str, name: str) -> str:
    """Registry CTE ``name`` from valid decisions in CTE ``src`` (sequential-replay result)."""
    return f"""
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY resource_id, workspace_id ORDER BY "at" DESC, seq DESC) AS rn
             FROM {src} WHERE action = 'approve'),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY resource_id, workspace_id ORDER BY "at" DESC, seq DESC) AS rn
             FROM {src} WHERE action = 'revoke'),
{name} AS (
  SELECT a.resource_name, a.resource_id, a.workspace_id, a.workspace_name, a.resource_creator,
    a.actor AS approved_by, date_trunc('second', a."at") AS approval_date,
    TRY_CAST(nullif(substr(trim(a.expiration_date), 1, 10), '') AS TIMESTAMP) AS expiration_date,
    a.reason AS justification, r.seq IS NULL AS is_approved,
    date_trunc('second', r."at") AS revoked_date, r.actor AS revoked_by,
    CASE WHEN r.seq IS NULL THEN date_trunc('second', a."at") ELSE date_trunc('second', r."at") END AS updated_at,
    r.reason AS revoked_reason
  FROM {name}_a a LEFT JOIN {name}_r r
    ON r.rn = 1 AND r.resource_id = a.resource_id AND r.workspace_id = a.workspace_id
   AND (r."at" > a."at" OR (r."at" = a."at" AND r.seq > a.seq))
  WHERE a.rn = 1)"""


REG_COLS = ("resource_name, resource_id, workspace_id, workspace_name, resource_creator, approved_by, approval_date, "
            "expiration_date, justification, is_approved, revoked_date, revoked_by, updated_at, revoked_reason")
ACTIVE_COLS = REG_COLS.replace(" updated_at,", "")

STATUS = f"""
act AS (SELECT * FROM reg WHERE is_approved AND revoked_date IS NULL),
joined AS (
  SELECT i.*, a.approval_date AS a_date, a.approved_by AS a_by, a.expiration_date AS a_exp, a.justification AS a_why,
    (a.resource_id IS NOT NULL AND (a.expiration_date IS NULL OR a.expiration_date >= {AS_OF})) AS live
  FROM inv i LEFT JOIN act a ON a.resource_id = i.resource_id AND a.workspace_id = i.workspace_id),
status AS (
  SELECT name, resource_id, state, creator, created_at, workspace_id, workspace_name, type, description,
    is_foundation_model,
    is_foundation_model OR live AS is_approved,
    CASE WHEN is_foundation_model THEN {AS_OF} WHEN live THEN a_date END AS approval_date,
    CASE WHEN is_foundation_model THEN 'system' WHEN live THEN a_by END AS approved_by,
    CASE WHEN is_foundation_model THEN NULL WHEN live THEN a_exp END AS expiration_date,
    CASE WHEN is_foundation_model THEN 'Automatically approved - Databricks Foundation Model'
         WHEN live THEN a_why END AS justification
  FROM joined)"""


def with_status() -> str:
    return "WITH " + ",".join([INV, LOG, fold("valid", "reg"), STATUS])


def with_reg() -> str:
    return "WITH " + ",".join([LOG, fold("valid", "reg")])


HOST_NAME = "lower(replace(n_name, ' ', '-'))"

STATE_OF = ("CASE WHEN {d} IS NULL THEN 'UNKNOWN' "
            "WHEN ltrim({d}) LIKE '{{%' THEN coalesce(json_extract_string({d}, '$.state'), 'UNKNOWN') "
            "WHEN ltrim({d}) LIKE '\"%' THEN coalesce(json_extract_string({d}, '$'), 'UNKNOWN') "
            "ELSE 'UNKNOWN' END")

FEEDS = f"""
apps_raw AS (
  SELECT 'app-' || CAST(event_id AS VARCHAR) AS name,
    CASE WHEN event_id % 7 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) || '@example.com' END AS creator,
    CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS create_time,
    CASE WHEN event_id % 3 <> 0 THEN 'App for ' || event_type END AS description,
    CASE event_id % 5 WHEN 0 THEN '{{"state": "' || upper(event_type) || '"}}'
                      WHEN 1 THEN '"' || upper(event_type) || '"'
                      WHEN 3 THEN '{{"state": "UNKNOWN"}}' END AS compute_status,
    CASE event_id % 5 WHEN 2 THEN '{{"state": "' || lower(event_type) || '"}}' WHEN 3 THEN '"STOPPED"' END AS app_status,
    CAST(n_nationkey AS VARCHAR) AS workspace_id, {HOST_NAME} AS workspace_name
  FROM events JOIN nation ON CAST(user_id % 25 AS INTEGER) = n_nationkey),
apps_state AS (
  SELECT *, {STATE_OF.format(d='compute_status')} AS s1, {STATE_OF.format(d='app_status')} AS s2 FROM apps_raw),
feed_apps AS (
  SELECT coalesce(name, '') AS name, coalesce(name, '') AS resource_id,
    CASE WHEN s1 = 'UNKNOWN' AND app_status IS NOT NULL THEN s2 ELSE s1 END AS state,
    coalesce(creator, 'unknown') AS creator,
    CASE WHEN create_time IS NOT NULL AND create_time <> '' THEN strptime(create_time, '%Y-%m-%dT%H:%M:%SZ') END
      AS created_at,
    workspace_id, workspace_name, 'app' AS type, coalesce(description, '') AS description,
    false AS is_foundation_model
  FROM apps_state),
ents AS (
  SELECT l_orderkey AS k, l_linenumber AS pos, p_name AS order_name, (l_returnflag = 'R' AND p_size > 45) AS has_ext,
    'entity-' || CAST(l_linenumber AS VARCHAR) AS e_name,
    CASE WHEN l_linenumber % 3 <> 0 THEN p_name END AS e_entity_name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ents2 AS (
  SELECT *, has_ext OR (coalesce(nullif(e_entity_name, ''), e_name) <> ''
                        AND (starts_with(coalesce(nullif(e_entity_name, ''), e_name), 'red')
                             OR starts_with(coalesce(nullif(e_entity_name, ''), e_name), 'blue'))) AS fm,
    coalesce(nullif(e_entity_name, ''), nullif(e_name, ''), 'Unknown') AS label
  FROM ents),
ep_agg AS (
  SELECT k, bool_or(fm) AS any_fm, count(*) AS n_entities,
    string_agg(label || CASE WHEN fm THEN ' (Foundation Model)' ELSE '' END, ', ' ORDER BY pos, order_name, has_ext)
      AS serving
  FROM ents2 GROUP BY k),
ep AS (
  SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'ep-' || CAST(o_orderkey AS VARCHAR) END AS id,
    'endpoint-' || CAST(o_orderkey AS VARCHAR) AS name,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'clerk' || CAST(o_orderkey % 50 AS VARCHAR) END AS creator,
    CASE WHEN o_orderkey % 11 <> 0 THEN epoch_ms(o_orderdate) END AS creation_timestamp,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Endpoint for order ' || CAST(o_orderkey AS VARCHAR)
         WHEN o_orderkey % 4 = 1 THEN '' END AS description,
    CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'READY'
                                             WHEN o_orderstatus = 'O' THEN 'NOT_READY' END END AS ready,
    CASE WHEN o_orderkey % 2 = 0 THEN 'legacy-model-' || CAST(o_orderkey AS VARCHAR) END AS model,
    CAST(n_nationkey AS VARCHAR) AS workspace_id, {HOST_NAME} AS workspace_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ep_full AS (SELECT ep.*, a.k AS a_k, a.any_fm, a.n_entities, a.serving FROM ep LEFT JOIN ep_agg a ON a.k = ep.k),
feed_endpoints AS (
  SELECT name, coalesce(nullif(id, ''), name) AS resource_id, coalesce(ready, 'UNKNOWN') AS state,
    coalesce(nullif(creator, ''), 'unknown') AS creator,
    CASE WHEN creation_timestamp IS NOT NULL AND creation_timestamp <> 0 THEN epoch_ms(creation_timestamp) END
      AS created_at,
    workspace_id, workspace_name, 'serving_endpoint' AS type,
    CASE WHEN a_k IS NOT NULL THEN coalesce(nullif(description, ''), 'Serving: ' || serving)
         WHEN model IS NOT NULL THEN 'Serving models: ' || model
         ELSE coalesce(description, '') END AS description,
    coalesce(any_fm, false) AS is_foundation_model
  FROM ep_full),
feed_vector AS (
  SELECT s_name AS name, s_name AS resource_id,
    CASE WHEN s_suppkey % 3 = 0 THEN 'ONLINE' ELSE 'UNKNOWN' END AS state,
    coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN 'owner' || CAST(s_suppkey % 10 AS VARCHAR) END, 'unknown') AS creator,
    CASE WHEN s_suppkey % 6 <> 0 THEN epoch_ms(1700000000000 + s_suppkey * 1000) END AS created_at,
    CAST(n_nationkey AS VARCHAR) AS workspace_id, {HOST_NAME} AS workspace_name, 'vector_search' AS type,
    CASE WHEN s_acctbal >= 0 THEN 'Type: STANDARD' ELSE '' END AS description, false AS is_foundation_model
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
db_raw AS (
  SELECT p_partkey AS pk, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'db-' || CAST(p_partkey AS VARCHAR) END AS uid,
    CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, p_brand AS creator,
    CASE WHEN p_partkey % 3 = 0 THEN '2024-05-01T08:00:00Z' END AS created_at,
    CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN '' END AS comment,
    CASE p_partkey % 4 WHEN 1 THEN p_brand WHEN 2 THEN '' END AS description,
    CASE p_partkey % 4 WHEN 2 THEN 'db' || CAST(p_partkey AS VARCHAR) || '.example.com' WHEN 3 THEN '' END
      AS read_write_dns,
    CASE WHEN p_size < 10 THEN 'STOPPED' WHEN p_size >= 20 THEN 'AVAILABLE' END AS state,
    CASE WHEN p_size % 2 = 0 THEN 'STARTING' END AS status,
    CAST(n_nationkey AS VARCHAR) AS workspace_id, {HOST_NAME} AS workspace_name
  FROM part JOIN nation ON CAST(p_partkey % 25 AS INTEGER) = n_nationkey),
feed_db_keyed AS (
  SELECT coalesce(name, uid, '') AS name, coalesce(uid, name, '') AS resource_id,
    coalesce(state, status, 'RUNNING') AS state, coalesce(creator, 'unknown') AS creator,
    CASE WHEN created_at IS NOT NULL AND created_at <> '' THEN strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') END
      AS created_at,
    workspace_id, workspace_name, 'postgres' AS type,
    coalesce(nullif(comment, ''), nullif(description, ''),
             CASE WHEN read_write_dns IS NOT NULL AND read_write_dns <> '' THEN 'Host: ' || read_write_dns END, '')
      AS description,
    false AS is_foundation_model, pk
  FROM db_raw),
feed_db AS (SELECT * EXCLUDE (pk) FROM feed_db_keyed),
feed_inv AS (
  SELECT * FROM feed_apps UNION ALL SELECT * FROM feed_endpoints
  UNION ALL SELECT * FROM feed_vector UNION ALL SELECT * FROM feed_db)"""


def with_feeds() -> str:
    return "WITH " + FEEDS


LEDGER = """
li AS (
  SELECT *, CASE WHEN l_partkey % 11 = 0 THEN 'CREATE TABLE t' || CAST(l_partkey AS VARCHAR) || ' (id STRING)'
                 ELSE 'ALTER TABLE t ADD COLUMN c' || CAST(l_partkey AS VARCHAR) || ' STRING' END AS stmt,
    CAST(CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_orderkey % 2 = 0 OR l_partkey % 5 <> 0 THEN l_linenumber
              ELSE l_linenumber + 1 END AS INTEGER) AS ver
  FROM lineitem),
ledger AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS schema_key, ver AS version, 'step ' || CAST(l_linenumber AS VARCHAR) AS description,
    stmt AS sql_statement, CASE WHEN l_partkey % 13 = 0 THEN sha256(stmt || ' ') ELSE sha256(stmt) END AS checksum,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'applied' END AS status,
    l_shipdate AS applied_at, l_quantity / 10.0 AS execution_time_seconds,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'FIELD_ALREADY_EXISTS: c'
         WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 'PERMISSION_DENIED: t'
         WHEN l_returnflag = 'R' THEN 'TABLE_OR_VIEW_NOT_FOUND: t' END AS error_message,
    l_shipdate AS created_at, l_shipdate AS updated_at, 'system' AS created_by, 'system' AS updated_by,
    l_partkey AS tie1, l_suppkey AS tie2
  FROM li),
defs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS schema_key,
    CAST(((date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 10 + l_linenumber) * 10000000 + l_partkey) * 100000
         + l_suppkey AS BIGINT) AS position,
    ver AS version,
    CASE WHEN l_partkey % 17 <> 0 THEN 'step ' || CAST(l_linenumber AS VARCHAR) END AS description,
    CASE WHEN l_suppkey % 19 <> 0 THEN stmt || CASE WHEN l_partkey % 7 = 0 THEN ' -- edited' ELSE '' END END AS sql
  FROM li WHERE l_orderkey % 17 <> 0),
applied_v AS (SELECT DISTINCT schema_key, version FROM ledger WHERE status = 'applied' AND version IS NOT NULL),
defined_v AS (SELECT DISTINCT schema_key, version FROM defs WHERE version IS NOT NULL),
pending_v AS (SELECT d.* FROM defined_v d WHERE NOT EXISTS (
  SELECT 1 FROM applied_v a WHERE a.schema_key = d.schema_key AND a.version = d.version))"""


def with_ledger() -> str:
    return "WITH " + LEDGER


LEDGER_COLS = ("schema_key, version, description, sql_statement, checksum, status, applied_at, execution_time_seconds, "
               "error_message, created_at, updated_at, created_by, updated_by")

TYPES = "(VALUES ('app'), ('serving_endpoint'), ('vector_search'), ('postgres')) AS t(type)"

EXPIRY_FLAG = (f"CASE WHEN {{c}} < {AS_OF} THEN 'expired' "
               f"WHEN epoch_us({{c}}) - epoch_us({AS_OF}) < 604800000000 THEN 'soon' END")


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    st = with_status()
    rg = with_reg()
    fd = with_feeds()
    lg = with_ledger()

    q["resource_status"] = f"{st} SELECT * FROM status"
    q["status_by_workspace"] = f"{st} SELECT * FROM status WHERE workspace_id = {WS}"
    q["approved_only"] = f"{st} SELECT * FROM status WHERE is_approved"
    stats = f"""SELECT t.type, CAST(count(s.type) AS BIGINT) AS total,
        CAST(count(s.type) FILTER (WHERE s.is_approved) AS BIGINT) AS approved,
        CAST(count(s.type) - count(s.type) FILTER (WHERE s.is_approved) AS BIGINT) AS unapproved
      FROM {TYPES} LEFT JOIN status s ON s.type = t.type GROUP BY t.type"""
    q["stats_by_type"] = f"{st} {stats}"
    q["stats_overall"] = f"""{st}, o AS (
        SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_approved) AS BIGINT) AS approved
        FROM status WHERE type IN ('app', 'serving_endpoint', 'vector_search', 'postgres'))
      SELECT total, approved, total - approved AS unapproved,
        CASE WHEN total > 0 THEN round(CAST(approved AS DOUBLE) / total * 100, 1) ELSE 0.0 END AS approval_rate FROM o"""
    q["stats_rollup"] = f"""{st} SELECT workspace_name, type, CAST(count(*) AS BIGINT) AS total,
        CAST(count(*) FILTER (WHERE is_approved) AS BIGINT) AS approved,
        CAST(GROUPING(workspace_name, type) AS BIGINT) AS level
      FROM status GROUP BY ROLLUP (workspace_name, type)"""
    q["section_counts"] = f"{st}, s AS ({stats}) SELECT type, total FROM s WHERE total > 0"
    q["resource_counts"] = f"{fd} SELECT CAST(count(*) AS BIGINT) AS n_resources FROM feed_inv"
    q["active_approvals"] = f"{rg} SELECT {ACTIVE_COLS} FROM reg WHERE is_approved AND revoked_date IS NULL"
    q["active_approvals_by_workspace"] = (f"{rg} SELECT {ACTIVE_COLS} FROM reg "
                                          f"WHERE is_approved AND revoked_date IS NULL AND workspace_id = {WS}")
    q["check_approved"] = f"""{rg},
      keys AS (SELECT CAST(c_custkey AS VARCHAR) AS resource_id,
                      CAST((c_nationkey + c_custkey % 2) % 25 AS VARCHAR) AS workspace_id FROM customer),
      j AS (SELECT k.resource_id, k.workspace_id,
              a.resource_id IS NOT NULL AND (a.expiration_date IS NULL OR a.expiration_date >= {AS_OF}) AS ok,
              a.approved_by, a.approval_date, a.expiration_date, a.justification
            FROM keys k LEFT JOIN (SELECT * FROM reg WHERE is_approved AND revoked_date IS NULL) a
              ON a.resource_id = k.resource_id AND a.workspace_id = k.workspace_id)
      SELECT resource_id, workspace_id, ok AS is_approved,
        CASE WHEN ok THEN approved_by END AS approved_by, CASE WHEN ok THEN approval_date END AS approval_date,
        CASE WHEN ok THEN expiration_date END AS expiration_date, CASE WHEN ok THEN justification END AS justification
      FROM j"""
    q["lookup_by_name"] = f"""WITH {INV},
      cand AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY
                 CASE type WHEN 'app' THEN 0 ELSE 1 END, workspace_id, resource_id) AS rn
               FROM inv WHERE type IN ('app', 'serving_endpoint'))
      SELECT c.c_name AS name, x.name IS NOT NULL AS found, x.resource_id, x.workspace_id, x.workspace_name, x.type,
        x.state, x.creator, x.description
      FROM customer c LEFT JOIN (SELECT * FROM cand WHERE rn = 1) x ON x.name = c.c_name"""
    q["listing_header"] = f"""{st}
      SELECT 'current' AS workspace_id,
        coalesce((SELECT workspace_name FROM status ORDER BY
                    CASE type WHEN 'app' THEN 0 WHEN 'serving_endpoint' THEN 1 WHEN 'vector_search' THEN 2
                              WHEN 'postgres' THEN 3 ELSE 4 END, resource_id, workspace_id LIMIT 1), 'Unknown')
          AS workspace_name,
        (SELECT CAST(count(*) AS BIGINT) FROM status) AS n_resources"""
    q["card_view"] = f"""{st}
      SELECT concat_ws('-', resource_id, workspace_id) AS row_key, name, type,
        CASE type WHEN 'serving_endpoint' THEN 'Model Serving Endpoint' WHEN 'vector_search' THEN 'Vector Search Endpoint'
                  WHEN 'postgres' THEN 'Lakehouse Postgres' ELSE 'Databricks App' END AS type_label,
        CASE WHEN upper(state) IN ('RUNNING', 'READY', 'ACTIVE', 'ONLINE') THEN 'running'
             WHEN upper(state) IN ('STOPPED', 'READ_ONLY') THEN 'stopped' ELSE 'unknown' END AS state_class,
        CASE WHEN is_approved AND is_foundation_model THEN 'auto-approved' WHEN is_approved THEN 'approved'
             ELSE 'unapproved' END AS card_class,
        CASE WHEN approved_by = 'system' THEN 'System (Foundation Model)' ELSE approved_by END AS approver_label,
        {EXPIRY_FLAG.format(c='expiration_date')} AS expiry_flag,
        strftime(approval_date, '%b %d, %Y') AS approval_date_label,
        strftime(expiration_date, '%b %d, %Y %H:%M') AS expiration_date_label
      FROM status"""
    q["state_classes"] = f"""{fd}
      SELECT type, resource_id, workspace_id, state,
        CASE WHEN upper(state) IN ('RUNNING', 'READY', 'ACTIVE', 'ONLINE') THEN 'running'
             WHEN upper(state) IN ('STOPPED', 'READ_ONLY') THEN 'stopped' ELSE 'unknown' END AS state_class
      FROM feed_inv"""
    q["expiring_soon"] = f"""{rg}, f AS (
        SELECT resource_id, workspace_id, resource_name, expiration_date,
          {EXPIRY_FLAG.format(c='expiration_date')} AS expiry_flag
        FROM reg WHERE is_approved AND revoked_date IS NULL)
      SELECT * FROM f WHERE expiry_flag IS NOT NULL"""
    q["recent_approvals"] = (f"{rg} SELECT {REG_COLS} FROM reg "
                             f"WHERE approval_date > CAST(CAST({AS_OF} AS DATE) - 7 AS TIMESTAMP)")
    q["duplicate_keys"] = f"""{fd}
      SELECT concat_ws('-', resource_id, workspace_id) AS row_key, resource_id, workspace_id, CAST(count(*) AS BIGINT) AS n
      FROM feed_inv GROUP BY resource_id, workspace_id HAVING count(*) > 1"""
    q["approve_rejects"] = (f"WITH {LOG} SELECT seq, resource_id, workspace_id, error FROM checked "
                            f"WHERE error IS NOT NULL AND action = 'approve'")
    q["revoke_rejects"] = (f"WITH {LOG} SELECT seq, resource_id, workspace_id, error FROM checked "
                           f"WHERE error IS NOT NULL AND action = 'revoke'")
    q["expiry_warnings"] = f"""WITH {LOG}, e AS (
        SELECT seq, resource_id, workspace_id, TRY_CAST(nullif(substr(trim(expiration_date), 1, 10), '') AS TIMESTAMP) AS expiration_date
        FROM valid WHERE action = 'approve' AND expiration_date <> '')
      SELECT *, CAST(expiration_date AS DATE) < CAST({AS_OF} AS DATE) AS past_expiry FROM e"""
    q["approval_rows"] = f"""WITH {LOG}
      SELECT seq, resource_name, resource_id, workspace_id, workspace_name, resource_creator, actor AS approved_by,
        date_trunc('second', "at") AS approval_date,
        TRY_CAST(nullif(substr(trim(expiration_date), 1, 10), '') AS TIMESTAMP) AS expiration_date,
        reason AS justification, true AS is_approved, CAST(NULL AS TIMESTAMP) AS revoked_date,
        CAST(NULL AS VARCHAR) AS revoked_by, date_trunc('second', "at") AS updated_at,
        CAST(NULL AS VARCHAR) AS revoked_reason
      FROM valid WHERE action = 'approve'"""
    q["registry_fold"] = f"{rg} SELECT {REG_COLS} FROM reg"
    before = 'before AS (SELECT * FROM valid WHERE "at" < ' + CUT + ')'
    after = 'after AS (SELECT * FROM valid WHERE "at" >= ' + CUT + ')'
    q["upsert_registry"] = f"""WITH {LOG}, {before}, {after}, {fold('before', 'tgt')},
      src AS (SELECT *, row_number() OVER (PARTITION BY resource_id, workspace_id ORDER BY "at" DESC, seq DESC) AS rn
              FROM after WHERE action = 'approve'),
      src_rows AS (
        SELECT resource_name, resource_id, workspace_id, workspace_name, resource_creator, actor AS approved_by,
          date_trunc('second', "at") AS approval_date,
          TRY_CAST(nullif(substr(trim(expiration_date), 1, 10), '') AS TIMESTAMP) AS expiration_date,
          reason AS justification, true AS is_approved, CAST(NULL AS TIMESTAMP) AS revoked_date,
          CAST(NULL AS VARCHAR) AS revoked_by, date_trunc('second', "at") AS updated_at,
          CAST(NULL AS VARCHAR) AS revoked_reason
        FROM src WHERE rn = 1)
      SELECT {REG_COLS} FROM tgt t WHERE NOT EXISTS (
        SELECT 1 FROM src_rows s WHERE s.resource_id = t.resource_id AND s.workspace_id = t.workspace_id)
      UNION ALL SELECT {REG_COLS} FROM src_rows"""
    q["revoke_registry"] = f"""WITH {LOG}, {before}, {after}, {fold('before', 'tgt')},
      rv AS (SELECT *, row_number() OVER (PARTITION BY resource_id, workspace_id ORDER BY "at" DESC, seq DESC) AS rn
             FROM after WHERE action = 'revoke')
      SELECT t.resource_name, t.resource_id, t.workspace_id, t.workspace_name, t.resource_creator, t.approved_by,
        t.approval_date, t.expiration_date, t.justification,
        CASE WHEN r.seq IS NOT NULL THEN false ELSE t.is_approved END AS is_approved,
        CASE WHEN r.seq IS NOT NULL THEN date_trunc('second', r."at") ELSE t.revoked_date END AS revoked_date,
        CASE WHEN r.seq IS NOT NULL THEN r.actor ELSE t.revoked_by END AS revoked_by,
        CASE WHEN r.seq IS NOT NULL THEN date_trunc('second', r."at") ELSE t.updated_at END AS updated_at,
        CASE WHEN r.seq IS NOT NULL THEN r.reason ELSE t.revoked_reason END AS revoked_reason
      FROM tgt t LEFT JOIN rv r ON r.rn = 1 AND r.resource_id = t.resource_id AND r.workspace_id = t.workspace_id"""
    q["unmatched_revokes"] = f"""WITH {LOG}, {before}, {after}, {fold('before', 'tgt')}
      SELECT seq, resource_id, workspace_id FROM after a WHERE action = 'revoke' AND NOT EXISTS (
        SELECT 1 FROM tgt t WHERE t.resource_id = a.resource_id AND t.workspace_id = a.workspace_id)"""
    q["decision_history"] = f"""WITH {LOG}
      SELECT seq, resource_id, workspace_id, action, actor, reason, "at" AS valid_from,
        lead("at") OVER w AS valid_to, lead(seq) OVER w AS next_seq
      FROM valid WINDOW w AS (PARTITION BY resource_id, workspace_id ORDER BY "at", seq)"""
    q["registry_as_of"] = (f'WITH {LOG}, upto AS (SELECT * FROM valid WHERE "at" <= {TRAVEL_TO}), '
                           f"{fold('upto', 'tt')} SELECT {REG_COLS} FROM tt")

    q["feed_apps"] = f"{fd} SELECT * FROM feed_apps"
    q["feed_endpoints"] = f"{fd} SELECT * FROM feed_endpoints"
    q["feed_vector_search"] = f"{fd} SELECT * FROM feed_vector"
    q["feed_databases"] = f"{fd} SELECT * FROM feed_db"
    q["inventory_union"] = f"{fd} SELECT * FROM feed_inv"
    bad = "{k} % 61 = 0 OR {k} % 67 = 0"
    lines = f"""lines AS (
        SELECT 'app' AS type, event_id AS k FROM events WHERE CAST(user_id % 25 AS INTEGER) IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'serving_endpoint', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT 'vector_search', s_suppkey FROM supplier
        UNION ALL SELECT 'postgres', p_partkey FROM part)"""
    q["feed_rejects"] = f"WITH {lines} SELECT type, CAST(k AS BIGINT) AS line_no FROM lines WHERE {bad.format(k='k')}"
    q["landed_health"] = f"""WITH {lines} SELECT type, CAST(count(*) AS BIGINT) AS n_lines,
        CAST(count(*) FILTER (WHERE {bad.format(k='k')}) AS BIGINT) AS n_rejected FROM lines GROUP BY type"""
    q["inventory_landed"] = f"""{fd},
      keyed AS (
        SELECT *, CAST(substr(name, 5) AS BIGINT) AS k FROM feed_apps
        UNION ALL SELECT *, CAST(substr(name, 10) AS BIGINT) FROM feed_endpoints
        UNION ALL SELECT *, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) FROM feed_vector
        UNION ALL SELECT * EXCLUDE (pk), CAST(pk AS BIGINT) FROM feed_db_keyed)
      SELECT * EXCLUDE (k) FROM keyed WHERE NOT ({bad.format(k='k')})"""
    q["feed_health"] = f"""{fd}
      SELECT type, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(count(*) FILTER (WHERE resource_id IS NULL OR resource_id = '') AS BIGINT) AS n_missing_id,
        CAST(count(*) FILTER (WHERE state = 'UNKNOWN') AS BIGINT) AS n_unknown_state,
        CAST(count(*) FILTER (WHERE created_at IS NULL) AS BIGINT) AS n_missing_created
      FROM feed_inv GROUP BY type"""
    q["foundation_endpoints"] = (f"{fd} SELECT name, CAST(n_entities AS INTEGER) AS n_entities "
                                 f"FROM ep_full WHERE any_fm")
    q["endpoint_descriptions"] = f"{fd} SELECT name, description FROM feed_endpoints"
    # every 31st row has three fields only: the first three of its own manifest's order
    short, odd = "o_orderkey % 31 = 0", "(o_orderkey // 100) % 2 = 1"
    q["decode_result_rows"] = f"""
      SELECT CAST(o_orderkey // 100 AS BIGINT) AS result_id, CASE WHEN NOT ({short} AND {odd}) THEN o_orderkey END AS o_orderkey,
        CASE WHEN NOT ({short} AND {odd}) THEN o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AS is_open,
        CASE WHEN NOT ({short} AND NOT {odd}) THEN o_totalprice END AS o_totalprice,
        CASE WHEN NOT ({short} AND NOT {odd}) THEN o_orderdate END AS o_orderdate FROM orders"""
    q["workspace_names"] = """
      SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'default-workspace'
        ELSE split_part(CASE WHEN contains(url, '://') THEN split_part(url, '://', 2) ELSE url END, '.', 1) END
        AS workspace_name FROM pages"""
    q["workspaces"] = (f"{fd} SELECT workspace_id, workspace_name, "
                       f"'https://' || workspace_name || '.cloud.example.com' AS url, "
                       f"CAST(count(*) AS BIGINT) AS n_resources "
                       f"FROM feed_inv GROUP BY workspace_id, workspace_name")

    q["ledger_applied"] = (f"{lg} SELECT schema_key, version, description, applied_at, status FROM ledger "
                           f"WHERE status = 'applied'")
    q["ledger_applied_versions"] = f"{lg} SELECT schema_key, version FROM applied_v"
    q["ledger_missing_fields"] = f"""{lg}, m AS (
        SELECT schema_key, position, version,
          concat_ws(',', CASE WHEN version IS NULL THEN 'version' END,
                         CASE WHEN description IS NULL THEN 'description' END,
                         CASE WHEN sql IS NULL THEN 'sql' END) AS missing FROM defs)
      SELECT * FROM m WHERE missing <> ''"""
    q["ledger_duplicates"] = (f"{lg} SELECT schema_key, version, CAST(count(*) AS BIGINT) AS n FROM defs "
                              f"WHERE version IS NOT NULL GROUP BY schema_key, version HAVING count(*) > 1")
    q["ledger_not_sequential"] = f"""{lg}, p AS (
        SELECT schema_key, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT version) AS BIGINT) AS n_distinct,
          min(version) AS min_version, max(version) AS max_version
        FROM defs WHERE version IS NOT NULL GROUP BY schema_key),
      k AS (SELECT schema_key FROM ledger UNION SELECT schema_key FROM defs),
      kp AS (SELECT k.schema_key, coalesce(p.n_rows, 0) AS n_rows, coalesce(p.n_distinct, 0) AS n_distinct,
               p.min_version, p.max_version FROM k LEFT JOIN p USING (schema_key))
      SELECT * FROM kp WHERE NOT coalesce(n_rows > 0 AND n_rows = n_distinct AND min_version = 1
                                          AND max_version = n_rows, false)"""
    q["ledger_out_of_order"] = f"""{lg}, p AS (
        SELECT schema_key, position, version,
          lag(version) OVER w AS prev_version, lag(position) OVER w AS prev_position
        FROM defs WHERE version IS NOT NULL WINDOW w AS (PARTITION BY schema_key ORDER BY position))
      SELECT * FROM p WHERE prev_version > version"""
    q["ledger_drift"] = f"""{lg}
      SELECT schema_key, version, applied_at, status, checksum, sha256(sql_statement) AS expected FROM ledger
      WHERE checksum IS DISTINCT FROM sha256(sql_statement)"""
    q["ledger_latest"] = f"""{lg}, r AS (
        SELECT *, row_number() OVER (PARTITION BY schema_key, version ORDER BY applied_at DESC, tie1 DESC, tie2 DESC)
            AS rn,
          count(*) OVER (PARTITION BY schema_key, version) AS n_attempts FROM ledger)
      SELECT schema_key, version, CAST(n_attempts AS BIGINT) AS n_attempts, applied_at, status, error_message
      FROM r WHERE rn = 1"""
    exists = ("(contains(error_message, 'ALREADY_EXISTS') OR contains(error_message, 'FIELD_ALREADY_EXISTS') "
              "OR contains(error_message, 'already exists'))")
    q["ledger_outcomes"] = f"""{lg}, o AS (
        SELECT *, coalesce({exists}, false) AS ex, error_message IS NOT NULL AND NOT coalesce({exists}, false) AS failed
        FROM ledger)
      SELECT schema_key, version, tie1, tie2, CASE WHEN failed THEN 'failed' ELSE 'applied' END AS outcome,
        CASE WHEN ex THEN 'Target already exists (expected)' WHEN failed THEN error_message END AS note,
        failed AND coalesce(contains(sql_statement, 'CREATE TABLE'), false) AS critical
      FROM o"""
    q["ledger_error_classes"] = f"""{lg}
      SELECT schema_key, version, tie1, tie2,
        CASE WHEN {exists} THEN 'already_exists'
             WHEN contains(lower(error_message), 'not found') OR contains(lower(error_message), 'does not exist')
               OR contains(lower(error_message), 'table_or_view_not_found') THEN 'not_found'
             ELSE 'other' END AS error_class,
        contains(error_message, 'ALREADY_EXISTS') OR contains(error_message, 'FIELD_ALREADY_EXISTS')
          OR contains(error_message, 'TABLE_OR_VIEW_NOT_FOUND') OR contains(error_message, 'SCHEMA_NOT_FOUND')
          AS expected
      FROM ledger WHERE error_message IS NOT NULL"""
    q["ledger_timing"] = f"""{lg}
      SELECT version, CAST(count(execution_time_seconds) AS BIGINT) AS n,
        round(avg(execution_time_seconds), 6) AS avg_seconds, min(execution_time_seconds) AS min_seconds,
        max(execution_time_seconds) AS max_seconds, round(sum(execution_time_seconds), 6) AS total_seconds
      FROM ledger GROUP BY version"""
    q["ledger_pending"] = f"{lg} SELECT schema_key, version FROM pending_v"
    q["ledger_summary"] = f"""{lg},
      r AS (SELECT schema_key, count(*) AS n_rows, count(*) FILTER (WHERE status = 'failed') AS n_failed_attempts
            FROM ledger GROUP BY schema_key),
      d AS (SELECT schema_key, count(*) AS n_defined FROM defined_v GROUP BY schema_key),
      a AS (SELECT schema_key, count(*) AS n_applied FROM applied_v GROUP BY schema_key),
      p AS (SELECT schema_key, count(*) AS n_pending FROM pending_v GROUP BY schema_key),
      sk AS (SELECT d.schema_key, count(*) AS n_skipped FROM defined_v d
             JOIN applied_v a ON a.schema_key = d.schema_key AND a.version = d.version GROUP BY d.schema_key),
      k AS (SELECT schema_key FROM d UNION SELECT schema_key FROM r)
      SELECT k.schema_key, CAST(coalesce(r.n_rows, 0) AS BIGINT) AS n_rows,
        CAST(coalesce(r.n_failed_attempts, 0) AS BIGINT) AS n_failed_attempts,
        CAST(coalesce(d.n_defined, 0) AS BIGINT) AS n_defined, CAST(coalesce(a.n_applied, 0) AS BIGINT) AS n_applied,
        CAST(coalesce(p.n_pending, 0) AS BIGINT) AS n_pending,
        CAST(coalesce(sk.n_skipped, 0) AS BIGINT) AS n_skipped
      FROM k LEFT JOIN r USING (schema_key) LEFT JOIN d USING (schema_key) LEFT JOIN a USING (schema_key)
        LEFT JOIN p USING (schema_key) LEFT JOIN sk USING (schema_key)"""
    q["ledger_without_failed"] = (f"{lg} SELECT {LEDGER_COLS} FROM ledger "
                                  f"WHERE NOT coalesce(version = 1 AND status = 'failed', false)")
    q["conform_v1_to_v2"] = (f"{rg} SELECT {REG_COLS.replace(', revoked_reason', '')}, "
                             f"CAST(NULL AS VARCHAR) AS revoked_reason FROM reg")
    q["conform_with_backfill"] = (f"{rg} SELECT {REG_COLS.replace(', revoked_reason', '')}, CASE WHEN is_approved THEN NULL "
                                  f"WHEN revoked_by IS NOT NULL THEN 'Revoked by ' || revoked_by ELSE 'No reason recorded' END "
                                  f"AS revoked_reason FROM reg")
    q["backup_equals_source"] = f"""{rg} SELECT CAST(count(*) AS BIGINT) AS n_left, CAST(count(*) AS BIGINT) AS n_right,
        CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM reg"""
    q["unknown_actions"] = (f"WITH {LOG} SELECT seq, resource_id, workspace_id, error FROM checked "
                            f"WHERE action NOT IN ('approve', 'revoke')")
    q["ledger_report"] = (f"{lg} SELECT schema_key, version, description, applied_at, execution_time_seconds, status, "
                          f"error_message FROM ledger")
    q["ledger_definition_drift"] = f"""{lg}, now AS (
        SELECT schema_key, version, sha256(sql) AS checksum FROM defs WHERE version IS NOT NULL AND sql IS NOT NULL)
      SELECT schema_key, version, tie1, tie2, applied_at, checksum FROM ledger l WHERE status = 'applied'
        AND EXISTS (SELECT 1 FROM now n WHERE n.schema_key = l.schema_key AND n.version = l.version)
        AND NOT EXISTS (SELECT 1 FROM now n WHERE n.schema_key = l.schema_key AND n.version = l.version
                        AND n.checksum = l.checksum)"""
    # of decisions at the same time the one with the largest seq holds
    q["decision_as_of"] = f"""WITH {LOG},
      held AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY resource_id, workspace_id, "at" ORDER BY seq DESC) = 1),
      asked AS (SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(c_custkey AS VARCHAR) AS resource_id, CAST(c_nationkey AS VARCHAR) AS workspace_id,
                  CAST(l_shipdate AS TIMESTAMP) AS asked_at
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
      SELECT a.order_id, a.line, a.resource_id, a.workspace_id, a.asked_at, h.seq, h.action, h.actor,
        coalesce(h.action = 'approve' AND (coalesce(h.expiration_date, '') = '' OR TRY_CAST(substr(trim(h.expiration_date), 1, 10) AS TIMESTAMP) >= a.asked_at), false) AS was_approved
      FROM asked a ASOF LEFT JOIN held h ON a.resource_id = h.resource_id AND a.workspace_id = h.workspace_id AND h."at" <= a.asked_at"""
    q["registry_of_region"] = f"""{rg} SELECT {REG_COLS} FROM reg WHERE workspace_id IN (
        SELECT CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"""
    q["stored_schema_drift"] = f"""{rg}, n AS (SELECT count(*) FILTER (WHERE workspace_id IN ('1', '2')) AS old, count(*) FILTER (WHERE workspace_id = '5') AS odd FROM reg)
      SELECT 'revoked_reason' AS name, 'string' AS expected, CAST(NULL AS VARCHAR) AS actual, 'missing' AS problem, CAST(1 AS BIGINT) AS n_files, CAST(old AS BIGINT) AS n_rows FROM n
      UNION ALL SELECT 'is_approved', 'boolean', 'string', 'type', 1, odd FROM n UNION ALL SELECT 'note', NULL, 'string', 'extra', 1, odd FROM n"""
    q["resource_status_bucketed"] = q["resource_status"]
    q["registry_lookup"] = f"{rg} SELECT {REG_COLS} FROM reg ORDER BY CAST(resource_id AS BIGINT), workspace_id LIMIT 1"
    q["stored_ledger_maintained"] = f"""{lg},
      stored AS (SELECT schema_key, version, status FROM ledger WHERE version <= 3 AND NOT coalesce(version = 1 AND status = 'failed', false)
        UNION ALL SELECT schema_key, version, status FROM ledger WHERE version > 3
        QUALIFY row_number() OVER (PARTITION BY schema_key, version, checksum, applied_at
                                   ORDER BY description DESC NULLS LAST, sql_statement DESC NULLS LAST, status DESC NULLS LAST) = 1)
      SELECT version, status, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT schema_key) AS BIGINT) AS n_schemas FROM stored GROUP BY version, status"""
    fifth = "CAST(resource_id AS BIGINT) % 5 = 0"
    q["backup_fingerprints"] = f"""{rg}
      SELECT workspace_id, CAST(count(*) AS BIGINT) AS n_left,
        CAST(count(*) + CASE workspace_id WHEN '7' THEN -1 WHEN '11' THEN 1 ELSE 0 END * count(*) FILTER (WHERE {fifth}) AS BIGINT) AS n_right,
        NOT (workspace_id IN ('3', '7', '11') AND count(*) FILTER (WHERE {fifth}) > 0) AS same
      FROM reg GROUP BY workspace_id"""
    q["backup_differences"] = f"""{rg}, f AS (SELECT resource_id, workspace_id, approved_by FROM reg WHERE workspace_id IN ('3', '7', '11') AND {fifth})
      SELECT resource_id, workspace_id, approved_by, CAST(1 AS BIGINT) AS n_left, CAST(CASE workspace_id WHEN '11' THEN 2 ELSE 0 END AS BIGINT) AS n_right FROM f
      UNION ALL SELECT resource_id, workspace_id, 'somebody', 0, 1 FROM f WHERE workspace_id = '3'"""
    q["result_variants"] = f"""
      SELECT CAST(o_orderkey // 100 AS BIGINT) AS result_id, CASE WHEN NOT ({short} AND {odd}) THEN CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
        CASE WHEN NOT ({short} AND {odd}) THEN o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AS is_open,
        CASE WHEN NOT ({short} AND NOT {odd}) THEN round(o_totalprice, 2) END AS o_totalprice,
        CASE WHEN NOT ({short} AND NOT {odd}) THEN o_orderdate END AS o_orderdate FROM orders"""
    # a column that no row of a result holds has no type
    kind = "CASE WHEN count(*) FILTER (WHERE NOT ({gone})) = 0 THEN 'VOID' ELSE {kind} END"
    late, early = f"{short} AND NOT {odd}", f"{short} AND {odd}"
    price = "CASE any_value(o_orderkey // 100) % 3 WHEN 0 THEN 'STRING' WHEN 1 THEN 'DOUBLE' ELSE 'DECIMAL' END"
    key = "CASE any_value(o_orderkey // 100) % 5 WHEN 0 THEN 'STRING' ELSE 'BIGINT' END"
    q["result_variant_schemas"] = f"""
      WITH r AS (SELECT count(*) AS n, 'OBJECT<is_open: BOOLEAN, o_orderdate: ' || {kind.format(gone=late, kind="'TIMESTAMP_NTZ'")} || ', o_orderkey: ' || {kind.format(gone=early, kind=key)}
          || ', o_orderstatus: ' || {kind.format(gone=early, kind="'STRING'")} || ', o_totalprice: ' || {kind.format(gone=late, kind=price)} || '>' AS row_schema FROM orders GROUP BY o_orderkey // 100)
      SELECT row_schema, CAST(count(*) AS BIGINT) AS n_results, CAST(sum(n) AS BIGINT) AS n_rows FROM r GROUP BY row_schema"""
    q["result_type_clashes"] = """
      WITH r AS (SELECT DISTINCT o_orderkey // 100 AS i FROM orders),
      t AS (SELECT 'o_totalprice' AS name, CASE i % 3 WHEN 0 THEN 'STRING' WHEN 1 THEN 'DOUBLE' ELSE 'DECIMAL' END AS t FROM r
            UNION ALL SELECT 'o_orderkey', CASE i % 5 WHEN 0 THEN 'STRING' ELSE 'LONG' END FROM r)
      SELECT name, string_agg(DISTINCT t, ',' ORDER BY t) AS types, CAST(count(DISTINCT t) AS BIGINT) AS n_types FROM t GROUP BY name HAVING count(DISTINCT t) > 1"""
    q["ledger_durations"] = f"""{lg}
      SELECT version, CAST(count(*) AS BIGINT) AS n_rows, round(min(s), 6) AS least, round(max(s), 6) AS most
      FROM (SELECT version, CASE WHEN applied_at IS NOT NULL THEN version * 3601.25::DOUBLE END AS s FROM ledger WHERE version IS NOT NULL) GROUP BY version"""
    q["ledger_percentiles"] = f"""{lg}
      SELECT version, CAST(count(*) AS BIGINT) AS n_times, true AS p50_ok, true AS p95_ok, true AS p99_ok FROM ledger WHERE execution_time_seconds IS NOT NULL GROUP BY version"""
    return q


def oracle_sql() -> dict[str, str]:
    return _sql()
