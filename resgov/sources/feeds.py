"""Raw resource feeds → one inventory (map-only: no shuffle anywhere).

Each landed feed row carries the workspace it was read from (``workspace_id``,
``workspace_host``).  Normalisation keeps the reader's defaulting rules but
never drops a row: unparsable or incomplete rows stay in the inventory with
defaults and are counted by ``feed_health``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.foundation import FOUNDATION_PREFIXES, endpoint_description, is_foundation
from ..functions.text import is_truthy, truthy_or
from ..functions.times import epoch_millis_ntz, parse_instant
from ..schemas import INVENTORY, LANDED

UNKNOWN = "UNKNOWN"
DEFAULT_WORKSPACE = "default-workspace"


def workspace_name(host: Column) -> Column:
    """First label of a host: text after ``://`` up to the first dot.
    Null or empty host → ``default-workspace``."""
    rest = F.when(host.contains("://"), F.split_part(host, F.lit("://"), F.lit(2))).otherwise(host)
    return F.when(is_truthy(host), F.split_part(rest, F.lit("."), F.lit(1))).otherwise(F.lit(DEFAULT_WORKSPACE))


def json_state(doc: Column) -> Column:
    """State from a polymorphic JSON value: ``{"state": X}`` → X, ``"X"`` → X, else UNKNOWN."""
    text = F.regexp_replace(doc, r"^\s+", "")
    return (F.when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.state"), F.lit(UNKNOWN)))
            .when(text.startswith('"'), F.coalesce(F.get_json_object(text, "$"), F.lit(UNKNOWN)))
            .otherwise(F.lit(UNKNOWN)))


def _finish(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    out = {
        "workspace_id": F.col("workspace_id"),
        "workspace_name": workspace_name(F.col("workspace_host")),
        "type": F.lit(kind),
        "is_foundation_model": F.lit(False),
        **cols,
    }
    return df.select(*[out[f.name].cast(f.dataType.simpleString()).alias(f.name) for f in INVENTORY.fields])


def normalise_apps(raw: DataFrame) -> DataFrame:
    """Apps: id = name; state from compute_status, falling back to app_status
    while it is still UNKNOWN; creator 'unknown'; description ''."""
    first = json_state(F.col("compute_status"))
    state = F.when((first == UNKNOWN) & F.col("app_status").isNotNull(),
                   json_state(F.col("app_status"))).otherwise(first)
    name = F.coalesce(F.col("name"), F.lit(""))
    return _finish(raw, "app",
                   name=name, resource_id=name, state=state,
                   creator=F.coalesce(F.col("creator"), F.lit("unknown")),
                   created_at=F.when(is_truthy(F.col("create_time")), parse_instant(F.col("create_time"))),
                   description=F.coalesce(F.col("description"), F.lit("")))


def normalise_endpoints(raw: DataFrame, prefixes: Sequence[str] = FOUNDATION_PREFIXES) -> DataFrame:
    """Serving endpoints: id = id or name; foundation flag and description from
    the served entities, evaluated in place on the nested arrays."""
    entities = F.col("config.served_entities")
    models = F.col("config.served_models")
    return _finish(raw, "serving_endpoint",
                   name=F.col("name"),
                   resource_id=truthy_or(F.col("id"), F.col("name")),
                   state=F.coalesce(F.col("state.ready"), F.lit(UNKNOWN)),
                   creator=truthy_or(F.col("creator"), F.lit("unknown")),
                   created_at=epoch_millis_ntz(F.col("creation_timestamp")),
                   description=endpoint_description(F.col("description"), entities, models, prefixes),
                   is_foundation_model=is_foundation(entities, prefixes))


def normalise_vector_search(raw: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("name"), F.lit(""))
    return _finish(raw, "vector_search",
                   name=name, resource_id=name,
                   state=F.coalesce(F.col("endpoint_status.state"), F.lit(UNKNOWN)),
                   creator=F.coalesce(F.col("creator"), F.lit("unknown")),
                   created_at=epoch_millis_ntz(F.col("creation_timestamp")),
                   description=F.when(is_truthy(F.col("endpoint_type")),
                                      F.concat(F.lit("Type: "), F.col("endpoint_type"))).otherwise(F.lit("")))


def normalise_databases(raw: DataFrame) -> DataFrame:
    """Database instances: name = name→uid→''; id = uid→name→''; description
    comment → description → 'Host: '+dns → '' (empty strings fall through)."""
    dns = F.col("read_write_dns")
    return _finish(raw, "postgres",
                   name=F.coalesce(F.col("name"), F.col("uid"), F.lit("")),
                   resource_id=F.coalesce(F.col("uid"), F.col("name"), F.lit("")),
                   state=F.coalesce(F.col("state"), F.col("status"), F.lit("RUNNING")),
                   creator=F.coalesce(F.col("creator"), F.lit("unknown")),
                   created_at=F.when(is_truthy(F.col("created_at")), parse_instant(F.col("created_at"))),
                   description=truthy_or(F.col("comment"), F.col("description"),
                                         F.when(is_truthy(dns), F.concat(F.lit("Host: "), dns)), F.lit("")))


def _record(kind: str) -> Column:
    """A line as a record of its feed's schema; parsing is permissive, so a bad line never ends the job."""
    return F.from_json("line", f"{LANDED[kind]}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _whole(record: Column) -> Column:
    return record.isNotNull() & record["_corrupt"].isNull()


def records(lines: DataFrame, kind: str) -> DataFrame:
    """The raw feed of its readable lines.

    The record is the output of a generator, through which no filter is pushed: each line is parsed once.
    """
    own = lines.filter(F.col("type") == kind).select(F.explode(F.array(_record(kind))).alias("record"))
    return own.filter(_whole(F.col("record"))).select("record.*").drop("_corrupt")


def readable(kinds: Sequence[str] = tuple(LANDED)) -> Column:
    """Whether a landed line is a whole record of its feed (false for feeds unknown), parsed once."""
    out = F.lit(False)
    for kind in kinds:
        # the lambda's variable stands for the record in both tests
        out = F.when(F.col("type") == kind, F.element_at(F.transform(F.array(_record(kind)), _whole), 1)).otherwise(out)
    return out


def rejects(lines: DataFrame) -> DataFrame:
    """Lines of all feeds that could not be read, as they came (quarantine)."""
    return lines.filter(F.col("type").isin(*LANDED) & ~readable())


def landed_health(lines: DataFrame) -> DataFrame:
    """Per feed: lines and how many of them could not be read, in one pass."""
    bad = F.col("type").isin(*LANDED) & ~readable()
    return lines.select("type", bad.alias("bad")).groupBy("type").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_rejected"))


def landed_inventory(lines: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """The inventory of landed JSON: every feed parsed, normalised and appended."""
    return union_inventory(normalise_apps(records(lines, "app")), normalise_endpoints(records(lines, "serving_endpoint"), prefixes),
                           normalise_vector_search(records(lines, "vector_search")), normalise_databases(records(lines, "postgres")))


def union_inventory(*feeds: DataFrame) -> DataFrame:
    """Append normalised feeds; missing columns become null, the foundation flag false."""
    out = None
    for df in feeds:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("is_foundation_model", F.coalesce("is_foundation_model", F.lit(False)))


def feed_health(inventory: DataFrame) -> DataFrame:
    """Rows per feed and how many came in incomplete (partial aggregation per type)."""
    return (inventory.groupBy("type")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~is_truthy(F.col("resource_id"))).alias("n_missing_id"),
                 F.count_if(F.col("state") == UNKNOWN).alias("n_unknown_state"),
                 F.count_if(F.col("created_at").isNull()).alias("n_missing_created")))


def workspaces(*raw_feeds: DataFrame) -> DataFrame:
    """Workspaces of the raw feeds: id, name, URL (the first host by text, of several) and resource count.

    Every feed is read once for two columns; rows are counted per (id, host)
    before the one exchange, and an id with several hosts stays one row.
    """
    out = None
    for raw in raw_feeds:
        pairs = raw.select("workspace_id", F.col("workspace_host").alias("url"))
        out = pairs if out is None else out.unionByName(pairs)
    seen = out.groupBy("workspace_id").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n_resources"))
    return seen.select("workspace_id", workspace_name(F.col("url")).alias("workspace_name"), "url", "n_resources")
