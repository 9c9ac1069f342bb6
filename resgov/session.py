"""Session settings the library relies on.

Time semantics are UTC everywhere (naive timestamps are UTC), so the session
time zone is pinned.  AQE is switched on so join strategies, partition
coalescing and skew splitting are decided from runtime sizes instead of
estimates.  ``configure`` only touches SQL settings, so it is safe to call on
a session somebody else built (the driver's, a notebook's, a cluster's).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}

# Static settings: only honoured when this library builds the session.
STATIC_SETTINGS = {
    # call-site capture for error messages costs several JVM round trips per
    # column function while building plans; plans are built per query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime SQL settings to an existing session.

    Settings the session does not allow to change (e.g. on a shared cluster)
    are left as they are.
    """
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "resgov", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library settings.

    On a cluster leave ``master`` unset and let the launcher decide; pass
    ``shuffle_partitions`` sized so one shuffle partition stays in the
    100-200 MB range at the target scale (AQE coalesces the small ones).
    """
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SQL_SETTINGS, **STATIC_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A directory under the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a
    private folder is created and registered in local mode (tests); on a
    cluster that is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="resgov-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"
