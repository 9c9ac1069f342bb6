"""Decision streams.

T1 — ``validated_stream`` / ``quarantine_stream``: the approve/revoke rules as a
stateless projection of a stream.  ``start_validation_stream`` feeds both sinks
from one read: each micro-batch is checked and written once, split by outcome,
into a folder of its own number, so a batch that runs again replaces its output.
Counts by error text are observed on the way (``batch_metrics``).

T2 — ``start_registry_stream``: decisions delivered again within ``delay`` are
dropped by Spark's state store, then each micro-batch is folded
(``fold_state``: last approve and last revoke per key, each with its (at, seq))
and the fold is appended to a folder.  Reading merges all folds by taking
maxima, so a late decision never overwrites a newer one, and a batch appended
twice (a retry, or a fresh checkpoint over the same folder) changes nothing.
Batch numbers play no part.  ``compact`` writes the merged state to a new
folder.  Expiry needs no timers: it is evaluated when the registry is read
(``resource_status``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.paths import plain_path
from ..operators import decisions as D
from ..operators import snapshots as K
from ..operators import validate as V
from ..operators.validate import with_errors
from ..schemas import DECISION_LOG


def decision_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read landed decision files as a stream with the fixed decision-log schema.

    A file that cannot be read does not end the stream; ``unread_files`` lists such files.
    """
    return spark.readStream.format(fmt).schema(DECISION_LOG).options(**{"ignoreCorruptFiles": "true", **options}).load(path)


def validated_stream(stream: DataFrame) -> DataFrame:
    return with_errors(stream).filter(F.col("error").isNull()).drop("error")


def quarantine_stream(stream: DataFrame) -> DataFrame:
    return with_errors(stream).filter(F.col("error").isNotNull())


# Names under which the counts of each error text are observed.
METRICS = {"n_name_and_id": V.NAME_AND_ID_REQUIRED, "n_justification": V.JUSTIFICATION_TOO_SHORT, "n_ids": V.IDS_REQUIRED,
           "n_reason": V.REASON_TOO_SHORT, "n_expiration": V.INVALID_EXPIRATION, "n_action": V.UNKNOWN_ACTION}
OBSERVED = "decisions"


def observed(checked: DataFrame) -> DataFrame:
    """Rows with errors, counted as they pass: n_rows, n_valid and a count for each error text."""
    error = F.col("error")
    return checked.observe(OBSERVED, F.count(F.lit(1)).alias("n_rows"), F.count_if(error.isNull()).alias("n_valid"),
                           *[F.count_if(error == text).alias(name) for name, text in METRICS.items()])


def start_validation_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start the T1 query: valid rows and rejects of each batch below ``path``, from one read and one write."""
    checked = observed(with_errors(stream.withColumn("file", F.col("_metadata.file_path"))))

    def sink(batch: DataFrame, batch_id: int) -> None:
        outcome = F.when(F.col("error").isNull(), "valid").otherwise("rejected")
        batch.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    writer = checked.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def checked_rows(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """What the T1 query wrote: ``valid`` or ``rejected`` decisions, with their file and batch; other folders are not read."""
    schema = T.StructType([*DECISION_LOG.fields, T.StructField("file", T.StringType()), T.StructField("error", T.StringType()),
                           T.StructField("batch", T.LongType()), T.StructField("outcome", T.StringType())])
    rows = spark.read.schema(schema).parquet(path).filter(F.col("outcome") == outcome).drop("outcome")
    return rows.drop("error") if outcome == "valid" else rows


def batch_metrics(query) -> list[dict]:
    """Observed counts of the query's latest batches, each with its batch number."""
    return [{"batch": p.batchId, **p.observedMetrics[OBSERVED].asDict()} for p in query.recentProgress if OBSERVED in p.observedMetrics]


def unread_files(spark: SparkSession, landed: str, path: str) -> DataFrame:
    """Landed files of which the T1 query has written no row: damaged, empty or not yet taken.  Lists files, reads none of them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landed).select(F.col("path").alias("file"), "length")
    seen = checked_rows(spark, path, "valid").select("file").unionByName(checked_rows(spark, path, "rejected").select("file")).distinct()
    return listed.withColumn("_f", plain_path(F.col("file"))).join(seen.select(plain_path(F.col("file"), escaped=True).alias("_f")).distinct(), "_f", "left_anti").drop("_f")


def without_redelivered(stream: DataFrame, delay: str, keys=("seq", "at", "action", "resource_id", "workspace_id")) -> DataFrame:
    """Each decision once, however often it is delivered within ``delay`` of its first arrival.

    Arrival, not the decision's own time, carries the watermark, so a late decision is never dropped; keys seen longer
    ago than ``delay`` leave the state store.  Rows with null keys are told apart by the others.
    """
    arrived = stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(list(keys)).drop("arrived")


@dataclass
class RegistryState:
    """Folds of micro-batches appended under ``base``; the state is their merge."""

    spark: SparkSession
    base: str

    def __post_init__(self) -> None:
        nothing = self.spark.createDataFrame([], DECISION_LOG)
        D.fold_state(nothing).write.mode("ignore").parquet(self.base)  # so that a state can be read before the first batch

    def commit(self, batch: DataFrame) -> None:
        """Append the fold of one micro-batch of decisions: one write, evaluated once."""
        D.fold_state(with_errors(batch).filter(F.col("error").isNull())).write.mode("append").parquet(self.base)

    def state(self) -> DataFrame:
        """One row a key, merged from every fold appended so far."""
        return D.merge_states(self.spark.read.parquet(self.base))

    def registry(self) -> DataFrame:
        return D.registry_from_state(self.state())

    def compact(self, dest: str) -> "RegistryState":
        """Write the merged state to the new folder ``dest``; appends go on there."""
        K.write_snapshot(self.state(), dest)
        return RegistryState(self.spark, dest)


def registry_sink(state: RegistryState):
    """``foreachBatch`` function committing each micro-batch to ``state``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        state.commit(batch)
    return sink


def start_registry_stream(stream: DataFrame, base: str, checkpoint: str, trigger: dict | None = None, delay: str | None = "7 days"):
    """Start the T2 query; returns (StreamingQuery, RegistryState).

    ``base`` and ``checkpoint`` belong to this stream alone.  With a ``delay`` decisions delivered again within it are
    dropped before the fold; without, repeats are folded again, which leaves the state as it is but adds rows to the folder.
    """
    state = RegistryState(stream.sparkSession, base)
    once = without_redelivered(stream, delay) if delay else stream
    writer = once.writeStream.foreachBatch(registry_sink(state)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), state
