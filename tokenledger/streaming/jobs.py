"""Continuous counterparts of the batch syncs.

A landed file is read once. Files that are rewritten in place under the same
name (growing session logs, an export that overwrites itself) are invisible to
the file source; those are re-read by scheduled batch runs, see ``syncs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenledger.operators.governance_rows import (
    governance_divergence,
    governance_policies,
    governance_snapshots,
)
from tokenledger.operators.normalize import normalize_observations, normalize_scores
from tokenledger.operators.store import SPOOLED, Store
from tokenledger.operators.trace_context import TraceContext
from tokenledger.schemas import (
    GOVERNANCE_DOCUMENT,
    RAW_OBSERVATION,
    RAW_SCORE,
    RAW_STORE_OBSERVATION,
    RAW_STORE_TRACE,
)
from tokenledger.session import pin_utc, scratch_dir
from tokenledger.sources.governance import accepted
from tokenledger.sources.landing import (
    arrival_order,
    file_position,
    named,
    store_observations,
    store_traces,
    with_project_folder,
)

# Fixed value: the interval between syncs.
SYNC_INTERVAL = "300 seconds"

def _trigger(writer, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=SYNC_INTERVAL)


def _landed_stream(spark: SparkSession, landing: str, schema) -> DataFrame:
    """Raw rows as files arrive, with the position of their file."""
    reader = pin_utc(spark).readStream.schema(with_project_folder(schema))
    return reader.json(landing).select("*", file_position().alias("_position"))


def _arrived(batch: DataFrame) -> DataFrame:
    return batch.withColumn("_seq", arrival_order(F.col("_position")))


def start_observation_sync(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    available_now: bool = False,
    projects: DataFrame | None = None,
) -> StreamingQuery:
    """Upsert observations per micro-batch. Stored roll-ups follow in the days that a batch touches, so a row that is
    sent again is not counted again.

    ``projects`` names source projects by folder, as in the batch sync.

    Late rows replace what is stored, so nothing is deduplicated by watermark:
    that would keep the first version of a row. A batch that is retried after a
    failure upserts the same keys again and changes nothing.
    """

    def sync(batch: DataFrame, _batch_id: int) -> None:
        store.upsert_observations(normalize_observations(named(_arrived(batch), projects)))

    writer = _landed_stream(spark, landing, RAW_OBSERVATION).writeStream.foreachBatch(sync)
    return _trigger(writer.option("checkpointLocation", checkpoint), available_now).start()


def start_score_sync(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    available_now: bool = False,
    projects: DataFrame | None = None,
) -> StreamingQuery:
    """Upsert scores per micro-batch."""

    def sync(batch: DataFrame, _batch_id: int) -> None:
        store.upsert_scores(normalize_scores(named(_arrived(batch), projects)))

    writer = _landed_stream(spark, landing, RAW_SCORE).writeStream.foreachBatch(sync)
    return _trigger(writer.option("checkpointLocation", checkpoint), available_now).start()


def start_governance_sync(
    spark: SparkSession, landing: str, store: Store, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Upsert governance documents that arrive under new file names."""

    def sync(batch: DataFrame, _batch_id: int) -> None:
        documents = accepted(batch)
        store.upsert_governance(governance_snapshots(documents))
        store.upsert_policies(governance_policies(documents))
        store.upsert_governance_divergence(governance_divergence(documents))

    rows = (
        pin_utc(spark)
        .readStream.schema(GOVERNANCE_DOCUMENT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(landing)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    writer = rows.writeStream.foreachBatch(sync)
    return _trigger(writer.option("checkpointLocation", checkpoint), available_now).start()


def start_trace_store_sync(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    available_now: bool = False,
    keep_days: int | None = None,
) -> StreamingQuery:
    """Upsert trace-store observations of ``<landing>/observations`` per micro-batch, with context from the traces of
    ``<landing>/traces``, in whatever order the two arrive (see ``TraceContext``, also for ``keep_days``).

    Both folders are sources of one query, so there is one writer. A batch that is retried repeats upserts that change nothing.
    Checkpoints of the time when observations were the only source cannot be continued; begin a new one.
    """
    observations = _landed_stream(spark, f"{landing}/observations", RAW_STORE_OBSERVATION)
    traces = _landed_stream(spark, f"{landing}/traces", RAW_STORE_TRACE)
    both = observations.withColumn("_kind", F.lit("observation")).unionByName(
        traces.withColumn("_kind", F.lit("trace")), allowMissingColumns=True
    )

    def sync(batch: DataFrame, _batch_id: int) -> None:
        path = scratch_dir(spark, "batch-trace-store")
        _arrived(batch).write.partitionBy("_kind").parquet(path, **SPOOLED)
        rows = batch.sparkSession.read.parquet(path)
        context = TraceContext(store, keep_days)
        context.take_traces(store_traces(rows.where(F.col("_kind") == "trace")))
        context.take_observations(store_observations(rows.where(F.col("_kind") == "observation")))
        store.delete(path)

    writer = both.writeStream.foreachBatch(sync)
    return _trigger(writer.option("checkpointLocation", checkpoint), available_now).start()
