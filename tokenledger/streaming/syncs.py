"""Batch syncs: one run each, safe to repeat. Schedule them at any interval."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tokenledger.operators.enrich import enrich_from_traces
from tokenledger.operators.governance_rows import (
    governance_divergence,
    governance_policies,
    governance_snapshots,
)
from tokenledger.operators.normalize import normalize_observations, normalize_scores
from tokenledger.operators.session_calls import session_observations
from tokenledger.operators.store import Store
from tokenledger.reference_data import default_model_prices, default_targets
from tokenledger.schemas import MODEL_PRICES, TARGETS
from tokenledger.session import scratch_dir, shuffles_freed
from tokenledger.sources.governance import accepted, read_governance_documents, skipped
from tokenledger.sources.landing import (
    LOOKBACK_DAYS,
    lookback,
    named,
    read_observations,
    read_scores,
    read_store_observations,
    read_store_scores,
    read_store_traces,
)
from tokenledger.sources.seen_files import SeenFiles
from tokenledger.sources.session_logs import LOG_NAME, spool_session_events


def sync_landing(
    spark: SparkSession,
    landing: str,
    store: Store,
    projects: DataFrame | None = None,
    as_of: datetime | None = None,
    days: int = LOOKBACK_DAYS,
) -> tuple[int, int]:
    """Observations and scores of the lookback window from ``<landing>/observations`` and ``/scores``."""
    window, seen = lookback(as_of, days), SeenFiles(store)
    observations = named(read_observations(spark, f"{landing}/observations", window, seen), projects)
    scores = named(read_scores(spark, f"{landing}/scores", window, seen), projects)
    return (
        store.upsert_observations(normalize_observations(observations), as_of, skip_unchanged=True),
        store.upsert_scores(normalize_scores(scores), skip_unchanged=True),
    )


def sync_trace_store(
    spark: SparkSession,
    landing: str,
    store: Store,
    as_of: datetime | None = None,
    days: int = LOOKBACK_DAYS,
    trace_days: int | None = None,
) -> tuple[int, int]:
    """The same from trace-store exports, with context taken from ``<landing>/traces``.

    ``trace_days`` reads traces over a wider window than observations.
    """
    window, seen = lookback(as_of, days), SeenFiles(store)
    traces = read_store_traces(spark, f"{landing}/traces", lookback(as_of, trace_days or days), seen)
    observations = enrich_from_traces(
        read_store_observations(spark, f"{landing}/observations", window, seen), traces
    )
    scores = read_store_scores(spark, f"{landing}/scores", window, seen)
    return (
        store.upsert_observations(normalize_observations(observations), as_of, skip_unchanged=True),
        store.upsert_scores(normalize_scores(scores), skip_unchanged=True),
    )


def seed_reference_tables(spark: SparkSession, store: Store) -> None:
    """Load the default prices and targets."""
    store.replace(MODEL_PRICES, default_model_prices(spark))
    store.replace(TARGETS, default_targets(spark))


def sync_session_logs(
    spark: SparkSession,
    root: str,
    store: Store,
    name: str = LOG_NAME,
    changed_since: datetime | None = None,
    as_of: datetime | None = None,
    **options,
) -> int:
    """Session logs. They grow in place, so a changed log is read whole again.

    Calls are priced from the stored prices; a store that has none yet gets the default ones first.
    """
    if store.read(MODEL_PRICES).isEmpty():
        store.replace(MODEL_PRICES, default_model_prices(spark))
    path = scratch_dir(spark, "session-events")
    with shuffles_freed(spark):
        events = spool_session_events(spark, root, path, name, changed_since)
        rows = session_observations(events, store.read(MODEL_PRICES), as_of=as_of, **options)
        count = store.upsert_observations(rows, as_of, skip_unchanged=True)
    store.delete(path)
    return count


def sync_governance(
    spark: SparkSession, folder: str, store: Store, as_of: datetime | None = None
) -> tuple[int, DataFrame]:
    """Governance documents of a folder: snapshots taken in, and the documents skipped."""
    documents = read_governance_documents(spark, folder)
    known = accepted(documents)
    count = store.upsert_governance(governance_snapshots(known, as_of))
    store.upsert_policies(governance_policies(known))
    store.upsert_governance_divergence(governance_divergence(known))
    return count, skipped(documents)
