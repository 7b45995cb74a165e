"""Filling an observation's context from its trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.latest import latest_by_key

CONTEXT = ["userId", "sessionId", "environment", "tags"]


def _is_empty(value: Column) -> Column:
    return value.isNull() | (value == "") | value.rlike(r"^\[\s*\]$")


def enrich_from_traces(observations: DataFrame, traces: DataFrame) -> DataFrame:
    """Raw observations with empty context fields taken from the trace.

    The observation's own value wins unless empty; of several traces with one
    id the last to arrive counts. Rows that need nothing or name no trace join
    on a key of their own, so they spread over all tasks instead of meeting in
    the one that holds NULL.

    A trace may hold a large share of the observations. Adaptive execution
    splits such a partition, but only where both sides of the join come straight
    from a shuffle; the prefix on the key gives the traces one after their
    aggregate.
    """
    context = latest_by_key(
        traces.where(F.coalesce(F.col("id") != "", F.lit(False))).select("id", *CONTEXT, "_seq"),
        ["id"],
        ["_seq"],
    ).select(
        F.concat(F.lit("trace:"), "id").alias("_key"),
        *(F.col(c).alias(f"_trace_{c}") for c in CONTEXT),
    )
    incomplete = _is_empty(F.col(CONTEXT[0]))
    for c in CONTEXT[1:]:
        incomplete = incomplete | _is_empty(F.col(c))
    wants = incomplete & F.coalesce(F.col("traceId") != "", F.lit(False))
    spread = F.xxhash64("id", "traceId", "startTime", "usageDetails").cast("string")
    keyed = observations.withColumn(
        "_key",
        F.when(wants, F.concat(F.lit("trace:"), "traceId")).otherwise(F.concat(F.lit("none:"), spread)),
    )
    filled = {
        c: F.when(_is_empty(F.col(c)) & ~_is_empty(F.col(f"_trace_{c}")), F.col(f"_trace_{c}")).otherwise(
            F.col(c)
        )
        for c in CONTEXT
    }
    return (
        keyed.join(context, "_key", "left")
        .withColumns(filled)
        .select(*observations.columns)
    )
