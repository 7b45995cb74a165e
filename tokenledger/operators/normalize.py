"""Raw telemetry to fact rows: column expressions only, one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import (
    blank_to_null,
    document,
    document_float,
    document_int,
    document_text,
    iso_timestamp,
    safe_float,
)
from tokenledger.schemas import FACT_OBSERVATION, FACT_SCORE, MONEY

# Usage keys under which prompt-cache tokens are reported.
CACHE_KEYS = [
    "cachedInput",
    "cacheReadInput",
    "cacheCreationInput",
    "inputCacheReadTokens",
    "inputCacheWriteTokens",
    "cacheReadInputTokens",
    "cacheCreationInputTokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
]


def _shaped(rows: DataFrame, spec, columns: dict[str, Column]) -> DataFrame:
    """The table's columns in order and type, plus the order of arrival if known."""
    out = [columns[f.name].cast(f.dataType).alias(f.name) for f in spec.schema.fields]
    return rows.select(*out, *(["_seq"] if "_seq" in rows.columns else []))


def _project(rows: DataFrame) -> tuple[Column, Column]:
    """Project id (the row's own, else the source's) and name (the source's)."""
    given = F.col("project") if "project" in rows.columns else F.lit(None)
    name = F.col("project_name") if "project_name" in rows.columns else F.lit(None)
    return F.coalesce(blank_to_null(F.col("projectId")), given), name


def _reasoning(usage: Column) -> Column:
    """Reasoning tokens; the second key counts when the first is absent, empty or zero."""
    first = document_text(usage, "reasoning")
    is_empty = first.isNull() | (first == "") | (first.try_cast("double") == 0)
    return F.when(is_empty, document_int(usage, "reasoningTokens")).otherwise(
        document_int(usage, "reasoning")
    )


def normalize_observations(raw: DataFrame) -> DataFrame:
    """Raw observations as ``fact_observation`` rows.

    Usage and cost details may be objects or text holding one. Prompt and
    completion bodies are not part of the raw schema, so none can get here.
    """
    parsed = raw.withColumns(
        {"_usage": document(F.col("usageDetails")), "_cost": document(F.col("costDetails"))}
    )
    usage, cost = F.col("_usage"), F.col("_cost")
    valued = parsed.withColumns(
        {
            "_input": document_int(usage, "input"),
            "_output": document_int(usage, "output"),
            "_total": document_int(usage, "total"),
            "_cached": sum((document_int(usage, k) for k in CACHE_KEYS[1:]), document_int(usage, CACHE_KEYS[0])),
            "_reasoning": _reasoning(usage),
            "_input_cost": document_float(cost, "input"),
            "_output_cost": document_float(cost, "output"),
            "_total_cost": safe_float(F.col("totalCost")),
            "_start": iso_timestamp(F.col("startTime")),
            "_end": iso_timestamp(F.col("endTime")),
        }
    )
    in_cost, out_cost = F.col("_input_cost"), F.col("_output_cost")
    total_cost = F.when(
        (F.col("_total_cost") == 0) & ((in_cost != 0) | (out_cost != 0)), in_cost + out_cost
    ).otherwise(F.col("_total_cost"))
    latency = (F.unix_micros("_end") - F.unix_micros("_start")) / F.lit(1000.0)
    project_id, project_name = _project(raw)
    return _shaped(
        valued,
        FACT_OBSERVATION,
        {
            "observation_id": F.col("id"),
            "trace_id": F.col("traceId"),
            "project_id": project_id,
            "project_name": project_name,
            "user_id": F.col("userId"),
            "session_id": F.col("sessionId"),
            "model": F.col("model"),
            "type": F.col("type"),
            "name": F.col("name"),
            "environment": F.col("environment"),
            "start_time": F.col("_start"),
            "end_time": F.col("_end"),
            "latency_ms": latency,
            "input_tokens": F.col("_input"),
            "output_tokens": F.col("_output"),
            "total_tokens": F.coalesce(
                F.nullif(F.col("_total"), F.lit(0).cast("bigint")), F.col("_input") + F.col("_output")
            ),
            "cached_input_tokens": F.col("_cached"),
            "reasoning_tokens": F.col("_reasoning"),
            "input_cost": in_cost.try_cast(MONEY),
            "output_cost": out_cost.try_cast(MONEY),
            "total_cost": total_cost.try_cast(MONEY),
            "level": F.col("level"),
            "status_message": F.col("statusMessage"),
            "tags": F.col("tags"),
        },
    )


def normalize_scores(raw: DataFrame) -> DataFrame:
    """Raw scores as ``fact_score`` rows; a nested subject fills missing ids."""
    project_id, project_name = _project(raw)
    subject_observation = F.when(F.col("subject.kind") == "OBSERVATION", F.col("subject.id"))
    return _shaped(
        raw,
        FACT_SCORE,
        {
            "score_id": F.col("id"),
            "trace_id": F.coalesce(blank_to_null(F.col("traceId")), F.col("subject.traceId")),
            "observation_id": F.coalesce(
                blank_to_null(F.col("observationId")), subject_observation
            ),
            "project_id": project_id,
            "project_name": project_name,
            "name": F.col("name"),
            "value": safe_float(F.col("value")),
            "source": F.col("source"),
            "timestamp": iso_timestamp(F.col("timestamp")),
        },
    )
