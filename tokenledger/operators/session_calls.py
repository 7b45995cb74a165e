"""Session events to priced model calls.

Three things carry over from line to line of a log: the current session id, the
cache counter of the previous usable message and the number of calls so far. A
plain window over the file would sort a whole log in one task. Instead each
chunk of a log is windowed on its own and a second, tiny window hands the state
at the end of each chunk to the chunks after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import UNKNOWN, blank_to_null, utc
from tokenledger.schemas import FACT_OBSERVATION, MONEY

# Fixed value: leading part of a project folder that names a home directory.
HOME_PREFIX = "^home-[^-]+-"

# What a session log row always is.
CALL_TYPE = "GENERATION"
CALL_NAME = "assistant"
CALL_ENVIRONMENT = "cli"


def project_slug(folder: Column, prefix: str | None = None) -> Column:
    """Project name from a folder: outer dashes off, then the home or given prefix."""
    stripped = F.btrim(folder, F.lit("-"))
    if prefix:
        return F.when(
            stripped.startswith(prefix), F.substring(stripped, F.lit(len(prefix) + 1), F.length(stripped))
        ).otherwise(stripped)
    return F.regexp_replace(stripped, HOME_PREFIX, "")


def _count(field: str) -> Column:
    return F.coalesce(F.col(f"usage.{field}").cast("bigint"), F.lit(0).cast("bigint"))


def cached_tokens(input_tokens: Column, counter: Column, previous: Column) -> Column:
    """Cache reads of one call from a running counter: its rise, at most the input.

    The first call has none, and a falling counter gives zero.
    """
    zero = F.lit(0).cast("bigint")
    rise = F.greatest(zero, counter - previous)
    return F.when(previous.isNull(), zero).otherwise(F.least(input_tokens, rise))


def session_calls(events: DataFrame) -> DataFrame:
    """One row per usable assistant message, in log order, with its cache delta."""
    usable = (F.col("type") == "assistant/message") & (
        (_count("inputTokens") != 0) | (_count("outputTokens") != 0)
    )
    is_session = F.col("type") == "session"
    marked = events.where(is_session | usable).select(
        "file",
        "line",
        "chunk",
        "project_folder",
        "session_folder",
        "time",
        "model",
        usable.alias("is_call"),
        # Wrapped, so that a session event without an id still replaces the one before.
        F.when(is_session, F.struct(F.col("id"))).alias("session"),
        F.when(usable, _count("inputTokens")).alias("input_tokens"),
        F.when(usable, _count("outputTokens")).alias("output_tokens"),
        F.when(usable, _count("reasoningTokens")).alias("reasoning_tokens"),
        F.when(usable, _count("cacheReadTokens")).alias("counter"),
    )
    in_chunk = Window.partitionBy("file", "chunk").orderBy("line")
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns(
        {
            "session": F.last("session", ignorenulls=True).over(upto),
            "previous": F.last("counter", ignorenulls=True).over(before),
            "latest": F.last("counter", ignorenulls=True).over(upto),
            "calls": F.count_if("is_call").over(upto),
        }
    )
    # State at the end of each chunk; same partitioning, so no further shuffle.
    ends = local.groupBy("file", "chunk").agg(
        F.max_by("session", "line").alias("session"),
        F.max_by("latest", "line").alias("latest"),
        F.max("calls").alias("calls"),
    )
    earlier = (
        Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        "file",
        "chunk",
        F.last("session", ignorenulls=True).over(earlier).alias("session_before"),
        F.last("latest", ignorenulls=True).over(earlier).alias("counter_before"),
        F.coalesce(F.sum("calls").over(earlier), F.lit(0)).alias("calls_before"),
    )
    previous = F.coalesce("previous", "counter_before")
    return (
        local.where("is_call")
        .join(carried, ["file", "chunk"])
        .select(
            "file",
            "line",
            "project_folder",
            F.coalesce(
                blank_to_null(F.coalesce("session", "session_before").getField("id")),
                F.col("session_folder"),
            ).alias("session_id"),
            "time",
            "model",
            "input_tokens",
            "output_tokens",
            "reasoning_tokens",
            cached_tokens(F.col("input_tokens"), F.col("counter"), previous).alias("cached_input_tokens"),
            (F.col("calls") + F.col("calls_before") - 1).alias("call_index"),
        )
    )


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with input, output and total cost; a model without a price costs nothing.

    Prices are one row per model, so the planner broadcasts them by their size.
    Amounts are exact decimals up to a single half-up rounding to six digits;
    the total is rounded from unrounded parts. Types are narrow enough for the
    product to keep all its twelve digits.
    """

    def price(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0.0)).cast("decimal(12,6)")

    def tokens(count: Column) -> Column:
        return count.cast("decimal(12,0)")

    def dollars(raw: Column) -> Column:
        return (raw * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(18,6)").cast(MONEY)

    uncached = F.col("input_tokens") - F.col("cached_input_tokens")
    raw_input = price("input_hit_per_1m") * tokens(F.col("cached_input_tokens")) + price(
        "input_miss_per_1m"
    ) * tokens(uncached)
    raw_output = price("output_per_1m") * tokens(F.col("output_tokens"))
    priced = calls.join(prices, "model", "left").withColumns(
        {"_in": raw_input, "_out": raw_output}
    )
    return priced.select(
        *calls.columns,
        dollars(F.col("_in")).alias("input_cost"),
        dollars(F.col("_out")).alias("output_cost"),
        dollars(F.col("_in") + F.col("_out")).alias("total_cost"),
    )


def session_observations(
    events: DataFrame,
    prices: DataFrame,
    user_id: str = "local",
    id_prefix: str = "log",
    project_prefix: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Session logs as ``fact_observation`` rows.

    Ids are ``<id_prefix>-<session>-<index of the call in its file>``: stable as
    long as logs only grow. The total counts reasoning tokens, which totals of
    landed observations do not.
    """
    called = price_calls(session_calls(events), prices)
    millis = F.nullif(F.col("time"), F.lit(0.0))
    at = F.coalesce(F.timestamp_micros((millis * 1000).cast("bigint")), F.lit(utc(as_of)))
    identifier = F.concat_ws("-", F.lit(id_prefix), F.col("session_id"), F.col("call_index").cast("string"))
    project = project_slug(F.col("project_folder"), project_prefix)
    columns = {
        "observation_id": identifier,
        "trace_id": identifier,
        "project_id": project,
        "project_name": project,
        "user_id": F.lit(user_id),
        "session_id": F.col("session_id"),
        "model": F.coalesce(blank_to_null(F.col("model")), F.lit(UNKNOWN)),
        "type": F.lit(CALL_TYPE),
        "name": F.lit(CALL_NAME),
        "environment": F.lit(CALL_ENVIRONMENT),
        "start_time": at,
        "end_time": at,
        "latency_ms": F.lit(0.0),
        "total_tokens": F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"),
    }
    kept = set(called.columns) - {"file", "line", "project_folder", "time", "call_index"}
    out = []
    for field in FACT_OBSERVATION.schema.fields:
        if field.name in columns:
            column = columns[field.name]
        elif field.name in kept:
            column = F.col(field.name)
        else:
            column = F.lit(None)
        out.append(column.cast(field.dataType).alias(field.name))
    return called.select(*out, F.struct("file", "line").alias("_seq"))
