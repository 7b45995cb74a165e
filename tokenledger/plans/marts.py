"""The eight marts. Each is a lazy plan; costs stay decimal."""

from __future__ import annotations

from datetime import datetime

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import day_bucket, hour_bucket, ratio
from tokenledger.operators.latest import latest_by_key
from tokenledger.plans.rollup import (
    MEASURES,
    TOKEN_MEASURES,
    labelled,
    measure_sums,
    model_label,
    project_label,
    user_label,
    with_team,
)
from tokenledger.tables import Tables

DAILY_DIMENSIONS = ("day", "project_id", "project_name", "user_id", "model")


def usage_daily(observations: DataFrame) -> DataFrame:
    """Daily usage by project, user and model; the part worth storing.

    The distinct count makes Spark shuffle on the dimensions plus ``trace_id``
    first, so a dimension value holding most of the rows is still spread out.
    """
    return (
        labelled(observations)
        .groupBy(*DAILY_DIMENSIONS)
        .agg(F.count_distinct("trace_id").alias("traces"), *measure_sums(MEASURES, counted=True))
    )


def mrt_daily_usage(tables: Tables) -> DataFrame:
    """Usage per day, project, user, team and model."""
    stored = tables["usage_daily"] if "usage_daily" in tables else None
    usage = stored if stored is not None else usage_daily(tables.observations())
    return with_team(usage, tables["dim_user"]).select(
        "day",
        "project_id",
        "project_name",
        "user_id",
        "team",
        "model",
        "observations",
        "traces",
        *MEASURES[1:],
    )


def _efficiency_ratios() -> dict:
    return {
        "cache_hit_rate": ratio(F.col("cached_input_tokens"), F.col("input_tokens"), 4),
        "reasoning_share": ratio(F.col("reasoning_tokens"), F.col("total_tokens"), 4),
        "output_input_ratio": ratio(F.col("output_tokens"), F.col("input_tokens"), 4),
        "cost_per_1k_tokens": ratio(F.col("total_cost") * 1000, F.col("total_tokens"), 6),
    }


def usage_models(observations: DataFrame) -> DataFrame:
    """Tokens, cost and latency by day and model, as sums that can be added up over days."""
    return (
        observations.withColumn("model", model_label())
        .groupBy("day", "model")
        .agg(
            *measure_sums((*TOKEN_MEASURES, "total_cost"), counted=True),
            F.sum("latency_ms").alias("latency_sum"),
            F.count("latency_ms").alias("latency_count"),
        )
    )


def _model_usage(tables: Tables, *by: str, since: datetime | None = None) -> DataFrame:
    """Usage by model, from a midnight on; from the stored sums where there are any."""
    if "usage_models" in tables:
        rows = tables["usage_models"]
        rows = rows if since is None else rows.where(F.col("day") >= F.lit(since.date()))
        latency = F.try_divide(F.sum("latency_sum"), F.sum("latency_count"))
    else:
        rows = tables.observations(since).withColumn("model", model_label())
        latency = F.avg("latency_ms")
    return (
        rows.groupBy(*by, "model")
        .agg(
            *measure_sums((*TOKEN_MEASURES, "total_cost"), counted=True),
            latency.alias("avg_latency_ms"),
        )
        .withColumns(_efficiency_ratios())
    )


def mrt_model_efficiency(tables: Tables) -> DataFrame:
    """Efficiency per model over all time, rows without a start time included."""
    return _model_usage(tables).select(
        "model",
        "input_tokens",
        "output_tokens",
        "cached_input_tokens",
        "reasoning_tokens",
        "total_cost",
        "cache_hit_rate",
        "reasoning_share",
        "output_input_ratio",
        "cost_per_1k_tokens",
        F.round("avg_latency_ms", 1).alias("avg_latency_ms"),
    )


def mrt_model_daily(tables: Tables, since: datetime | None = None) -> DataFrame:
    """Efficiency per day and model, from a midnight on; latency is left unrounded here."""
    return _model_usage(tables, "day", since=since).select(
        "day",
        "model",
        *TOKEN_MEASURES,
        "total_cost",
        "avg_latency_ms",
        "cache_hit_rate",
        "reasoning_share",
        "output_input_ratio",
        "cost_per_1k_tokens",
    )


def mrt_org_daily(tables: Tables, exact_traces: bool = False) -> DataFrame:
    """Whole-organisation usage per day.

    ``traces`` adds up per-group distinct counts, so a trace that spans groups
    counts once per group. ``exact_traces`` adds the true count beside it.
    """
    usage = (
        tables["usage_daily"]
        if "usage_daily" in tables
        else usage_daily(tables.observations())
    )
    columns = ("observations", "traces", *TOKEN_MEASURES, "total_cost")
    daily = usage.groupBy("day").agg(*(F.sum(c).alias(c) for c in columns))
    if not exact_traces:
        return daily
    traces = tables["usage_traces"] if "usage_traces" in tables else tables.observations()
    true_counts = traces.groupBy("day").agg(F.count_distinct("trace_id").alias("traces_distinct"))
    return daily.join(true_counts, daily["day"].eqNullSafe(true_counts["day"]), "left").select(
        *(daily[c] for c in daily.columns), "traces_distinct"
    )


SESSION_MEASURES = ("observations", "input_tokens", "output_tokens", "total_tokens", "total_cost")


def _session_keys() -> dict:
    return {
        "session_id": F.coalesce("session_id", "trace_id"),
        "user_id": user_label(),
        "project_name": project_label(),
    }


def usage_traces(observations: DataFrame) -> DataFrame:
    """Usage of a day by session (or lone trace), user, project and trace; sessions and trace counts merge over days."""
    return (
        observations.withColumns(_session_keys())
        .groupBy("day", "session_id", "user_id", "project_name", "trace_id")
        .agg(
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
            *measure_sums(SESSION_MEASURES, counted=True),
        )
    )


def _stored_sessions(traces: DataFrame, active_since: datetime | None) -> DataFrame:
    keys = ["session_id", "user_id", "project_name"]
    rows = traces
    if active_since is not None:
        recent = traces.where((F.col("day") >= F.lit(active_since.date())) & (F.col("last_seen") >= F.lit(active_since)))
        recent = recent.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        rows = rows.join(recent, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    return rows.groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count_distinct("trace_id").alias("turns"),
        *measure_sums(SESSION_MEASURES, counted=False),
    )


def mrt_session(tables: Tables, active_since: datetime | None = None) -> DataFrame:
    """One row per session (or lone trace), user and project.

    With ``active_since`` only sessions with an observation from then on, each
    still whole: their keys come from a pruned scan, and facts of other sessions
    drop out before they are aggregated. With the stored usage by trace no fact
    is read at all.
    """
    if "usage_traces" in tables:
        return _stored_sessions(tables["usage_traces"], active_since)
    keys = _session_keys()
    rest = ("start_time", "trace_id", "input_tokens", "output_tokens", "total_tokens", "total_cost")
    rows = tables.observations().select(*[c.alias(n) for n, c in keys.items()], *rest)
    if active_since is not None:
        recent = tables.observations(active_since).select(*[c.alias(f"_{n}") for n, c in keys.items()])
        same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in keys]
        rows = rows.join(recent.distinct(), same, "left_semi")
    return (
        rows.groupBy("session_id", "user_id", "project_name")
        .agg(
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
            F.count_distinct("trace_id").alias("turns"),
            *measure_sums(SESSION_MEASURES, counted=True),
        )
    )


def hourly_usage_of(observations: DataFrame) -> DataFrame:
    return (
        observations.withColumns(
            {"hour": hour_bucket(F.col("start_time")), "project_name": project_label()}
        )
        .groupBy("hour", "project_name")
        .agg(
            *measure_sums(SESSION_MEASURES, counted=True)
        )
    )


def mrt_hourly_usage(tables: Tables) -> DataFrame:
    """Usage per hour and project."""
    if "usage_hourly" in tables:
        return tables["usage_hourly"].drop("day")
    return hourly_usage_of(tables.observations())


def mrt_governance_daily(tables: Tables, per_project: bool = False) -> DataFrame:
    """The latest governance snapshot of each day.

    One per day over all projects by default; ``per_project`` keeps one per day
    and project. Equal export times are settled by snapshot id.
    """
    scope = ["project_id"] if per_project else []
    snapshots = tables["fact_governance"].withColumn("day", day_bucket(F.col("exported_at")))
    return latest_by_key(snapshots, ["day", *scope], ["exported_at", "snapshot_id"]).select(
        "day",
        *scope,
        "ttrp_ms",
        "precision14_ratio",
        "proposals_total",
        "proposals_pending",
        "proposals_ratified",
        "proposals_rejected",
        "proposals_decayed",
    )


def mrt_policy_coverage(tables: Tables) -> DataFrame:
    """Policies, their evidence and the share of traces the evidence amounts to.

    Evidence is a count per policy, not a set of traces, so the ratio is an
    upper bound and may exceed 1.
    """
    traces = tables["usage_traces" if "usage_traces" in tables else "fact_observation"]
    traces = traces.agg(F.count_distinct("trace_id").alias("n"))
    return (
        tables["dim_policy"]
        .agg(
            F.count(F.lit(1)).alias("ratified_policies"),
            F.coalesce(F.sum("evidence_traces"), F.lit(0).cast("bigint")).alias("evidence_traces"),
        )
        .select("*", traces.scalar().alias("total_traces"))
        .withColumn(
            "coverage_ratio", ratio(F.col("evidence_traces"), F.col("total_traces"), 4)
        )
    )


MARTS: dict[str, Callable[[Tables], DataFrame]] = {
    "mrt_daily_usage": mrt_daily_usage,
    "mrt_model_efficiency": mrt_model_efficiency,
    "mrt_org_daily": mrt_org_daily,
    "mrt_session": mrt_session,
    "mrt_model_daily": mrt_model_daily,
    "mrt_hourly_usage": mrt_hourly_usage,
    "mrt_governance_daily": mrt_governance_daily,
    "mrt_policy_coverage": mrt_policy_coverage,
}


def register_marts(tables: Tables) -> list[str]:
    """Create a temporary view per table and mart for use from SQL."""
    for name, mart in MARTS.items():
        mart(tables).createOrReplaceTempView(name)
    for name in ("fact_observation", "fact_score", "dim_user", "budget", "model_prices",
                 "targets", "sync_state", "dim_policy", "fact_governance",
                 "fact_governance_divergence"):
        tables[name].createOrReplaceTempView(name)
    return list(MARTS)
