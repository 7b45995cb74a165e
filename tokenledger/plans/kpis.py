"""KPI questions. Each returns a lazy DataFrame for an explicit point in time.

Windows have a lower bound only: rows later than ``as_of`` count. One-row KPIs
that combine several windows are computed in a single pass with conditional
sums over the widest window, so the fact table is scanned once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import (
    UNASSIGNED,
    check_name,
    check_range,
    date_before,
    days_before,
    divide,
    midnight,
    month_start,
    next_full_hour,
    ratio,
    sum_if,
    usd,
    utc,
)
from tokenledger.plans.marts import (
    hourly_usage_of,
    mrt_model_daily,
    mrt_model_efficiency,
    mrt_session,
)
from tokenledger.plans.rollup import user_label, usage_rollup, with_team
from tokenledger.tables import Tables

# The dimensions a question may be asked by, and their columns.
DIMENSIONS = {
    "project": "project_name",
    "team": "team",
    "user": "user_id",
    "model": "model",
}


# -- overview ----------------------------------------------------------------


def _month_so_far() -> list[Column]:
    ratio_or_zero = F.coalesce(
        ratio(F.col("cost_mtd") * 1000, F.col("tokens_mtd"), 6), F.lit(0.0)
    )
    return [
        usd(F.col("cost_mtd")).alias("cost_mtd"),
        "tokens_mtd",
        "input_tokens_mtd",
        "output_tokens_mtd",
        "cached_tokens_mtd",
        "observations_mtd",
        "active_users_mtd",
        "sessions_mtd",
        ratio_or_zero.alias("cost_per_1k_tokens"),
    ]


# Observation column behind each month-to-date sum.
_MTD_SUMS = {
    "cost_mtd": "total_cost",
    "tokens_mtd": "total_tokens",
    "input_tokens_mtd": "input_tokens",
    "output_tokens_mtd": "output_tokens",
    "cached_tokens_mtd": "cached_input_tokens",
}


def _overview_base(tables: Tables, as_of: datetime) -> DataFrame:
    """Month-to-date and week-over-week sums in one row from one scan.

    Two distinct counts in one global aggregate would copy every input row
    twice before the shuffle. Aggregating by (user, session) first leaves one
    row per session for that step.
    """
    start, week, fortnight = month_start(as_of), days_before(as_of, 7), days_before(as_of, 14)
    at = F.col("start_time")
    in_month = at >= F.lit(start)
    last7 = at >= F.lit(week)
    prev7 = (at >= F.lit(fortnight)) & (at < F.lit(week))
    sessions = (
        tables.observations(min(start, fortnight))
        .groupBy("user_id", "session_id")
        .agg(
            *(sum_if(F.col(source), in_month).alias(name) for name, source in _MTD_SUMS.items()),
            F.count_if(in_month).alias("observations_mtd"),
            sum_if(F.col("total_cost"), last7).alias("last7"),
            sum_if(F.col("total_cost"), prev7).alias("prev7"),
        )
    )
    seen = F.col("observations_mtd") > 0
    return sessions.agg(
        *(F.sum(name).alias(name) for name in _MTD_SUMS),
        F.coalesce(F.sum("observations_mtd"), F.lit(0).cast("bigint")).alias("observations_mtd"),
        F.count_distinct(F.when(seen, F.col("user_id"))).alias("active_users_mtd"),
        F.count_distinct(F.when(seen, F.col("session_id"))).alias("sessions_mtd"),
        F.coalesce(F.sum("last7"), F.lit(0)).alias("last7"),
        F.coalesce(F.sum("prev7"), F.lit(0)).alias("prev7"),
    )


def kpi_overview_mtd(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Spend, tokens, users and sessions since the start of the month."""
    return _overview_base(tables, utc(as_of)).select(*_month_so_far())


def kpi_overview_wow(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Cost of the last seven days and of the seven before."""
    as_of = utc(as_of)
    at, week, fortnight = F.col("start_time"), days_before(as_of, 7), days_before(as_of, 14)
    cost = F.col("total_cost")
    return tables.observations(fortnight).agg(
        usd(F.coalesce(sum_if(cost, at >= F.lit(week)), F.lit(0))).alias("last7"),
        usd(F.coalesce(sum_if(cost, at < F.lit(week)), F.lit(0))).alias("prev7"),
    )


def kpi_overview(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """The overview row: month so far, its ratios and the weekly change in per cent."""
    change = divide(F.col("last7") - F.col("prev7"), F.col("prev7")) * 100
    return _overview_base(tables, utc(as_of)).select(
        *_month_so_far(),
        ratio(F.col("cached_tokens_mtd"), F.col("input_tokens_mtd"), 4).alias("cache_hit_rate"),
        ratio(F.col("output_tokens_mtd"), F.col("input_tokens_mtd"), 4).alias("output_input_ratio"),
        ratio(F.col("cost_mtd"), F.col("active_users_mtd"), 2).alias("cost_per_active_dev"),
        ratio(F.col("cost_mtd"), F.col("sessions_mtd"), 4).alias("avg_cost_per_session"),
        F.round(change, 1).alias("wow_cost_pct"),
    )


# -- spend by dimension --------------------------------------------------------


def _spend(usage: DataFrame, *by: Column) -> DataFrame:
    return usage.select(
        *by, usd(F.col("total_cost")).alias("total_cost"), "total_tokens", "observations"
    )


_SPEND = ("total_cost", "total_tokens", "observations")


def kpi_daily(
    tables: Tables, dimension: str = "project", days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Spend per day and label. An unknown dimension means project."""
    check_range("days", days, 1, 365)
    column = DIMENSIONS.get(dimension, "project_name")
    usage = usage_rollup(tables, ["day", column], _SPEND, date_before(utc(as_of), days))
    return _spend(usage, F.col("day"), F.col(column).alias("label")).orderBy("day", "label")


def kpi_top(
    tables: Tables,
    dimension: str = "user",
    metric: str = "cost",
    days: int = 30,
    limit: int = 10,
    as_of: datetime | None = None,
) -> DataFrame:
    """Top spenders by cost, or by tokens for any other metric."""
    check_range("days", days, 1, 365)
    check_range("limit", limit, 1, 100)
    column = DIMENSIONS.get(dimension, "user_id")
    metric_column = "total_cost" if metric == "cost" else "total_tokens"
    usage = usage_rollup(tables, [column], _SPEND, date_before(utc(as_of), days))
    ranked = usage.orderBy(F.desc(metric_column), F.asc(column)).limit(limit)
    return _spend(ranked, F.col(column).alias("label"))


def kpi_user_daily(tables: Tables, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Cost per user and day."""
    check_range("days", days, 1, 730)
    usage = usage_rollup(tables, ["user_id", "day"], ("total_cost",), date_before(utc(as_of), days))
    return usage.select("user_id", "day", usd(F.col("total_cost")).alias("total_cost")).orderBy(
        "day", "user_id"
    )


# -- efficiency ------------------------------------------------------------------


def kpi_efficiency(tables: Tables) -> DataFrame:
    """Model efficiency, most expensive model first.

    ``token_volume`` is input plus output, as a token column in a table of
    models shows it; it leaves reasoning tokens out.
    """
    return (
        mrt_model_efficiency(tables)
        .withColumn("token_volume", F.col("input_tokens") + F.col("output_tokens"))
        .orderBy(F.desc("total_cost"), F.asc("model"))
        .withColumn("total_cost", usd(F.col("total_cost")))
    )


def kpi_model_daily(
    tables: Tables, days: int = 30, model: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Model efficiency as a daily series, for one model or all."""
    check_range("days", days, 1, 365)
    since = midnight(date_before(utc(as_of), days))
    series = mrt_model_daily(tables, since)
    if check_name(model):
        series = series.where(F.col("model") == model)
    return series.select(
        "day",
        "model",
        "cache_hit_rate",
        "reasoning_share",
        "output_input_ratio",
        "cost_per_1k_tokens",
        "input_tokens",
        "output_tokens",
        usd(F.col("total_cost")).alias("total_cost"),
    ).orderBy("day", "model")


def kpi_hourly(
    tables: Tables, days: int = 7, project: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Usage per hour and project. The hour the window starts in is left out.

    An hour bucket lies in the window exactly when its observations start at or
    after the next full hour, which is a filter the scan understands.
    """
    check_range("days", days, 1, 90)
    since = next_full_hour(days_before(utc(as_of), days))
    if "usage_hourly" in tables:
        stored = tables["usage_hourly"].where((F.col("day") >= F.lit(since.date())) & (F.col("hour") >= F.lit(since)))
        usage = stored.drop("day")
    else:
        usage = hourly_usage_of(tables.observations(since))
    if check_name(project):
        usage = usage.where(F.col("project_name") == project)
    return usage.withColumn("total_cost", usd(F.col("total_cost"))).orderBy("hour", "project_name")


# -- sessions ----------------------------------------------------------------------


def _recent_sessions(tables: Tables, days: int, as_of: datetime | None) -> DataFrame:
    check_range("days", days, 1, 365)
    since = days_before(utc(as_of), days)
    return mrt_session(tables, since).where(F.col("last_seen") >= F.lit(since))


def kpi_session_stats(tables: Tables, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    """Averages over sessions last seen inside the window."""

    def mean(column: str, digits: int) -> Column:
        return ratio(F.sum(column), F.count(column), digits)

    return _recent_sessions(tables, days, as_of).agg(
        F.count(F.lit(1)).alias("sessions"),
        mean("input_tokens", 1).alias("avg_context_tokens"),
        mean("turns", 1).alias("avg_turns"),
        mean("total_cost", 4).alias("avg_cost"),
        ratio(F.sum("input_tokens"), F.sum("turns"), 1).alias("avg_input_per_turn"),
    )


def kpi_sessions_top(
    tables: Tables, days: int = 30, limit: int = 20, as_of: datetime | None = None
) -> DataFrame:
    """Sessions with the most input tokens; ``tokens_per_turn`` is the per-task volume."""
    check_range("limit", limit, 1, 100)
    return (
        _recent_sessions(tables, days, as_of)
        .orderBy(F.desc("input_tokens"), "session_id", "user_id", "project_name")
        .limit(limit)
        .select(
            "session_id",
            "user_id",
            "project_name",
            "turns",
            "observations",
            "input_tokens",
            "output_tokens",
            usd(F.col("total_cost")).alias("total_cost"),
            ratio(F.col("input_tokens"), F.col("turns"), 1).alias("input_per_turn"),
            ratio(F.col("total_tokens"), F.col("turns"), 1).alias("tokens_per_turn"),
        )
    )


# -- budget and attribution -----------------------------------------------------------


def kpi_budget(tables: Tables) -> DataFrame:
    """The monthly budget of the whole organisation: one row, NULL when unset."""
    organisation = (
        (F.col("scope_type") == "global")
        & (F.col("scope_id") == "*")
        & (F.col("period") == "monthly")
    )
    return tables["budget"].where(organisation).agg(F.max("budget_usd").alias("budget_usd"))


def kpi_month_cost(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Cost and active users since the start of the month."""
    return tables.observations(month_start(utc(as_of))).agg(
        usd(F.coalesce(F.sum("total_cost"), F.lit(0))).alias("mtd_cost"),
        F.count_distinct("user_id").alias("active_users"),
    )


def kpi_unattributed(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Month-to-date cost of users without a team."""
    usage = usage_rollup(tables, ["team"], ("total_cost",), month_start(utc(as_of)).date())
    return usage.where(F.col("team") == UNASSIGNED).agg(
        usd(F.coalesce(F.sum("total_cost"), F.lit(0))).alias("cost")
    )


def kpi_concentration(
    tables: Tables, days: int = 30, n: int = 5, as_of: datetime | None = None
) -> DataFrame:
    """Summed cost of the n costliest users; unattributed spend is one of them."""
    users = usage_rollup(tables, ["user_id"], ("total_cost",), date_before(utc(as_of), days))
    return (
        users.orderBy(F.desc("total_cost"), F.asc("user_id"))
        .limit(n)
        .agg(usd(F.sum("total_cost")).alias("top_cost"))
    )


def kpi_total_cost(tables: Tables, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    """Cost over the window."""
    since = midnight(date_before(utc(as_of), days))
    return tables.observations(since).agg(usd(F.sum("total_cost")).alias("total_cost"))


def kpi_governance(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Budget burn, unattributed share and spend concentration in one row.

    One scan aggregates both windows per user; the top-5 sum is a scalar
    subquery over that same aggregate, whose shuffle is reused.
    """
    as_of = utc(as_of)
    start, thirty = month_start(as_of), midnight(date_before(as_of, 30))
    at, cost = F.col("start_time"), F.col("total_cost")
    in_month, in_thirty = at >= F.lit(start), at >= F.lit(thirty)
    users = (
        tables.observations(min(start, thirty))
        .groupBy("user_id")
        .agg(
            sum_if(cost, in_month).alias("month_cost"),
            F.count_if(in_month).alias("month_rows"),
            sum_if(cost, in_thirty).alias("cost_30d"),
            F.count_if(in_thirty).alias("rows_30d"),
        )
    )
    # Both branches use every column, so that pruning leaves them the same plan to
    # share; the label already makes the order unique.
    in_window = F.col("rows_30d") > 0
    top5 = (
        users.where(in_window)
        .orderBy(F.desc("cost_30d"), F.asc(user_label()), "month_cost", "month_rows")
        .limit(5)
        .agg(F.sum("cost_30d").alias("top_cost"))
    )
    # A NULL user matches no team; the reserved label never has one.
    totals = with_team(users, tables["dim_user"]).agg(
        usd(F.coalesce(F.sum("month_cost"), F.lit(0))).alias("mtd_cost"),
        F.count_if((F.col("month_rows") > 0) & F.col("user_id").isNotNull()).alias("active_users"),
        usd(
            F.coalesce(sum_if(F.col("month_cost"), F.col("team") == UNASSIGNED), F.lit(0))
        ).alias("unattributed"),
        sum_if(F.col("cost_30d"), in_window).alias("total_30d"),
    )
    return totals.select(
        "*",
        kpi_budget(tables).scalar().alias("monthly_budget"),
        top5.scalar().alias("top_cost"),
    ).select(
        "mtd_cost",
        "monthly_budget",
        ratio(F.col("mtd_cost"), F.col("monthly_budget"), 4).alias("burn_rate"),
        "active_users",
        F.round("unattributed", 6).alias("unattributed_cost"),
        ratio(F.col("unattributed"), F.col("mtd_cost"), 4).alias("unattributed_pct"),
        ratio(F.col("top_cost"), F.col("total_30d"), 4).alias("concentration_top5_pct"),
    )


def kpi_targets(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Stored thresholds against current values; metrics without one are left out."""
    month = tables.observations(month_start(utc(as_of))).agg(
        F.sum("total_cost").alias("cost"),
        *(F.sum(c).alias(c) for c in (
            "total_tokens", "input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens"
        )),
    )
    budget = kpi_budget(tables).scalar()
    current = month.select(
        ratio(F.col("cached_input_tokens"), F.col("input_tokens"), 4).alias("cache_hit_rate"),
        ratio(F.col("output_tokens"), F.col("input_tokens"), 4).alias("output_input_ratio"),
        F.coalesce(ratio(F.col("cost") * 1000, F.col("total_tokens"), 6), F.lit(0.0)).alias(
            "cost_per_1k_tokens"
        ),
        ratio(F.coalesce(F.col("cost"), F.lit(0)), budget, 4).alias("burn_rate"),
        divide(F.col("reasoning_tokens"), F.col("total_tokens")).alias("reasoning_share"),
    ).unpivot(
        [],
        ["cache_hit_rate", "output_input_ratio", "cost_per_1k_tokens", "burn_rate", "reasoning_share"],
        "metric",
        "current",
    )
    passes = F.when(F.col("op") == "gte", F.col("current") >= F.col("threshold")).when(
        F.col("op") == "lte", F.col("current") <= F.col("threshold")
    )
    return (
        tables["targets"]
        .join(current.where(F.col("current").isNotNull()), "metric")
        .select(
            "metric",
            "label",
            F.round("current", 4).alias("current"),
            "threshold",
            "op",
            passes.alias("pass"),
        )
        .orderBy("metric")
    )


# -- outcomes ------------------------------------------------------------------------


def _trace_outcomes(tables: Tables, score_name: str | None) -> DataFrame:
    """Cost and best score per scored trace, money still decimal.

    Both sides are summed on ``trace_id`` before anything is joined: each task sums its own facts first, so a hot trace
    crosses the shuffle as one row a task, and the join finds both sides partitioned by the trace already.
    """
    scores = tables["fact_score"].where(F.col("trace_id").isNotNull())
    if check_name(score_name):
        scores = scores.where(F.col("name") == score_name)
    best = scores.groupBy("trace_id").agg(F.max("value").alias("best_score"))
    facts = tables["fact_observation"].where(F.col("trace_id").isNotNull())
    costs = facts.groupBy("trace_id").agg(F.coalesce(F.sum("total_cost"), F.lit(0)).alias("cost"))
    return costs.join(best, "trace_id")


def kpi_trace_outcomes(tables: Tables, score_name: str | None = None) -> DataFrame:
    """Cost and best score of every scored trace."""
    return _trace_outcomes(tables, score_name).withColumn("cost", usd(F.col("cost")))


def kpi_quality(
    tables: Tables, score_name: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """Pass rate and cost per success; a trace without a score value does not pass."""
    check_range("threshold", threshold, 0.0, 1.0)
    passing = F.col("best_score") >= threshold
    cost = F.col("cost")
    totals = _trace_outcomes(tables, score_name).agg(
        F.count(F.lit(1)).alias("scored_traces"),
        F.count_if(passing).alias("passing_traces"),
        F.coalesce(F.sum(cost), F.lit(0)).alias("scored_cost"),
        F.coalesce(sum_if(cost, passing), F.lit(0)).alias("passing_cost"),
    )
    return totals.select(
        "scored_traces",
        "passing_traces",
        ratio(F.col("passing_traces"), F.col("scored_traces"), 4).alias("pass_rate"),
        F.round(usd(F.col("scored_cost")), 6).alias("scored_cost"),
        F.round(usd(F.col("passing_cost")), 6).alias("passing_cost"),
        ratio(F.col("passing_cost"), F.col("passing_traces"), 6).alias("cost_per_success"),
        ratio(F.col("scored_cost"), F.col("scored_traces"), 6).alias("cost_per_scored_trace"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(score_name or "(all)").alias("score_name"),
    )


# -- behaviour governance ---------------------------------------------------------------

_SNAPSHOT = (
    "ttrp_ms",
    "precision14_numerator",
    "precision14_denominator",
    "precision14_ratio",
    "proposals_total",
    "proposals_pending",
    "proposals_ratified",
    "proposals_rejected",
    "proposals_decayed",
)


def _latest_snapshot(tables: Tables) -> DataFrame:
    """Exactly one row: the latest snapshot, or NULLs when there is none."""
    order = F.struct("exported_at", "snapshot_id")
    return (
        tables["fact_governance"]
        .agg(F.max_by(F.struct(*_SNAPSHOT), order).alias("s"), F.count(F.lit(1)).alias("n"))
        .select("n", "s.*")
    )


def kpi_governance_snapshot(tables: Tables) -> DataFrame:
    """The latest governance snapshot over all projects, if any."""
    return _latest_snapshot(tables).where(F.col("n") > 0).select(*_SNAPSHOT)


def kpi_behaviour_metrics(tables: Tables) -> DataFrame:
    """Snapshot metrics with counts defaulting to zero; one row even when empty."""
    counts = {
        c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        for c in _SNAPSHOT
        if c not in ("ttrp_ms", "precision14_ratio")
    }
    return (
        _latest_snapshot(tables)
        .withColumn("ttrp_ms", F.col("ttrp_ms").cast("bigint"))
        .withColumns(counts)
        .select(*_SNAPSHOT)
    )


def kpi_policies(tables: Tables) -> DataFrame:
    """The policy registry by rule key."""
    return (
        tables["dim_policy"]
        .select(
            "rule_key", "project_id", "kind", "status", "confidence", "promoted_at", "operator",
            F.coalesce("evidence_traces", F.lit(0).cast("bigint")).alias("evidence_traces"),
        )
        .orderBy("rule_key")
    )


def kpi_divergence(tables: Tables) -> DataFrame:
    """Divergent traces by model and task."""
    zero = F.lit(0).cast("bigint")
    return (
        tables["fact_governance_divergence"]
        .select(
            "project_id", "model", "task_key",
            F.coalesce("divergent_traces", zero).alias("divergent_traces"),
            F.coalesce("total_traces", zero).alias("total_traces"),
        )
        .orderBy("model", "task_key", "project_id")
    )


def behaviour(tables: Tables) -> dict[str, DataFrame]:
    """The three parts of the behaviour view, side by side."""
    return {
        "metrics": kpi_behaviour_metrics(tables),
        "policies": kpi_policies(tables),
        "divergence": kpi_divergence(tables),
    }
