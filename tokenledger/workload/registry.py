"""Registered queries: name to a callable (spark, folder of driver tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.scalars import edge, ratio
from tokenledger.plans import dashboards as dash
from tokenledger.plans import kpis, marts
from tokenledger.plans import timeseries as ts
from tokenledger.plans.rollup import usage_rollup
from tokenledger.tables import Tables
from tokenledger.workload.projections import (
    AS_OF,
    AS_OF_LONG,
    event_scores,
    event_tables,
    line_tables,
    order_tables,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

FIRST, LAST = date(2024, 1, 5), date(2024, 1, 25)


def _over(name: str, question: Callable[[Tables], DataFrame], source=event_tables) -> None:
    QUERIES[name] = lambda spark, sf_dir: edge(question(source(spark, sf_dir)))


# -- marts -------------------------------------------------------------------------

for _name, _mart in marts.MARTS.items():
    _over(_name, _mart)
_over(
    "mrt_org_daily_exact",
    lambda t: marts.mrt_org_daily(t, exact_traces=True).select(
        "day", "traces", "traces_distinct", "total_cost"
    ),
)
_over("mrt_governance_daily_per_project", lambda t: marts.mrt_governance_daily(t, per_project=True))
_over("mrt_daily_usage_volume", marts.mrt_daily_usage, line_tables)

# -- KPIs --------------------------------------------------------------------------

_over("kpi_overview_mtd", lambda t: kpis.kpi_overview_mtd(t, AS_OF))
_over("kpi_overview_wow", lambda t: kpis.kpi_overview_wow(t, AS_OF))
_over("kpi_overview", lambda t: kpis.kpi_overview(t, AS_OF))
for _dimension in kpis.DIMENSIONS:
    _over(
        f"kpi_daily_{_dimension}",
        lambda t, dimension=_dimension: kpis.kpi_daily(t, dimension, as_of=AS_OF),
    )
_over("kpi_top_cost", lambda t: kpis.kpi_top(t, as_of=AS_OF))
_over("kpi_top_tokens", lambda t: kpis.kpi_top(t, metric="tokens", as_of=AS_OF))
_over("kpi_top_team", lambda t: kpis.kpi_top(t, "team", as_of=AS_OF))
_over("kpi_efficiency", kpis.kpi_efficiency)
_over(
    "kpi_budget",
    lambda t: kpis.kpi_month_cost(t, AS_OF).select(
        kpis.kpi_budget(t).scalar().alias("monthly_budget"), "mtd_cost", "active_users"
    ),
)
_over("kpi_month_cost", lambda t: kpis.kpi_month_cost(t, AS_OF))
_over("kpi_unattributed", lambda t: kpis.kpi_unattributed(t, AS_OF))
_over("kpi_concentration", lambda t: kpis.kpi_concentration(t, as_of=AS_OF))
_over("kpi_total_cost", lambda t: kpis.kpi_total_cost(t, as_of=AS_OF))
_over("kpi_governance", lambda t: kpis.kpi_governance(t, AS_OF))
_over("kpi_session_stats", lambda t: kpis.kpi_session_stats(t, as_of=AS_OF))
_over("kpi_sessions_top", lambda t: kpis.kpi_sessions_top(t, as_of=AS_OF))
_over(
    "tokens_per_turn",
    lambda t: marts.mrt_session(t).select(
        "session_id",
        "user_id",
        "project_name",
        ratio(F.col("total_tokens"), F.col("turns"), 1).alias("tokens_per_turn"),
    ),
)
_over("kpi_org_daily", lambda t: ts.kpi_org_daily(t, as_of=AS_OF))
_over("kpi_trace_outcomes", kpis.kpi_trace_outcomes)
_over("kpi_quality", kpis.kpi_quality)
QUERIES["kpi_quality_named"] = lambda spark, sf_dir: edge(
    kpis.kpi_quality(
        event_tables(spark, sf_dir).with_frames(
            fact_score=event_scores(spark, sf_dir)
        ),
        "correctness",
        0.25,
    )
)
_over("kpi_model_daily", lambda t: kpis.kpi_model_daily(t, as_of=AS_OF))
_over("kpi_model_daily_one", lambda t: kpis.kpi_model_daily(t, model="model-a", as_of=AS_OF))
_over("kpi_hourly", lambda t: kpis.kpi_hourly(t, as_of=AS_OF))
_over("kpi_hourly_project", lambda t: kpis.kpi_hourly(t, project="Docs", as_of=AS_OF))
_over("kpi_user_daily", lambda t: kpis.kpi_user_daily(t, as_of=AS_OF))
_over("kpi_governance_snapshot", kpis.kpi_governance_snapshot)
_over("kpi_behaviour_metrics", kpis.kpi_behaviour_metrics)
_over("kpi_policies", kpis.kpi_policies)
_over("kpi_divergence", kpis.kpi_divergence)
_over("kpi_targets", lambda t: kpis.kpi_targets(t, AS_OF))

# -- time series -------------------------------------------------------------------

_over("kpi_baseline", lambda t: ts.kpi_baseline(t, as_of=AS_OF))
_over("kpi_baseline_long", lambda t: ts.kpi_baseline(t, 365, AS_OF_LONG), order_tables)
_over("kpi_anomalies", lambda t: ts.kpi_anomalies(t, as_of=AS_OF))
_over("kpi_anomalies_low", lambda t: ts.kpi_anomalies(t, threshold=1.05, as_of=AS_OF))
_over("kpi_anomaly_latest", lambda t: ts.kpi_anomaly_latest(t, as_of=AS_OF))
_over(
    "anomalies_recent", lambda t: ts.anomalies_recent(t, 351, as_of=AS_OF_LONG), order_tables
)
_over("kpi_burndown", lambda t: ts.kpi_burndown(t, AS_OF))
_over("kpi_burndown_summary", lambda t: ts.kpi_burndown_summary(t, AS_OF))
_over("kpi_periods_weekly", lambda t: ts.kpi_periods_weekly(t, as_of=AS_OF))
_over("kpi_periods_monthly", lambda t: ts.kpi_periods_monthly(t, as_of=AS_OF))
_over("kpi_periods_weekly_long", lambda t: ts.kpi_periods_weekly(t, 730, AS_OF_LONG), order_tables)
_over(
    "kpi_periods_monthly_long", lambda t: ts.kpi_periods_monthly(t, 730, AS_OF_LONG), order_tables
)


def _all_time_series(t: Tables) -> DataFrame:
    return usage_rollup(t, ["day"], ("total_cost",)).select("day", F.col("total_cost").alias("cost"))


_over("kpi_periods_weekly_all", lambda t: ts.weekly_change(_all_time_series(t)), order_tables)
_over("kpi_periods_monthly_all", lambda t: ts.monthly_change(_all_time_series(t)), order_tables)
_over("kpi_trend", lambda t: ts.kpi_trend(t, as_of=AS_OF))
_over("kpi_trend_long", lambda t: ts.kpi_trend(t, 365, AS_OF_LONG), order_tables)
_over("kpi_change_points", lambda t: ts.kpi_change_points(t, as_of=AS_OF))
_over("kpi_change_points_long", lambda t: ts.kpi_change_points(t, 365, AS_OF_LONG), order_tables)
_over("kpi_cohort", lambda t: ts.kpi_cohort(t, as_of=AS_OF))
_over("kpi_cohort_long", lambda t: ts.kpi_cohort(t, 730, as_of=AS_OF_LONG), order_tables)
_over("kpi_cohort_all", lambda t: ts.cohort_of(ts.user_weeks(t)), order_tables)
_over(
    "kpi_cohort_calendar",
    lambda t: ts.cohort_of(ts.user_weeks(t), calendar=True),
    order_tables,
)

# -- dashboard ---------------------------------------------------------------------

_over("dash_cost", lambda t: dash.dash_cost(t, FIRST, LAST))
_over("dash_tokens", lambda t: dash.dash_tokens(t, FIRST, LAST))
_over("dash_cost_by_project", lambda t: dash.dash_cost_by(t, "project", FIRST, LAST))
_over("dash_cost_by_model", lambda t: dash.dash_cost_by(t, "model", FIRST, LAST))
_over("dash_cache_hit", lambda t: dash.dash_model_metric(t, "cache_hit_rate", FIRST, LAST))
_over(
    "dash_cache_hit_weekly",
    lambda t: dash.dash_model_metric(t, "cache_hit_rate", FIRST, LAST, "week").withColumn(
        "value", F.round("value", 9)
    ),
)
_over("dash_cost_per_1k", lambda t: dash.dash_model_metric(t, "cost_per_1k_tokens", FIRST, LAST))
_over("dash_top_users", lambda t: dash.dash_top_users(t, FIRST, LAST))
_over("dash_efficiency", dash.dash_efficiency)
_over("dash_proposals", lambda t: dash.dash_proposals(t, FIRST, LAST))
_over("dash_policies", dash.dash_policies)
_over("dash_divergence", dash.dash_divergence)
_over("dash_coverage", dash.dash_coverage)
_over("pivot_daily_top6", lambda t: dash.pivot_daily(t, as_of=AS_OF))
_over("pivot_model_top5", lambda t: dash.pivot_model(t, as_of=AS_OF))
_over("hour_of_day", lambda t: dash.hour_of_day(t, project="Docs", as_of=AS_OF))
_over("burn_severity", lambda t: dash.burn_severity(t, AS_OF))
