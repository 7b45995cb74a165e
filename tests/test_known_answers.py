"""Totals known from an independent run at scale 0.01, over the events as they are and scores of a part of them."""

import pytest
from pyspark.sql import functions as F

from tokenledger.plans import kpis, marts
from tokenledger.plans import timeseries as ts
from tokenledger.workload.projections import AS_OF, event_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    own = event_tables(spark, SF, spread=False)
    scored = "substring(score_id, 4) % 4 = 1 AND trace_id NOT LIKE 'other-%'"
    return own.with_frames(fact_score=own["fact_score"].where(scored))


def test_mart_sizes(tables):
    assert marts.mrt_daily_usage(tables).count() == 7536
    assert marts.mrt_session(tables).count() == 5599
    assert marts.mrt_model_daily(tables).count() == 150
    assert marts.mrt_hourly_usage(tables).count() == 2788


def test_daily_traces_over_count(tables):
    row = marts.mrt_org_daily(tables, exact_traces=True).agg(
        F.sum("traces").alias("summed"), F.sum("traces_distinct").alias("true")
    ).first()
    assert (row["summed"], row["true"]) == (9322, 7054)


def test_overview(tables):
    row = kpis.kpi_overview(tables, AS_OF).first()
    assert (row["cost_mtd"], row["active_users_mtd"], row["sessions_mtd"]) == (496306.57, 135, 3722)
    assert kpis.kpi_overview_wow(tables, AS_OF).first()["last7"] == 154786.01


def test_governance(tables):
    assert kpis.kpi_unattributed(tables, AS_OF).first()["cost"] == 245577.31
    assert kpis.kpi_concentration(tables, as_of=AS_OF).first()["top_cost"] == 68847.80


def test_quality(tables):
    row = kpis.kpi_quality(tables).first()
    assert (row["scored_traces"], row["passing_traces"]) == (1515, 813)
    assert (row["scored_cost"], row["passing_cost"]) == (125500.85, 66503.99)
    assert kpis.kpi_trace_outcomes(tables).where("best_score IS NULL").count() == 13


def test_anomalies_by_threshold(tables):
    assert ts.kpi_anomalies(tables, as_of=AS_OF).count() == 0
    assert ts.kpi_anomalies(tables, threshold=1.05, as_of=AS_OF).count() == 8


def test_burndown(tables):
    row = ts.kpi_burndown_summary(tables, AS_OF).first()
    assert (row["days_elapsed"], row["avg_daily"], row["projected_end"]) == (30, 16543.5523, 512850.1223)
    assert row["over_budget"] is True
