"""The fixture has rows on both sides of every window, so a wrong bound would show."""

from datetime import timedelta

import pytest

from tests.test_oracle import QUERIES, SMALL
from tokenledger.plans import kpis
from tokenledger.plans import timeseries as ts
from tokenledger.workload.projections import AS_OF, event_tables


@pytest.fixture(scope="module")
def tables(spark):
    own = event_tables(spark, SMALL)
    return own.with_frames(fact_observation=own["fact_observation"].cache())


def rows(df):
    return sorted(map(str, df.collect()))


WINDOWED = {
    "kpi_daily": (lambda t, days: kpis.kpi_daily(t, "team", days=days, as_of=AS_OF), 30),
    "kpi_top": (lambda t, days: kpis.kpi_top(t, days=days, as_of=AS_OF), 30),
    "kpi_total_cost": (lambda t, days: kpis.kpi_total_cost(t, days=days, as_of=AS_OF), 30),
    "kpi_concentration": (lambda t, days: kpis.kpi_concentration(t, days=days, as_of=AS_OF), 30),
    "kpi_session_stats": (lambda t, days: kpis.kpi_session_stats(t, days=days, as_of=AS_OF), 30),
    "kpi_sessions_top": (lambda t, days: kpis.kpi_sessions_top(t, days=days, as_of=AS_OF), 30),
    "kpi_model_daily": (lambda t, days: kpis.kpi_model_daily(t, days=days, as_of=AS_OF), 30),
    "kpi_user_daily": (lambda t, days: kpis.kpi_user_daily(t, days=days, as_of=AS_OF), 45),
    "kpi_org_daily": (lambda t, days: ts.kpi_org_daily(t, days=days, as_of=AS_OF), 30),
    "kpi_baseline": (lambda t, days: ts.kpi_baseline(t, days, AS_OF), 60),
    "kpi_anomalies": (lambda t, days: ts.kpi_anomalies(t, days, as_of=AS_OF), 30),
    "kpi_cohort": (lambda t, days: ts.kpi_cohort(t, days, as_of=AS_OF), 60),
    "kpi_trend": (lambda t, days: ts.kpi_trend(t, days, as_of=AS_OF), 60),
}


@pytest.mark.parametrize("name", sorted(WINDOWED))
def test_twice_the_days_is_another_answer(tables, name):
    question, days = WINDOWED[name]
    assert rows(question(tables, days)) != rows(question(tables, 2 * days))


def test_month_to_date_is_not_everything(tables):
    later = kpis.kpi_month_cost(tables, AS_OF).first()
    earlier = kpis.kpi_month_cost(tables, AS_OF - timedelta(days=60)).first()
    assert 0 < later.mtd_cost < earlier.mtd_cost


def test_there_are_anomalies(spark):
    assert QUERIES["kpi_anomalies"](spark, SMALL).count() > 0
