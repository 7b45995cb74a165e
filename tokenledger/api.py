"""One object per set of tables and point in time, one method per question."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import edge, utc
from tokenledger.plans import kpis
from tokenledger.plans import timeseries as ts
from tokenledger.tables import Tables


class Ledger:
    """Questions about spend, efficiency and governance.

    Every answer is a lazy DataFrame, or a dict of them where an answer has
    several parts. Nothing runs before an action.
    """

    def __init__(self, tables: Tables, as_of: datetime | None = None):
        self.tables = tables
        self.as_of = utc(as_of)

    def overview(self) -> DataFrame:
        return kpis.kpi_overview(self.tables, self.as_of)

    def daily(self, dimension: str = "project", days: int = 30) -> DataFrame:
        return kpis.kpi_daily(self.tables, dimension, days, self.as_of)

    def top(
        self, dimension: str = "user", metric: str = "cost", days: int = 30, limit: int = 10
    ) -> DataFrame:
        return kpis.kpi_top(self.tables, dimension, metric, days, limit, self.as_of)

    def efficiency(self) -> DataFrame:
        return kpis.kpi_efficiency(self.tables)

    def governance(self) -> DataFrame:
        return kpis.kpi_governance(self.tables, self.as_of)

    def behaviour(self) -> dict[str, DataFrame]:
        return kpis.behaviour(self.tables)

    def targets(self) -> DataFrame:
        return kpis.kpi_targets(self.tables, self.as_of)

    def sessions(self, days: int = 30, limit: int = 20) -> dict[str, DataFrame]:
        return {
            "stats": kpis.kpi_session_stats(self.tables, days, self.as_of),
            "top": kpis.kpi_sessions_top(self.tables, days, limit, self.as_of),
        }

    def anomalies(
        self, days: int = 30, threshold: float = 1.5, lookback: int = 14
    ) -> dict[str, DataFrame]:
        given = (self.tables, days, threshold, lookback, self.as_of)
        return {
            "anomalies": ts.kpi_anomalies(*given),
            "latest": ts.kpi_anomaly_latest(*given).drop("is_anomaly"),
        }

    def quality(self, score_name: str | None = None, threshold: float = 0.5) -> DataFrame:
        return kpis.kpi_quality(self.tables, score_name, threshold)

    def model_daily(self, days: int = 30, model: str | None = None) -> DataFrame:
        return kpis.kpi_model_daily(self.tables, days, model, self.as_of)

    def hourly(self, days: int = 7, project: str | None = None) -> DataFrame:
        return kpis.kpi_hourly(self.tables, days, project, self.as_of)

    def burndown(self) -> dict[str, DataFrame]:
        return {
            "summary": ts.kpi_burndown_summary(self.tables, self.as_of),
            "days": ts.kpi_burndown(self.tables, self.as_of),
        }

    def baseline(self, days: int = 60) -> DataFrame:
        return ts.kpi_baseline(self.tables, days, self.as_of)

    def periods(self, days: int = 90) -> dict[str, DataFrame]:
        return {
            "weekly": ts.kpi_periods_weekly(self.tables, days, self.as_of),
            "monthly": ts.kpi_periods_monthly(self.tables, days, self.as_of),
        }

    def trend(self, days: int = 90) -> dict[str, DataFrame]:
        return {
            "series": ts.kpi_trend(self.tables, days, self.as_of),
            "change_points": ts.kpi_change_points(self.tables, days, self.as_of),
        }

    def cohort(self, days: int = 90) -> DataFrame:
        return ts.kpi_cohort(self.tables, days, as_of=self.as_of)


def json_lines(answer: DataFrame) -> DataFrame:
    """An answer as one JSON object per row: plain numbers, ISO dates, NULLs kept."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return edge(answer).select(row.alias("json"))
