"""Dashboard panels: marts over a day range, pivots and small presentational rules."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import date_before, midnight, ratio, usd, utc
from tokenledger.plans.kpis import (
    DIMENSIONS,
    kpi_efficiency,
    kpi_governance,
    kpi_hourly,
    kpi_policies,
)
from tokenledger.plans.marts import mrt_governance_daily, mrt_model_daily, mrt_policy_coverage
from tokenledger.plans.rollup import usage_rollup
from tokenledger.tables import Tables


def _in_range(df: DataFrame, first: date, last: date) -> DataFrame:
    return df.where(F.col("day").between(F.lit(first), F.lit(last)))


def _time(bucket: str) -> Column:
    """The panel's time bucket: day, week, month, quarter or year."""
    day = F.col("day")
    return (day if bucket == "day" else F.date_trunc(bucket, day).cast("date")).alias("time")


def _usage(tables: Tables, by: list[str], measures: tuple[str, ...], first: date, last: date):
    # The upper bound is a filter on the grouping column and moves below the aggregate.
    return _in_range(usage_rollup(tables, ["day", *by], measures, first), first, last)


def dash_cost(tables: Tables, first: date, last: date, bucket: str = "day") -> DataFrame:
    """Cost over time."""
    usage = _usage(tables, [], ("total_cost",), first, last)
    return (
        usage.groupBy(_time(bucket)).agg(usd(F.sum("total_cost")).alias("cost")).orderBy("time")
    )


def dash_tokens(tables: Tables, first: date, last: date, bucket: str = "day") -> DataFrame:
    """Tokens in, out and in total over time."""
    columns = ("input_tokens", "output_tokens", "total_tokens")
    usage = _usage(tables, [], columns, first, last)
    return (
        usage.groupBy(_time(bucket))
        .agg(
            F.sum("input_tokens").alias("tokens_in"),
            F.sum("output_tokens").alias("tokens_out"),
            F.sum("total_tokens").alias("tokens_total"),
        )
        .orderBy("time")
    )


def dash_cost_by(
    tables: Tables, dimension: str, first: date, last: date, bucket: str = "day"
) -> DataFrame:
    """Cost over time, one series per project, team, user or model."""
    column = DIMENSIONS[dimension]
    usage = _usage(tables, [column], ("total_cost",), first, last)
    return (
        usage.groupBy(_time(bucket), F.col(column).alias("metric"))
        .agg(usd(F.sum("total_cost")).alias("value"))
        .orderBy("time", "metric")
    )


def dash_model_metric(
    tables: Tables, metric: str, first: date, last: date, bucket: str = "day"
) -> DataFrame:
    """Mean of a daily efficiency ratio per model; days without the ratio do not count."""
    series = _in_range(mrt_model_daily(tables, midnight(first)), first, last)
    return (
        series.groupBy(_time(bucket), F.col("model").alias("metric"))
        .agg(F.avg(metric).alias("value"))
        .orderBy("time", "metric")
    )


def dash_top_users(tables: Tables, first: date, last: date) -> DataFrame:
    """The ten costliest users of a day range."""
    usage = _usage(tables, ["user_id"], ("total_cost", "total_tokens"), first, last)
    return (
        usage.groupBy("user_id")
        .agg(F.sum("total_cost").alias("cost"), F.sum("total_tokens").alias("tokens"))
        .orderBy(F.desc("cost"), F.asc("user_id"))
        .limit(10)
        .withColumn("cost", usd(F.col("cost")))
    )


def dash_efficiency(tables: Tables) -> DataFrame:
    """Model efficiency table."""
    return kpi_efficiency(tables).select(
        "model",
        "cache_hit_rate",
        "reasoning_share",
        "output_input_ratio",
        "cost_per_1k_tokens",
        "total_cost",
    )


def dash_proposals(tables: Tables, first: date, last: date) -> DataFrame:
    """Proposals and ratifications over time."""
    return (
        _in_range(mrt_governance_daily(tables), first, last)
        .select(
            F.col("day").alias("time"),
            F.col("proposals_total").alias("total"),
            F.col("proposals_ratified").alias("ratified"),
        )
        .orderBy("time")
    )


def dash_policies(tables: Tables) -> DataFrame:
    """Policy table."""
    return kpi_policies(tables).select(
        "rule_key", "kind", "confidence", "operator", "evidence_traces", "promoted_at"
    )


def dash_divergence(tables: Tables) -> DataFrame:
    """Divergence table with the divergent share."""
    return (
        tables["fact_governance_divergence"]
        .select(
            "model",
            "task_key",
            "divergent_traces",
            "total_traces",
            ratio(F.col("divergent_traces"), F.col("total_traces"), 4).alias("divergence_ratio"),
        )
        .orderBy("model", "task_key")
    )


def dash_coverage(tables: Tables) -> DataFrame:
    """Policy coverage table."""
    return mrt_policy_coverage(tables)


# -- pivots ------------------------------------------------------------------------


def _pivot_top(rows: DataFrame, value: str, ranks: int) -> DataFrame:
    """Days by the ``ranks`` labels of largest total: a label and value column per rank.

    Every day of the rows is present. Totals, names and values all start from
    the same aggregate, whose shuffle is reused. Ranking happens after the top-k limit, so
    the window holds at most ``ranks`` rows and the joined side is that small
    whatever the data; both facts come from the limit, which makes the
    broadcast safe. Columns are named by rank, so no job runs to find labels.
    """
    order = (F.desc("total"), F.asc("label"))
    # Both branches use the value and the cost, so that pruning leaves them the same
    # aggregate to share; the extra sort keys decide nothing.
    totals = rows.groupBy("label").agg(
        F.sum(F.coalesce("total_cost", F.lit(0))).alias("total"), F.max(value).alias("largest")
    )
    top = totals.orderBy(*order, "largest").limit(ranks)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    names = ranked.agg(
        F.struct(
            *(F.max(F.when(F.col("rank") == i, F.col("label"))).alias(f"l{i}") for i in range(1, ranks + 1))
        ).alias("names")
    )
    joined = rows.join(F.broadcast(ranked.select("label", "rank")), "label", "left")
    values = joined.groupBy("day").agg(
        F.sum("total_cost").alias("day_total"),
        *(
            F.max(F.when(F.col("rank") == i, F.col(value))).alias(f"v{i}")
            for i in range(1, ranks + 1)
        ),
    )
    pairs = (
        column
        for i in range(1, ranks + 1)
        for column in (
            F.col(f"names.l{i}").alias(f"label_{i}"),
            F.col(f"v{i}").cast("double").alias(f"value_{i}"),
        )
    )
    return (
        values.withColumn("names", names.scalar())
        .select("day", *pairs, "day_total")
        .orderBy("day", "day_total")
        .drop("day_total")
    )


def pivot_daily(
    tables: Tables, dimension: str = "user", days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Daily cost of the six costliest labels, one column pair per label."""
    since = date_before(utc(as_of), days)
    column = DIMENSIONS.get(dimension, "project_name")

    rows = usage_rollup(tables, ["day", column], ("total_cost",), since).withColumnRenamed(
        column, "label"
    )
    return _pivot_top(rows, "total_cost", 6)


def pivot_model(
    tables: Tables, metric: str = "cache_hit_rate", days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """A daily efficiency metric of the five costliest models."""
    since = midnight(date_before(utc(as_of), days))
    rows = mrt_model_daily(tables, since).withColumnRenamed("model", "label")
    return _pivot_top(rows, metric, 5)


def hour_of_day(
    tables: Tables, days: int = 7, project: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Cost by hour of the day; all 24 hours are present."""
    by_hour = (
        kpi_hourly(tables, days, project, as_of)
        .groupBy(F.hour("hour").alias("h"))
        .agg(F.sum("total_cost").alias("cost"))
    )
    hours = tables.spark.range(24).select(F.col("id").cast("int").alias("h"))
    return (
        hours.join(by_hour, "h", "left")
        .orderBy("h")
        .select(
            F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")).alias("hour"),
            F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"),
        )
    )


def burn_severity(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Budget burn capped at 100 per cent and its band: over 90 crit, over 75 warn."""
    percent = F.least(F.coalesce("burn_rate", F.lit(0.0)) * 100, F.lit(100.0))
    return kpi_governance(tables, as_of).select(
        "burn_rate",
        percent.alias("burn_pct"),
        F.when(percent > 90, "crit").when(percent > 75, "warn").otherwise("").alias("severity"),
    )
