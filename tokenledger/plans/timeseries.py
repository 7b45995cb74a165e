"""Time-series questions over the daily cost series.

The series is aggregated to one row per day first. Its length is bounded by the
checked number of days, which is what makes an unpartitioned window over it
safe. Windows count rows, that is days with data: gaps are neither filled nor
skipped by date.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import (
    check_range,
    date_before,
    divide,
    iso_week,
    iso_week_label,
    month_label,
    month_start,
    ratio,
    usd,
    utc,
)
from tokenledger.plans.kpis import kpi_budget
from tokenledger.plans.rollup import usage_rollup
from tokenledger.tables import Tables

def _by_day():
    return Window.orderBy("day")


def _series(tables: Tables, days: int, as_of: datetime | None) -> DataFrame:
    """(day, cost) with decimal cost; a day without any cost counts as zero."""
    usage = usage_rollup(tables, ["day"], ("total_cost",), date_before(utc(as_of), days))
    return usage.select("day", F.coalesce("total_cost", F.lit(0)).alias("cost"))


def _mean(column: str, window) -> Column:
    return divide(F.sum(column).over(window), F.count(column).over(window))


def kpi_org_daily(tables: Tables, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    """Cost per day."""
    check_range("days", days, 1, 730)
    return (
        _series(tables, days, as_of)
        .select("day", usd(F.col("cost")).alias("total_cost"))
        .orderBy("day")
    )


def _baseline(series: DataFrame) -> DataFrame:
    trailing = _by_day().rowsBetween(-14, -1)
    same_weekday = Window.partitionBy("weekday").orderBy("day").rowsBetween(-4, -1)
    cost = usd(F.col("cost"))
    deviation = F.stddev_samp(cost).over(trailing)
    z_score = F.when(
        (F.count("cost").over(trailing) >= 2) & (deviation > 0),
        (cost - F.col("mean_14d")) / deviation,
    )
    return (
        series.withColumn("weekday", F.weekday("day"))
        .withColumn("mean_14d", _mean("cost", trailing))
        .withColumn("z", z_score)
        .withColumn("mean_dow", _mean("cost", same_weekday))
        .withColumn("mean_dow", F.nullif(F.col("mean_dow"), F.lit(0.0)))
        .select(
            "day",
            F.round(cost, 4).alias("cost"),
            F.round("mean_14d", 4).alias("baseline_14d"),
            F.round("z", 3).alias("z_score"),
            F.round("mean_dow", 4).alias("dow_baseline"),
            ratio(cost, F.col("mean_dow"), 4).alias("dow_ratio"),
        )
    )


def kpi_baseline(tables: Tables, days: int = 60, as_of: datetime | None = None) -> DataFrame:
    """Each day's cost against its trailing-14 mean, z-score and weekday mean."""
    check_range("days", days, 14, 365)
    return _baseline(_series(tables, days, as_of)).orderBy("day")


def _judged(
    tables: Tables, days: int, threshold: float, lookback: int, as_of: datetime | None
) -> DataFrame:
    check_range("days", days, 7, 365)
    check_range("threshold", threshold, 1.0, 10.0)
    base = F.nullif(F.col("baseline_14d"), F.lit(0.0))
    change = divide(F.col("cost") - base, base)
    spike = (
        F.coalesce(change > threshold - 1, F.lit(False))
        | F.coalesce(F.col("z_score") > 2.5, F.lit(False))
        | F.coalesce(F.col("dow_ratio") > threshold, F.lit(False))
    )
    return _baseline(_series(tables, days + lookback, as_of)).select(
        "day",
        "cost",
        F.coalesce("dow_baseline", "baseline_14d").alias("baseline"),
        F.round(change, 4).alias("pct_change"),
        "z_score",
        "dow_ratio",
        spike.alias("is_anomaly"),
    )


def kpi_anomalies(
    tables: Tables,
    days: int = 30,
    threshold: float = 1.5,
    lookback: int = 14,
    as_of: datetime | None = None,
) -> DataFrame:
    """Days that spike against the trailing mean, the z-score or the weekday mean.

    The warm-up days of the lookback are judged like the others.
    """
    judged = _judged(tables, days, threshold, lookback, as_of)
    return judged.where("is_anomaly").drop("is_anomaly").orderBy("day")


def kpi_anomaly_latest(
    tables: Tables,
    days: int = 30,
    threshold: float = 1.5,
    lookback: int = 14,
    as_of: datetime | None = None,
) -> DataFrame:
    """The last day of the series, flagged or not."""
    judged = _judged(tables, days, threshold, lookback, as_of)
    return judged.orderBy(F.desc("day")).limit(1)


def anomalies_recent(
    tables: Tables,
    days: int = 30,
    threshold: float = 1.5,
    lookback: int = 14,
    as_of: datetime | None = None,
) -> DataFrame:
    """The ten latest anomalies, newest first."""
    flagged = _judged(tables, days, threshold, lookback, as_of).where("is_anomaly")
    return flagged.drop("is_anomaly").orderBy(F.desc("day")).limit(10)


def _month_series(tables: Tables, as_of: datetime) -> DataFrame:
    usage = usage_rollup(tables, ["day"], ("total_cost",), month_start(as_of).date())
    return usage.select("day", F.coalesce("total_cost", F.lit(0)).alias("cost"))


def kpi_burndown(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Cost and running cost per day of the current month."""
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    return (
        _month_series(tables, utc(as_of))
        .select(
            "day",
            F.round(usd(F.col("cost")), 4).alias("cost"),
            F.round(usd(F.sum("cost").over(so_far)), 4).alias("cumulative"),
        )
        .orderBy("day")
    )


def kpi_burndown_summary(tables: Tables, as_of: datetime | None = None) -> DataFrame:
    """Month so far, its daily average over days with data, and the projected end."""
    as_of = utc(as_of)
    month_days = F.day(F.last_day(F.lit(as_of.date())))
    spent, elapsed = F.col("spent"), F.col("days_elapsed")
    average = F.coalesce(divide(spent, elapsed), F.lit(0.0))
    return (
        _month_series(tables, as_of)
        .agg(
            usd(F.coalesce(F.sum("cost"), F.lit(0))).alias("spent"),
            F.count(F.lit(1)).alias("days_elapsed"),
        )
        .withColumn("days_remaining", F.greatest(month_days - elapsed, F.lit(0)).cast("bigint"))
        .withColumn("average", average)
        .withColumn("projected", spent + F.col("average") * F.col("days_remaining"))
        .withColumn("budget", kpi_budget(tables).scalar())
        .select(
            "budget",
            F.round(spent, 4).alias("cumulative"),
            F.round("average", 4).alias("avg_daily"),
            "days_elapsed",
            "days_remaining",
            F.round("projected", 4).alias("projected_end"),
            F.when(F.col("budget") != 0, F.col("projected") > F.col("budget")).alias("over_budget"),
        )
    )


def _period_change(totals: DataFrame, key: Column, label: Column, change: str) -> DataFrame:
    """Period totals with the fractional change against the previous present period."""
    before = F.nullif(F.lag("cost").over(Window.orderBy("key")), F.lit(0))
    return (
        totals.groupBy(key.alias("key"))
        .agg(F.sum("cost").alias("cost"))
        .select(
            label.alias("period"),
            F.round(usd(F.col("cost")), 4).alias("total_cost"),
            ratio(F.col("cost") - before, before, 4).alias(change),
        )
        .orderBy("period")
    )


def kpi_periods_weekly(tables: Tables, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Cost per ISO week and the change against the week before."""
    check_range("days", days, 14, 730)
    return weekly_change(_series(tables, days, as_of))


def weekly_change(series: DataFrame) -> DataFrame:
    return _period_change(
        series, iso_week(F.col("day")), iso_week_label(F.col("key")), "wow_pct"
    )


def kpi_periods_monthly(tables: Tables, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Cost per calendar month and the change against the month before."""
    check_range("days", days, 14, 730)
    return monthly_change(_series(tables, days, as_of))


def monthly_change(series: DataFrame) -> DataFrame:
    return _period_change(series, month_label(F.col("day")), F.col("key"), "mom_pct")


def _slope() -> Column:
    """Least-squares slope of cost on row position over the last seven rows.

    The sums stay decimal; only the final quotient is a double.
    """
    week = _by_day().rowsBetween(-6, 0)
    n = F.count(F.lit(1)).over(week)
    first = F.row_number().over(_by_day()) - n
    # Positions inside the window are 1..n, so their sums have a closed form.
    sum_x = n * (n + 1) / 2
    sum_xx = n * (n + 1) * (2 * n + 1) / 6
    sum_y = F.sum("cost").over(week)
    sum_py = F.sum(F.col("_py")).over(week)
    sum_xy = sum_py - first * sum_y
    numerator = n * sum_xy - sum_x.cast("decimal(9,0)") * sum_y
    return F.when(n >= 2, divide(numerator, n * sum_xx - sum_x * sum_x))


def _trend(series: DataFrame) -> DataFrame:
    position = F.row_number().over(_by_day()).cast("decimal(9,0)")
    slope = F.col("slope")
    return (
        series.withColumn("_py", position * F.col("cost"))
        .withColumn("slope", F.round(_slope(), 4))
        .select(
            "day",
            F.round(usd(F.col("cost")), 4).alias("cost"),
            "slope",
            F.when(slope > 0.01, "up").when(slope < -0.01, "down").otherwise("flat").alias("direction"),
        )
    )


def kpi_trend(tables: Tables, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Rolling seven-row slope of daily cost and its direction."""
    check_range("days", days, 14, 365)
    return _trend(_series(tables, days, as_of)).orderBy("day")


def kpi_change_points(tables: Tables, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Days on which the slope turns from clearly up to clearly down or back."""
    check_range("days", days, 14, 365)
    turned = F.lag("direction").over(_by_day())
    return (
        _trend(_series(tables, days, as_of))
        .withColumn("before", turned)
        .where(
            F.col("before").isin("up", "down")
            & F.col("direction").isin("up", "down")
            & (F.col("before") != F.col("direction"))
        )
        .select("day", F.col("before").alias("from"), F.col("direction").alias("to"))
        .orderBy("day")
    )


def kpi_cohort(
    tables: Tables, days: int = 90, calendar: bool = False, as_of: datetime | None = None
) -> DataFrame:
    """Cost and users by first active week in the window and weeks since.

    ``week_offset`` counts 52 weeks to a year, so it is one too small across a
    year of 53. ``calendar`` adds the true distance in weeks and splits on it.

    Users are reduced to one row per week before anything else, which turns the
    distinct user count into a plain count and bounds each user's window.
    """
    check_range("days", days, 14, 730)
    return cohort_of(user_weeks(tables, date_before(utc(as_of), days)), calendar)


def user_weeks(tables: Tables, since: date | None = None) -> DataFrame:
    """Cost per user and week, the week given by its Monday."""
    monday = F.date_trunc("week", "day").cast("date")
    return usage_rollup(
        tables, ["user_id", "monday"], ("total_cost",), since, derived={"monday": monday}
    )


def cohort_of(weeks: DataFrame, calendar: bool = False) -> DataFrame:
    week = F.col("week")
    per_user = Window.partitionBy("user_id")
    offsets = (
        weeks.withColumn("week", iso_week(F.col("monday")))
        .withColumn("number", week.getField("year") * 52 + week.getField("week"))
        .withColumns(
            {
                "first": F.min("week").over(per_user),
                "week_offset": F.col("number") - F.min("number").over(per_user),
                "week_offset_calendar": (
                    F.datediff("monday", F.min("monday").over(per_user)) / 7
                ).cast("int"),
            }
        )
    )
    keys = ["week_offset", "week_offset_calendar"] if calendar else ["week_offset"]
    # Week 53 and the week after share a number: merge them per user before counting users.
    per_offset = offsets.groupBy("user_id", "first", *keys).agg(F.sum("total_cost").alias("cost"))
    return (
        per_offset.groupBy(iso_week_label(F.col("first")).alias("cohort"), *keys)
        .agg(
            F.round(usd(F.sum("cost")), 4).alias("cost"),
            F.count(F.lit(1)).alias("users"),
        )
        .orderBy("cohort", *keys)
    )
