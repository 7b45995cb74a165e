"""Edge rules of KPIs and time series on hand-made rows."""

from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from tokenledger.plans import dashboards as dash
from tokenledger.plans import kpis, marts
from tokenledger.plans import timeseries as ts
from tokenledger.schemas import BUDGET, DIM_USER, FACT_OBSERVATION, FACT_SCORE, TARGETS
from tokenledger.tables import Tables

AS_OF = datetime(2024, 3, 20, 12, tzinfo=timezone.utc)


def facts(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FACT_OBSERVATION.schema.fields
        )
    )


def daily(spark, costs):
    rows = [(f"o{i}", d, c) for i, (d, c) in enumerate(costs)]
    return Tables(spark, {"fact_observation": facts(spark, rows, "observation_id string, start_time string, total_cost double")})


@pytest.fixture(scope="module")
def empty(spark):
    return Tables(spark, {})


def test_empty_tables(empty):
    row = kpis.kpi_overview(empty, AS_OF).first()
    assert (row["cost_mtd"], row["tokens_mtd"], row["observations_mtd"]) == (None, None, 0)
    assert (row["cost_per_1k_tokens"], row["cache_hit_rate"], row["wow_cost_pct"]) == (0.0, None, None)
    row = kpis.kpi_governance(empty, AS_OF).first()
    assert (row["mtd_cost"], row["unattributed_cost"], row["burn_rate"]) == (0.0, 0.0, None)
    assert (row["unattributed_pct"], row["concentration_top5_pct"], row["active_users"]) == (None, None, 0)
    row = kpis.kpi_quality(empty).first()
    assert (row["scored_traces"], row["pass_rate"], row["cost_per_success"]) == (0, None, None)
    row = ts.kpi_burndown_summary(empty, AS_OF).first()
    assert (row["days_elapsed"], row["cumulative"], row["projected_end"], row["over_budget"]) == (0, 0.0, 0.0, None)
    assert kpis.kpi_session_stats(empty, as_of=AS_OF).first()["sessions"] == 0
    assert marts.mrt_policy_coverage(empty).first()["coverage_ratio"] is None
    for question in (ts.kpi_baseline, ts.kpi_anomalies, ts.kpi_anomaly_latest, ts.kpi_trend, ts.kpi_cohort,
                     ts.kpi_periods_weekly, kpis.kpi_targets, kpis.kpi_top):
        assert question(empty, as_of=AS_OF).count() == 0
    assert dash.hour_of_day(empty, as_of=AS_OF).count() == 24
    assert dash.pivot_daily(empty, as_of=AS_OF).count() == 0


def test_labels_and_teams(spark):
    rows = [
        ("1", "2024-03-01", None, None, None, None),
        ("2", "2024-03-01", "p", None, "u", "m"),
        ("3", "2024-03-01", "p", "Name", "blank-team", "m"),
        ("4", None, "p", "Name", "u", "m"),
    ]
    tables = Tables(
        spark,
        {
            "fact_observation": facts(
                spark, rows, "observation_id string, start_time string, project_id string, project_name string, "
                "user_id string, model string"
            ),
            "dim_user": spark.createDataFrame(
                [("u", None, "Team", None), ("blank-team", None, "", None), ("(unattributed)", None, "X", None)],
                DIM_USER.schema,
            ),
        },
    )
    got = {(r["day"] and str(r["day"]), r["project_name"], r["user_id"], r["team"], r["model"]) for r in marts.mrt_daily_usage(tables).collect()}
    assert got == {
        ("2024-03-01", "(unknown)", "(unattributed)", "Unassigned", "(unknown)"),
        ("2024-03-01", "p", "u", "Team", "m"),
        ("2024-03-01", "Name", "blank-team", "Unassigned", "m"),
        (None, "Name", "u", "Team", "m"),
    }
    assert marts.mrt_model_efficiency(tables).where("model = 'm'").count() == 1


def test_session_key_falls_back_to_trace(spark):
    rows = [("1", "s", "t1", "u"), ("2", "s", "t2", "u"), ("3", None, "t3", "u"), ("4", "s", "t1", "v")]
    tables = Tables(spark, {"fact_observation": facts(spark, rows, "observation_id string, session_id string, trace_id string, user_id string")})
    got = {(r["session_id"], r["user_id"]): (r["turns"], r["observations"]) for r in marts.mrt_session(tables).collect()}
    assert got == {("s", "u"): (2, 2), ("t3", "u"): (1, 1), ("s", "v"): (1, 1)}


def test_windows_have_no_upper_bound(spark):
    tables = daily(spark, [("2024-03-25", 5.0), ("2024-03-20", 1.0), ("2024-02-18", 2.0), ("2024-02-19", 4.0)])
    assert kpis.kpi_total_cost(tables, 30, AS_OF).first()["total_cost"] == 10.0
    assert kpis.kpi_overview_wow(tables, AS_OF).first()["last7"] == 6.0


def test_hourly_leaves_out_the_partial_hour(spark):
    as_of = AS_OF.replace(minute=30)
    tables = daily(spark, [("2024-03-13 12:45:00", 1.0), ("2024-03-13 13:00:00", 2.0)])
    assert [r["total_cost"] for r in kpis.kpi_hourly(tables, 7, as_of=as_of).collect()] == [2.0]


def half_up(value, digits):
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def loop_baseline(series):
    """The window rules written as a plain loop over days with data."""
    out = []
    for i, (day, cost) in enumerate(series):
        window = [c for _, c in series[max(0, i - 14):i]]
        same = [c for d, c in series[:i] if d.weekday() == day.weekday()][-4:]
        base = mean(window) if window else None
        z = None
        if len(window) >= 2 and stdev(window) > 0:
            z = half_up((cost - base) / stdev(window), 3)
        dow = mean(same) if same else None
        out.append((
            None if base is None else half_up(base, 4), z,
            half_up(dow, 4) if dow else None, half_up(cost / dow, 4) if dow else None,
        ))
    return out


def test_baseline_counts_rows_not_dates(spark):
    start = datetime(2024, 1, 25)
    series = [(start + timedelta(days=d), float((d * 37) % 23 + 1)) for d in range(55) if d % 3 != 1]
    tables = daily(spark, [(str(d), c) for d, c in series])
    rows = ts.kpi_baseline(tables, 60, AS_OF).collect()
    got = [(r["baseline_14d"], r["z_score"], r["dow_baseline"], r["dow_ratio"]) for r in rows]
    assert got == loop_baseline(series)


def test_baseline_of_few_and_equal_rows(spark):
    one = ts.kpi_baseline(daily(spark, [("2024-03-01", 1.0)]), as_of=AS_OF).first()
    assert (one["baseline_14d"], one["z_score"], one["dow_ratio"]) == (None, None, None)
    rows = ts.kpi_baseline(daily(spark, [(f"2024-03-0{i}", 2.0) for i in (1, 2, 3)]), as_of=AS_OF).collect()
    assert [r["z_score"] for r in rows] == [None, None, None]


def test_zero_weekday_baseline_falls_back(spark):
    costs = [("2024-03-01", 0.0), ("2024-03-02", 4.0), ("2024-03-08", 9.0)]
    row = ts.kpi_anomaly_latest(daily(spark, costs), as_of=AS_OF).first()
    assert (row["dow_ratio"], row["baseline"], row["pct_change"]) == (None, 2.0, 3.5)
    assert row["is_anomaly"] is True
    assert [str(r["day"]) for r in ts.anomalies_recent(daily(spark, costs), as_of=AS_OF).collect()] == ["2024-03-08"]


def test_trend_and_change_points(spark):
    costs = [("2024-03-01", 1.0), ("2024-03-02", 3.0), ("2024-03-05", 5.0), ("2024-03-06", 1.0), ("2024-03-07", 0.0)]
    tables = daily(spark, costs)
    rows = ts.kpi_trend(tables, as_of=AS_OF).collect()
    assert [r["slope"] for r in rows] == [None, 2.0, 2.0, 0.2, -0.4]
    assert [r["direction"] for r in rows] == ["flat", "up", "up", "up", "down"]
    turns = ts.kpi_change_points(tables, as_of=AS_OF).collect()
    assert [(str(r["day"]), r["from"], r["to"]) for r in turns] == [("2024-03-07", "up", "down")]


def test_periods(spark):
    tables = daily(spark, [("2023-12-31", 0.0), ("2024-01-01", 4.0), ("2024-02-01", 6.0)])
    weeks = ts.kpi_periods_weekly(tables, as_of=AS_OF).collect()
    assert [(r["period"], r["wow_pct"]) for r in weeks] == [("2023-W52", None), ("2024-W01", None), ("2024-W05", 0.5)]
    months = ts.kpi_periods_monthly(tables, as_of=AS_OF).collect()
    assert [(r["period"], r["total_cost"], r["mom_pct"]) for r in months] == [
        ("2023-12", 0.0, None), ("2024-01", 4.0, None), ("2024-02", 6.0, 0.5)
    ]


def test_cohort_across_a_year_of_53_weeks(spark):
    as_of = datetime(2021, 1, 20, tzinfo=timezone.utc)
    rows = [("1", "2020-12-30", "u", 1.0), ("2", "2021-01-05", "u", 2.0), ("3", "2021-01-12", "u", 4.0), ("4", "2021-01-05", None, 8.0)]
    tables = Tables(spark, {"fact_observation": facts(spark, rows, "observation_id string, start_time string, user_id string, total_cost double")})
    got = {(r["cohort"], r["week_offset"]): (r["cost"], r["users"]) for r in ts.kpi_cohort(tables, as_of=as_of).collect()}
    assert got == {("2020-W53", 0): (3.0, 1), ("2020-W53", 1): (4.0, 1), ("2021-W01", 0): (8.0, 1)}
    calendar = ts.kpi_cohort(tables, calendar=True, as_of=as_of).collect()
    assert [(r["week_offset"], r["week_offset_calendar"]) for r in calendar if r["cohort"] == "2020-W53"] == [(0, 0), (0, 1), (1, 2)]


def test_burndown_counts_days_with_data(spark):
    budget = spark.createDataFrame([("global", "*", "monthly", 30.0)], BUDGET.schema)
    tables = daily(spark, [("2024-02-29", 99.0), ("2024-03-01", 1.0), ("2024-03-10", 2.0)]).with_frames(budget=budget)
    row = ts.kpi_burndown_summary(tables, AS_OF).first()
    assert (row["days_elapsed"], row["days_remaining"], row["avg_daily"], row["projected_end"]) == (2, 29, 1.5, 46.5)
    assert row["over_budget"] is True
    assert [r["cumulative"] for r in ts.kpi_burndown(tables, AS_OF).collect()] == [1.0, 3.0]


def test_targets(spark):
    rows = [("1", "2024-03-02", 100, 30, 130, 40, 13, 2.6)]
    tables = Tables(
        spark,
        {
            "fact_observation": facts(
                spark, rows, "observation_id string, start_time string, input_tokens bigint, output_tokens bigint, "
                "total_tokens bigint, cached_input_tokens bigint, reasoning_tokens bigint, total_cost double"
            ),
            "targets": spark.createDataFrame(
                [("cache_hit_rate", "gte", 0.4, "a"), ("reasoning_share", "lte", 0.05, "b"),
                 ("output_input_ratio", "eq", 0.3, "c"), ("cost_per_1k_tokens", "lte", 20.0, "d"),
                 ("burn_rate", "lte", 0.8, "no budget"), ("other", "lte", 1.0, "unknown")],
                TARGETS.schema,
            ),
        },
    )
    got = {r["metric"]: (r["current"], r["pass"]) for r in kpis.kpi_targets(tables, AS_OF).collect()}
    assert got == {
        "cache_hit_rate": (0.4, True), "reasoning_share": (0.1, False),
        "output_input_ratio": (0.3, None), "cost_per_1k_tokens": (20.0, True),
    }


def test_quality_counts_unscored_values(spark):
    tables = Tables(
        spark,
        {
            "fact_observation": facts(spark, [("1", "a", 1.0), ("2", "a", 2.0), ("3", "b", 4.0), ("4", "c", 8.0)], "observation_id string, trace_id string, total_cost double"),
            "fact_score": spark.createDataFrame(
                [(str(i), t, None, None, None, n, v, None, None) for i, (t, n, v) in enumerate(
                    [("a", "x", 0.2), ("a", "y", 0.9), ("b", "x", None), ("gone", "x", 1.0)]
                )],
                FACT_SCORE.schema,
            ),
        },
    )
    row = kpis.kpi_quality(tables).first()
    assert (row["scored_traces"], row["passing_traces"], row["scored_cost"], row["cost_per_success"]) == (2, 1, 7.0, 3.0)
    row = kpis.kpi_quality(tables, "x", 0.5).first()
    assert (row["scored_traces"], row["passing_traces"], row["cost_per_success"], row["score_name"]) == (2, 0, None, "x")


def test_argument_checks(empty):
    bad = [
        lambda: kpis.kpi_daily(empty, days=0),
        lambda: kpis.kpi_top(empty, limit=101),
        lambda: kpis.kpi_hourly(empty, days=91),
        lambda: kpis.kpi_hourly(empty, project="a'b"),
        lambda: kpis.kpi_model_daily(empty, model="x;"),
        lambda: kpis.kpi_quality(empty, threshold=1.5),
        lambda: kpis.kpi_quality(empty, "a'b"),
        lambda: ts.kpi_baseline(empty, days=13),
        lambda: ts.kpi_anomalies(empty, threshold=0.5),
        lambda: ts.kpi_periods_weekly(empty, days=731),
        lambda: ts.kpi_cohort(empty, days=13),
    ]
    for question in bad:
        with pytest.raises(ValueError):
            question()


def test_unknown_dimension_and_metric(spark):
    tables = daily(spark, [("2024-03-19", 1.0)])
    assert kpis.kpi_daily(tables, "nonsense", as_of=AS_OF).first()["label"] == "(unknown)"
    assert kpis.kpi_top(tables, "nonsense", "nonsense", as_of=AS_OF).first()["label"] == "(unattributed)"


def test_hot_user_matches_a_plain_sum(spark):
    """One user has a third of all rows, a third has no user at all."""
    rows = spark.range(9000).select(
        F.col("id").cast("string").alias("observation_id"),
        F.lit("2024-03-10").alias("start_time"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), F.col("id") % 700)).alias("user_id"),
        F.concat(F.lit("t"), F.col("id") % 11).alias("trace_id"),
        (F.col("id") % 7).cast("double").alias("total_cost"),
    )
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FACT_OBSERVATION.schema.fields
    ]
    users = spark.createDataFrame([("hot", None, "Team", None)], DIM_USER.schema)
    tables = Tables(spark, {"fact_observation": rows.select(*columns), "dim_user": users})
    got = {r["label"]: r["total_cost"] for r in kpis.kpi_top(tables, "team", as_of=AS_OF).collect()}
    assert got["Team"] == sum(i % 7 for i in range(0, 9000, 3))
    assert got["Team"] + got["Unassigned"] == sum(i % 7 for i in range(9000))
    hot = marts.mrt_daily_usage(tables).where("user_id = 'hot'").first()
    assert (hot["observations"], hot["traces"]) == (3000, 11)


def test_marts_as_views(spark):
    tables = daily(spark, [("2024-03-19", 1.0)])
    assert len(marts.register_marts(tables)) == 8
    assert spark.sql("SELECT sum(total_cost) AS c FROM mrt_org_daily").first()["c"] == 1


@pytest.mark.parametrize("spent, band", [(95.0, "crit"), (80.0, "warn"), (10.0, ""), (500.0, "crit")])
def test_burn_bands(spark, spent, band):
    budget = spark.createDataFrame([("global", "*", "monthly", 100.0)], BUDGET.schema)
    row = dash.burn_severity(daily(spark, [("2024-03-10", spent)]).with_frames(budget=budget), AS_OF).first()
    assert row["severity"] == band and row["burn_pct"] <= 100.0
