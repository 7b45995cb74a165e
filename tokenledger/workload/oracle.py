"""DuckDB statements that answer the registered queries from the raw tables.

Each statement rebuilds the telemetry from the driver's tables and states the
question in plain SQL; none of it is shared with the Spark side.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-28 12:00:00'"
LONG_AS_OF = "DATE '2001-08-02'"

# -- base tables ---------------------------------------------------------------

CTE: dict[str, str] = {}

CTE["moved"] = """
SELECT event_id, ts - to_days(CAST(event_id % 5 AS INTEGER) * 25) AS ts, user_id, event_type, value, props FROM events"""

CTE["ev"] = """
SELECT event_id, ts, user_id, event_type, props, CAST(ts AS DATE) AS d,
       CASE CAST(ts AS DATE) WHEN DATE '2024-01-17' THEN value * 8 ELSE value END AS value,
       CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM moved"""

CTE["fact"] = """
SELECT 'ev-' || event_id AS observation_id,
       'tr-' || user_id || '-' || d || '-' || (event_id % 3) AS trace_id,
       CASE user_id % 4 WHEN 3 THEN NULL ELSE 'p' || (user_id % 4) END AS project_id,
       CASE user_id % 4 WHEN 0 THEN 'App' WHEN 2 THEN 'Docs' END AS project_name,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || user_id END AS user_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'se-' || user_id || '-' || d END AS session_id,
       CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 'model-a' WHEN 'view' THEN 'model-b'
            WHEN 'purchase' THEN 'model-c' WHEN 'error' THEN 'model-z' END AS model,
       ts AS start_time, d AS day,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(k * 100 AS DOUBLE) END AS latency_ms,
       CASE WHEN event_type = 'error' THEN 0 ELSE 200 + k * 40 END AS input_tokens,
       CASE WHEN event_type = 'error' THEN 0 ELSE 50 + (event_id % 30) * 10 END AS output_tokens,
       CASE WHEN event_type = 'error' THEN 0 ELSE 250 + k * 40 + (event_id % 30) * 10 END AS total_tokens,
       CASE WHEN event_type IN ('click', 'view') THEN k * 10 ELSE 0 END AS cached_input_tokens,
       CASE WHEN event_type = 'purchase' THEN (event_id % 7) * 10 ELSE 0 END AS reasoning_tokens,
       CAST(CAST(value AS DECIMAL(18,6)) * 0.25 AS DECIMAL(24,12)) AS input_cost,
       CAST(CAST(value AS DECIMAL(18,6)) * 0.75 AS DECIMAL(24,12)) AS output_cost,
       CAST(value AS DECIMAL(18,6)) AS total_cost
FROM ev"""

CTE["dim_user"] = """
SELECT DISTINCT CASE WHEN user_id % 8 = 5 THEN 'idle-' ELSE 'u' END || user_id AS user_id,
       CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Platform' WHEN 2 THEN 'Product'
            WHEN 3 THEN 'Support' WHEN 5 THEN 'Research' END AS team
FROM events"""


CTE["score"] = """
SELECT 'sc-' || event_id AS score_id,
       CASE WHEN user_id % 3 = 0 THEN 'other-tr-' ELSE 'tr-' END || user_id || '-' || d || '-' || (event_id % 3) AS trace_id,
       CASE WHEN event_id % 2 = 0 THEN 'correctness' ELSE 'helpfulness' END AS name,
       CASE WHEN k = 13 THEN NULL ELSE k / 100.0 END::DOUBLE AS value
FROM ev"""

CTE["gov"] = """
SELECT 'sn-' || event_id AS snapshot_id, 'g' || (user_id % 2) AS project_id, ts AS exported_at, d AS day,
       CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k * 1000 AS DOUBLE) END AS ttrp_ms,
       k % 5 AS precision14_numerator, 5 + k % 3 AS precision14_denominator,
       CAST(k % 5 AS DOUBLE) / (5 + k % 3) AS precision14_ratio,
       k % 20 + 10 AS proposals_total, k % 20 AS proposals_pending,
       CAST(6 AS BIGINT) AS proposals_ratified, CAST(3 AS BIGINT) AS proposals_rejected,
       CAST(1 AS BIGINT) AS proposals_decayed
FROM ev"""

CTE["policy"] = """
SELECT 'rule-' || p_partkey AS rule_key, 'g' || (p_partkey % 2) AS project_id, p_brand AS kind,
       CASE WHEN p_partkey % 6 = 5 THEN 'proposed' ELSE 'ratified' END AS status,
       CAST((p_size % 10) / 10.0 AS DOUBLE) AS confidence,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS promoted_at,
       'reviewer-' || (p_size % 3) AS operator, CAST(p_size * 3 AS BIGINT) AS evidence_traces
FROM part"""

CTE["divergence"] = """
SELECT 'g' || (s_suppkey % 2) AS project_id, 'model-' || s_nationkey AS model, s_name AS task_key,
       s_suppkey % 4 AS divergent_traces,
       CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey + 5 END AS total_traces
FROM supplier"""

CTE["target"] = """
SELECT * FROM (VALUES ('cache_hit_rate', 'gte', 0.30::DOUBLE, 'Cache hit rate'),
  ('output_input_ratio', 'eq', 0.30, 'Output:input ratio'),
  ('reasoning_share', 'lte', 0.25, 'Reasoning token share'),
  ('cost_per_1k_tokens', 'lte', 0.02, 'Blended cost per 1k tokens'),
  ('burn_rate', 'lte', 0.80, 'Monthly budget burn'),
  ('unheard_of', 'gte', 1.0, 'Not a known metric')) AS t(metric, op, threshold, label)"""

CTE["lines"] = """
SELECT CAST(l_shipdate AS DATE) AS day, o_orderpriority AS project, 'c' || o_custkey AS user_id,
       l_returnflag || l_linestatus AS model, 'or-' || l_orderkey AS trace_id, l_shipdate AS start_time,
       CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_quantity AS BIGINT) * 10 AS output_tokens,
       CAST(l_quantity AS BIGINT) * 110 AS total_tokens, CAST(l_linenumber * 10 AS BIGINT) AS cached_input_tokens,
       CAST(l_extendedprice AS DECIMAL(18,6)) * (1 - CAST(l_discount AS DECIMAL(18,6))) AS raw_cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# -- marts -----------------------------------------------------------------------

PROJECT = "coalesce(project_name, project_id, '(unknown)')"
TOKENS = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens")
SUM_TOKENS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)

CTE["e1"] = f"""
SELECT f.day, coalesce(f.project_id, '(unknown)') AS project_id,
       coalesce(f.project_name, f.project_id, '(unknown)') AS project_name,
       coalesce(f.user_id, '(unattributed)') AS user_id, coalesce(nullif(u.team, ''), 'Unassigned') AS team,
       coalesce(f.model, '(unknown)') AS model, count(*) AS observations,
       count(DISTINCT f.trace_id) AS traces, {SUM_TOKENS},
       sum(input_cost) AS input_cost, sum(output_cost) AS output_cost, sum(total_cost) AS total_cost
FROM fact f LEFT JOIN dim_user u ON u.user_id = f.user_id GROUP BY 1, 2, 3, 4, 5, 6"""

RATIOS = """
       round(cached_input_tokens::DOUBLE / nullif(input_tokens, 0), 4) AS cache_hit_rate,
       round(reasoning_tokens::DOUBLE / nullif(total_tokens, 0), 4) AS reasoning_share,
       round(output_tokens::DOUBLE / nullif(input_tokens, 0), 4) AS output_input_ratio,
       round((total_cost * 1000)::DOUBLE / nullif(total_tokens, 0), 6) AS cost_per_1k_tokens"""

CTE["e2"] = f"""
SELECT model, input_tokens, output_tokens, cached_input_tokens, reasoning_tokens,
       total_cost, {RATIOS}, round(avg_latency_ms, 1) AS avg_latency_ms
FROM (SELECT coalesce(model, '(unknown)') AS model, {SUM_TOKENS}, sum(total_cost) AS total_cost,
             avg(latency_ms) AS avg_latency_ms FROM fact GROUP BY 1)"""

CTE["e3"] = f"""
SELECT day, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(traces) AS BIGINT) AS traces,
       {SUM_TOKENS}, sum(total_cost) AS total_cost FROM e1 GROUP BY 1"""

CTE["e4"] = f"""
SELECT coalesce(session_id, trace_id) AS session_id, coalesce(user_id, '(unattributed)') AS user_id,
       {PROJECT} AS project_name, min(start_time) AS first_seen, max(start_time) AS last_seen,
       count(DISTINCT trace_id) AS turns, count(*) AS observations,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(total_cost) AS total_cost
FROM fact GROUP BY 1, 2, 3"""

CTE["e5"] = f"""
SELECT day, model, input_tokens, output_tokens, cached_input_tokens, reasoning_tokens, total_tokens,
       total_cost, avg_latency_ms, {RATIOS}
FROM (SELECT day, coalesce(model, '(unknown)') AS model, {SUM_TOKENS}, sum(total_cost) AS total_cost,
             avg(latency_ms) AS avg_latency_ms FROM fact GROUP BY 1, 2)"""

CTE["e6"] = f"""
SELECT date_trunc('hour', start_time) AS hour, {PROJECT} AS project_name, count(*) AS observations,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(total_cost) AS total_cost
FROM fact GROUP BY 1, 2"""

CTE["e7"] = """
SELECT day, last.* FROM (SELECT day, arg_max(gov, (exported_at, snapshot_id)) AS last FROM gov GROUP BY day)"""

CTE["e8"] = """
SELECT ratified_policies, evidence_traces, total_traces,
       round(evidence_traces::DOUBLE / nullif(total_traces, 0), 4) AS coverage_ratio
FROM (SELECT count(*) AS ratified_policies, CAST(coalesce(sum(evidence_traces), 0) AS BIGINT) AS evidence_traces FROM policy)
CROSS JOIN (SELECT count(DISTINCT trace_id) AS total_traces FROM fact)"""

# -- shared steps -------------------------------------------------------------------

CTE["mtd"] = """
SELECT CAST(sum(total_cost) AS DOUBLE) AS cost_mtd, CAST(sum(total_tokens) AS BIGINT) AS tokens_mtd,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens_mtd, CAST(sum(output_tokens) AS BIGINT) AS output_tokens_mtd,
       CAST(sum(cached_input_tokens) AS BIGINT) AS cached_tokens_mtd, count(*) AS observations_mtd,
       count(DISTINCT user_id) AS active_users_mtd, count(DISTINCT session_id) AS sessions_mtd,
       coalesce(round((sum(total_cost) * 1000)::DOUBLE / nullif(sum(total_tokens), 0)::DOUBLE, 6), 0) AS cost_per_1k_tokens,
       CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_mtd
FROM fact WHERE start_time >= TIMESTAMP '2024-01-01'"""

CTE["wow"] = f"""
SELECT CAST(coalesce(sum(total_cost) FILTER (WHERE start_time >= {AS_OF} - INTERVAL 7 DAY), 0) AS DOUBLE) AS last7,
       CAST(coalesce(sum(total_cost) FILTER (WHERE start_time >= {AS_OF} - INTERVAL 14 DAY
                                             AND start_time < {AS_OF} - INTERVAL 7 DAY), 0) AS DOUBLE) AS prev7
FROM fact"""

CTE["g"] = f"""
SELECT (SELECT CAST(sum(total_cost) AS DOUBLE) FROM fact WHERE start_time >= TIMESTAMP '2024-01-01') AS mtd_cost,
       500000.0::DOUBLE AS monthly_budget,
       (SELECT count(DISTINCT user_id) FROM fact WHERE start_time >= TIMESTAMP '2024-01-01') AS active_users,
       (SELECT CAST(coalesce(sum(total_cost), 0) AS DOUBLE) FROM e1
        WHERE team = 'Unassigned' AND day >= DATE '2024-01-01') AS unattributed,
       (SELECT CAST(sum(total_cost) AS DOUBLE) FROM e1 WHERE day >= DATE '2023-12-29') AS total_30d,
       (SELECT CAST(sum(c) AS DOUBLE) FROM (SELECT sum(total_cost) AS c FROM e1 WHERE day >= DATE '2023-12-29'
        GROUP BY user_id ORDER BY c DESC, user_id LIMIT 5)) AS top5"""


def _outcomes(scores: str, name: str | None = None) -> str:
    clause = f"WHERE name = '{name}'" if name else ""
    return f"""
SELECT trace_id, cost, best_score
FROM (SELECT trace_id, coalesce(sum(total_cost), 0) AS cost FROM fact GROUP BY 1)
JOIN (SELECT trace_id, max(value) AS best_score FROM {scores} {clause} GROUP BY 1) USING (trace_id)"""


CTE["outcome"] = _outcomes("score")
CTE["outcome_named"] = _outcomes("score", "correctness")

CTE["series"] = "SELECT day, coalesce(sum(total_cost), 0) AS cost FROM fact GROUP BY 1"
CTE["long_series"] = """
SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,6))) AS cost FROM orders GROUP BY 1"""
CTE["long_user_days"] = """
SELECT 'c' || o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day,
       sum(CAST(o_totalprice AS DECIMAL(18,6))) AS cost FROM orders GROUP BY 1, 2"""
CTE["user_days"] = """
SELECT coalesce(user_id, '(unattributed)') AS user_id, day, sum(total_cost) AS cost FROM fact GROUP BY 1, 2"""


def _baseline(series: str, since: str) -> str:
    return f"""
SELECT day, round(c, 4) AS cost, round(m14, 4) AS baseline_14d,
       round(CASE WHEN n14 >= 2 AND sd > 0 THEN (c - m14) / sd END, 3) AS z_score,
       round(nullif(mdow, 0), 4) AS dow_baseline, round(c / nullif(mdow, 0), 4) AS dow_ratio
FROM (SELECT day, CAST(cost AS DOUBLE) AS c, count(*) OVER w AS n14,
             CAST(sum(cost) OVER w AS DOUBLE) / count(*) OVER w AS m14,
             CASE WHEN count(*) OVER w >= 2 THEN stddev_samp(CAST(cost AS DOUBLE)) OVER w END AS sd,
             CAST(sum(cost) OVER wd AS DOUBLE) / count(*) OVER wd AS mdow
      FROM {series} WHERE day >= {since}
      WINDOW w AS (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
             wd AS (PARTITION BY isodow(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""


CTE["base60"] = _baseline("series", "DATE '2023-11-29'")
CTE["base44"] = _baseline("series", "DATE '2023-12-15'")
CTE["long_base"] = _baseline("long_series", f"{LONG_AS_OF} - 365")


def _judged(base: str, threshold: float) -> str:
    return f"""
SELECT day, cost, coalesce(dow_baseline, baseline_14d) AS baseline,
       round((cost - baseline_14d) / nullif(baseline_14d, 0), 4) AS pct_change, z_score, dow_ratio,
       (coalesce((cost - baseline_14d) / nullif(baseline_14d, 0) > {threshold} - 1, false)
        OR coalesce(z_score > 2.5, false) OR coalesce(dow_ratio > {threshold}, false)) AS is_anomaly
FROM {base}"""


CTE["judged"] = _judged("base44", 1.5)
CTE["judged_low"] = _judged("base44", 1.05)
CTE["long_judged"] = _judged("long_base", 1.5)


def _trend(series: str, since: str) -> str:
    return f"""
SELECT day, round(CAST(cost AS DOUBLE), 4) AS cost,
       round(CASE WHEN count(*) OVER w >= 2 THEN regr_slope(CAST(cost AS DOUBLE), rn) OVER w END, 4) AS slope
FROM (SELECT *, row_number() OVER (ORDER BY day) AS rn FROM {series} WHERE day >= {since})
WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


CTE["trend"] = _trend("series", "DATE '2023-10-30'")
CTE["long_trend"] = _trend("long_series", f"{LONG_AS_OF} - 365")
DIRECTION = "CASE WHEN slope > 0.01 THEN 'up' WHEN slope < -0.01 THEN 'down' ELSE 'flat' END"


def _trend_query(trend: str) -> str:
    return f"SELECT {DAY}, cost, slope, {DIRECTION} AS direction FROM {trend}"


def _change_points(trend: str) -> str:
    return f"""
SELECT {DAY}, CASE WHEN p > 0 THEN 'up' ELSE 'down' END AS "from", CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS "to"
FROM (SELECT day, slope, lag(slope) OVER (ORDER BY day) AS p FROM {trend})
WHERE (p > 0.01 AND slope < -0.01) OR (p < -0.01 AND slope > 0.01)"""


WEEK_LABEL = "isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0')"


def _periods(series: str, since: str, label: str, change: str) -> str:
    return f"""
SELECT period, round(CAST(cost AS DOUBLE), 4) AS total_cost,
       round(CAST(cost - p AS DOUBLE) / CAST(nullif(p, 0) AS DOUBLE), 4) AS {change}
FROM (SELECT period, cost, lag(cost) OVER (ORDER BY period) AS p
      FROM (SELECT {label} AS period, sum(cost) AS cost FROM {series} WHERE day >= {since} GROUP BY 1))"""


def _cohort(user_days: str, since: str, calendar: bool) -> str:
    extra = ", CAST((monday - first_monday) // 7 AS INTEGER) AS week_offset_calendar" if calendar else ""
    group = "1, 2, 3" if calendar else "1, 2"
    return f"""
SELECT first_week AS cohort, CAST(n - first_n AS INTEGER) AS week_offset{extra},
       round(CAST(sum(cost) AS DOUBLE), 4) AS cost, count(DISTINCT user_id) AS users
FROM (SELECT *, min(wk) OVER u AS first_week, min(n) OVER u AS first_n, min(monday) OVER u AS first_monday
      FROM (SELECT user_id, cost, {WEEK_LABEL} AS wk, isoyear(day) * 52 + week(day) AS n,
                   CAST(date_trunc('week', day) AS DATE) AS monday
            FROM {user_days} WHERE day >= {since})
      WINDOW u AS (PARTITION BY user_id))
GROUP BY {group}"""


# -- questions ------------------------------------------------------------------------

DAY = "strftime(day, '%Y-%m-%d') AS day"
STAMP = "'%Y-%m-%dT%H:%M:%S.%f'"
USD = "CAST(total_cost AS DOUBLE) AS total_cost"
SINCE_30 = "DATE '2023-12-29'"
GOV_COUNTS = (
    "precision14_numerator, precision14_denominator, precision14_ratio, proposals_total, "
    "proposals_pending, proposals_ratified, proposals_rejected, proposals_decayed"
)


def _daily(column: str) -> str:
    return f"""
SELECT {DAY}, {column} AS label, CAST(sum(total_cost) AS DOUBLE) AS total_cost,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(observations) AS BIGINT) AS observations
FROM e1 WHERE day >= {SINCE_30} GROUP BY day, {column}"""


def _top(column: str, metric: str, limit: int = 10) -> str:
    return f"""
SELECT label, CAST(c AS DOUBLE) AS total_cost, total_tokens, observations
FROM (SELECT {column} AS label, sum(total_cost) AS c, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
             CAST(sum(observations) AS BIGINT) AS observations
      FROM e1 WHERE day >= {SINCE_30} GROUP BY 1)
ORDER BY {metric} DESC, label LIMIT {limit}"""


def _quality(outcome: str, threshold: float, name: str) -> str:
    passing = f"FILTER (WHERE best_score >= {threshold})"
    return f"""
SELECT count(*) AS scored_traces, count(*) {passing} AS passing_traces,
       round((count(*) {passing})::DOUBLE / nullif(count(*), 0), 4) AS pass_rate,
       round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 6) AS scored_cost,
       round(CAST(coalesce(sum(cost) {passing}, 0) AS DOUBLE), 6) AS passing_cost,
       round(CAST(sum(cost) {passing} AS DOUBLE) / nullif(count(*) {passing}, 0), 6) AS cost_per_success,
       round(CAST(sum(cost) AS DOUBLE) / nullif(count(*), 0), 6) AS cost_per_scored_trace,
       {threshold}::DOUBLE AS threshold, '{name}' AS score_name
FROM {outcome}"""


MTD_COLUMNS = (
    "cost_mtd, tokens_mtd, input_tokens_mtd, output_tokens_mtd, cached_tokens_mtd, observations_mtd, "
    "active_users_mtd, sessions_mtd, cost_per_1k_tokens"
)
RECENT = f"e4 WHERE last_seen >= {AS_OF} - INTERVAL 30 DAY"
ANOMALY = "cost, baseline, pct_change, z_score, dow_ratio"

QUESTIONS: dict[str, str] = {}

QUESTIONS["mrt_daily_usage"] = f"""
SELECT {DAY}, project_id, project_name, user_id, team, model, observations, traces, {", ".join(TOKENS)},
       CAST(input_cost AS DOUBLE) AS input_cost, CAST(output_cost AS DOUBLE) AS output_cost, {USD} FROM e1"""
QUESTIONS["mrt_model_efficiency"] = f"SELECT * REPLACE (CAST(total_cost AS DOUBLE) AS total_cost) FROM e2"
QUESTIONS["mrt_org_daily"] = f"SELECT {DAY}, observations, traces, {', '.join(TOKENS)}, {USD} FROM e3"
QUESTIONS["mrt_org_daily_exact"] = f"""
SELECT strftime(e3.day, '%Y-%m-%d') AS day, traces, traces_distinct, CAST(total_cost AS DOUBLE) AS total_cost
FROM e3 JOIN (SELECT day, count(DISTINCT trace_id) AS traces_distinct FROM fact GROUP BY 1) t ON t.day = e3.day"""
QUESTIONS["mrt_session"] = f"""
SELECT session_id, user_id, project_name, strftime(first_seen, {STAMP}) AS first_seen,
       strftime(last_seen, {STAMP}) AS last_seen, turns, observations, input_tokens, output_tokens,
       total_tokens, {USD} FROM e4"""
QUESTIONS["mrt_model_daily"] = f"""
SELECT {DAY}, model, {", ".join(TOKENS)}, {USD}, avg_latency_ms, cache_hit_rate, reasoning_share,
       output_input_ratio, cost_per_1k_tokens FROM e5"""
QUESTIONS["mrt_hourly_usage"] = f"""
SELECT strftime(hour, {STAMP}) AS hour, project_name, observations, input_tokens, output_tokens, total_tokens,
       {USD} FROM e6"""
QUESTIONS["mrt_governance_daily"] = f"""
SELECT {DAY}, ttrp_ms, precision14_ratio, proposals_total, proposals_pending, proposals_ratified,
       proposals_rejected, proposals_decayed FROM e7"""
QUESTIONS["mrt_governance_daily_per_project"] = f"""
SELECT {DAY}, project_id, ttrp_ms, precision14_ratio, proposals_total, proposals_pending, proposals_ratified,
       proposals_rejected, proposals_decayed
FROM (SELECT *, row_number() OVER (PARTITION BY day, project_id ORDER BY exported_at DESC, snapshot_id DESC) AS rn
      FROM gov) WHERE rn = 1"""
QUESTIONS["mrt_policy_coverage"] = "SELECT * FROM e8"
QUESTIONS["mrt_daily_usage_volume"] = f"""
SELECT {DAY}, project AS project_id, project AS project_name, user_id, 'Unassigned' AS team, model,
       count(*) AS observations, count(DISTINCT trace_id) AS traces,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(0 AS BIGINT) AS reasoning_tokens,
       CAST(NULL AS DOUBLE) AS input_cost, CAST(NULL AS DOUBLE) AS output_cost,
       CAST(sum(CAST(raw_cost AS DECIMAL(24,12))) AS DOUBLE) AS total_cost
FROM lines GROUP BY lines.day, project, user_id, model"""

QUESTIONS["kpi_overview_mtd"] = f"SELECT {MTD_COLUMNS} FROM mtd"
QUESTIONS["kpi_overview_wow"] = "SELECT last7, prev7 FROM wow"
QUESTIONS["kpi_overview"] = f"""
SELECT {MTD_COLUMNS}, round(cached_tokens_mtd::DOUBLE / nullif(input_tokens_mtd, 0), 4) AS cache_hit_rate,
       round(output_tokens_mtd::DOUBLE / nullif(input_tokens_mtd, 0), 4) AS output_input_ratio,
       round(cost_mtd / nullif(active_users_mtd, 0), 2) AS cost_per_active_dev,
       round(cost_mtd / nullif(sessions_mtd, 0), 4) AS avg_cost_per_session,
       round((last7 - prev7) / nullif(prev7, 0) * 100, 1) AS wow_cost_pct
FROM mtd, wow"""
for _name, _column in (
    ("project", "project_name"), ("team", "team"), ("user", "user_id"), ("model", "model")
):
    QUESTIONS[f"kpi_daily_{_name}"] = _daily(_column)
QUESTIONS["kpi_top_cost"] = _top("user_id", "c")
QUESTIONS["kpi_top_tokens"] = _top("user_id", "total_tokens")
QUESTIONS["kpi_top_team"] = _top("team", "c")
QUESTIONS["kpi_efficiency"] = """
SELECT * REPLACE (CAST(total_cost AS DOUBLE) AS total_cost), input_tokens + output_tokens AS token_volume FROM e2"""
QUESTIONS["kpi_budget"] = """
SELECT 500000.0::DOUBLE AS monthly_budget, mtd_cost, active_users FROM g"""
QUESTIONS["kpi_month_cost"] = "SELECT mtd_cost, active_users FROM g"
QUESTIONS["kpi_unattributed"] = "SELECT unattributed AS cost FROM g"
QUESTIONS["kpi_concentration"] = "SELECT top5 AS top_cost FROM g"
QUESTIONS["kpi_total_cost"] = "SELECT total_30d AS total_cost FROM g"
QUESTIONS["kpi_governance"] = """
SELECT mtd_cost, monthly_budget, round(mtd_cost / nullif(monthly_budget, 0), 4) AS burn_rate, active_users,
       round(unattributed, 6) AS unattributed_cost, round(unattributed / nullif(mtd_cost, 0), 4) AS unattributed_pct,
       round(top5 / nullif(total_30d, 0), 4) AS concentration_top5_pct FROM g"""
QUESTIONS["kpi_session_stats"] = f"""
SELECT count(*) AS sessions, round(sum(input_tokens)::DOUBLE / count(input_tokens), 1) AS avg_context_tokens,
       round(sum(turns)::DOUBLE / count(turns), 1) AS avg_turns,
       round(sum(total_cost)::DOUBLE / count(total_cost), 4) AS avg_cost,
       round(sum(input_tokens)::DOUBLE / nullif(sum(turns), 0)::DOUBLE, 1) AS avg_input_per_turn FROM {RECENT}"""
_SESSIONS_TOP = """
SELECT session_id, user_id, project_name, turns, observations, input_tokens, output_tokens,
       CAST(total_cost AS DOUBLE) AS total_cost,
       round(input_tokens::DOUBLE / nullif(turns, 0), 1) AS input_per_turn,
       round(total_tokens::DOUBLE / nullif(turns, 0), 1) AS tokens_per_turn
FROM {recent} ORDER BY e4.input_tokens DESC, session_id, user_id, project_name LIMIT 20"""
QUESTIONS["kpi_sessions_top"] = _SESSIONS_TOP.format(recent=RECENT)
QUESTIONS["tokens_per_turn"] = """
SELECT session_id, user_id, project_name, round(total_tokens::DOUBLE / nullif(turns, 0), 1) AS tokens_per_turn FROM e4"""
QUESTIONS["kpi_org_daily"] = f"SELECT {DAY}, CAST(cost AS DOUBLE) AS total_cost FROM series WHERE day >= {SINCE_30}"
QUESTIONS["kpi_trace_outcomes"] = "SELECT trace_id, CAST(cost AS DOUBLE) AS cost, best_score FROM outcome"
QUESTIONS["kpi_quality"] = _quality("outcome", 0.5, "(all)")
QUESTIONS["kpi_quality_named"] = _quality("outcome_named", 0.25, "correctness")
_MODEL_DAILY = f"""
SELECT {DAY}, model, cache_hit_rate, reasoning_share, output_input_ratio, cost_per_1k_tokens, input_tokens,
       output_tokens, {USD} FROM e5 WHERE e5.day >= {SINCE_30}"""
QUESTIONS["kpi_model_daily"] = _MODEL_DAILY
QUESTIONS["kpi_model_daily_one"] = _MODEL_DAILY + " AND model = 'model-a'"
_HOURLY = f"""
SELECT strftime(hour, {STAMP}) AS hour, project_name, observations, input_tokens, output_tokens, total_tokens,
       {USD} FROM e6 WHERE e6.hour >= {AS_OF} - INTERVAL 7 DAY"""
QUESTIONS["kpi_hourly"] = _HOURLY
QUESTIONS["kpi_hourly_project"] = _HOURLY + " AND project_name = 'Docs'"
QUESTIONS["kpi_user_daily"] = f"SELECT user_id, {DAY}, CAST(cost AS DOUBLE) AS total_cost FROM user_days WHERE user_days.day >= DATE '2023-10-30'"
QUESTIONS["kpi_governance_snapshot"] = f"""
SELECT ttrp_ms, {GOV_COUNTS} FROM gov ORDER BY exported_at DESC, snapshot_id DESC LIMIT 1"""
QUESTIONS["kpi_behaviour_metrics"] = f"""
SELECT CAST(trunc(ttrp_ms) AS BIGINT) AS ttrp_ms, {GOV_COUNTS}
FROM gov ORDER BY exported_at DESC, snapshot_id DESC LIMIT 1"""
QUESTIONS["kpi_policies"] = f"SELECT * REPLACE (strftime(promoted_at, {STAMP}) AS promoted_at) FROM policy"
QUESTIONS["kpi_divergence"] = "SELECT * FROM divergence"
QUESTIONS["kpi_targets"] = """
SELECT metric, label, round(current, 4) AS current, threshold, op,
       CASE op WHEN 'gte' THEN current >= threshold WHEN 'lte' THEN current <= threshold END AS pass
FROM target JOIN (
  SELECT 'cache_hit_rate' AS metric, round(cached_tokens_mtd::DOUBLE / nullif(input_tokens_mtd, 0), 4) AS current FROM mtd
  UNION ALL SELECT 'output_input_ratio', round(output_tokens_mtd::DOUBLE / nullif(input_tokens_mtd, 0), 4) FROM mtd
  UNION ALL SELECT 'cost_per_1k_tokens', cost_per_1k_tokens FROM mtd
  UNION ALL SELECT 'burn_rate', round(cost_mtd / 500000, 4) FROM mtd
  UNION ALL SELECT 'reasoning_share', reasoning_mtd::DOUBLE / nullif(tokens_mtd, 0) FROM mtd) USING (metric)
WHERE current IS NOT NULL"""

QUESTIONS["kpi_baseline"] = f"SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM base60"
QUESTIONS["kpi_baseline_long"] = f"SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM long_base"
QUESTIONS["kpi_anomalies"] = f"SELECT {DAY}, {ANOMALY} FROM judged WHERE is_anomaly"
QUESTIONS["kpi_anomalies_low"] = f"SELECT {DAY}, {ANOMALY} FROM judged_low WHERE is_anomaly"
QUESTIONS["kpi_anomaly_latest"] = f"""
SELECT {DAY}, {ANOMALY}, is_anomaly FROM judged ORDER BY judged.day DESC LIMIT 1"""
QUESTIONS["anomalies_recent"] = f"""
SELECT {DAY}, {ANOMALY} FROM long_judged WHERE is_anomaly ORDER BY long_judged.day DESC LIMIT 10"""
QUESTIONS["kpi_burndown"] = f"""
SELECT {DAY}, round(CAST(cost AS DOUBLE), 4) AS cost,
       round(CAST(sum(cost) OVER (ORDER BY series.day) AS DOUBLE), 4) AS cumulative
FROM series WHERE series.day >= DATE '2024-01-01'"""
QUESTIONS["kpi_burndown_summary"] = """
SELECT 500000.0::DOUBLE AS budget, round(c, 4) AS cumulative, round(c / n, 4) AS avg_daily, n AS days_elapsed,
       CAST(greatest(31 - n, 0) AS BIGINT) AS days_remaining,
       round(c + c / n * greatest(31 - n, 0), 4) AS projected_end,
       c + c / n * greatest(31 - n, 0) > 500000 AS over_budget
FROM (SELECT CAST(sum(cost) AS DOUBLE) AS c, count(*) AS n FROM series WHERE day >= DATE '2024-01-01')"""
QUESTIONS["kpi_periods_weekly"] = _periods("series", "DATE '2023-10-30'", WEEK_LABEL, "wow_pct")
QUESTIONS["kpi_periods_monthly"] = _periods("series", "DATE '2023-10-30'", "strftime(day, '%Y-%m')", "mom_pct")
QUESTIONS["kpi_periods_weekly_long"] = _periods("long_series", f"{LONG_AS_OF} - 730", WEEK_LABEL, "wow_pct")
QUESTIONS["kpi_periods_monthly_long"] = _periods(
    "long_series", f"{LONG_AS_OF} - 730", "strftime(day, '%Y-%m')", "mom_pct"
)
QUESTIONS["kpi_periods_weekly_all"] = _periods("long_series", "DATE '1900-01-01'", WEEK_LABEL, "wow_pct")
QUESTIONS["kpi_periods_monthly_all"] = _periods(
    "long_series", "DATE '1900-01-01'", "strftime(day, '%Y-%m')", "mom_pct"
)
QUESTIONS["kpi_trend"] = _trend_query("trend")
QUESTIONS["kpi_trend_long"] = _trend_query("long_trend")
QUESTIONS["kpi_change_points"] = _change_points("trend")
QUESTIONS["kpi_change_points_long"] = _change_points("long_trend")
QUESTIONS["kpi_cohort"] = _cohort("user_days", "DATE '2023-10-30'", calendar=False)
QUESTIONS["kpi_cohort_long"] = _cohort("long_user_days", f"{LONG_AS_OF} - 730", calendar=False)
QUESTIONS["kpi_cohort_all"] = _cohort("long_user_days", "DATE '1900-01-01'", calendar=False)
QUESTIONS["kpi_cohort_calendar"] = _cohort("long_user_days", "DATE '1900-01-01'", calendar=True)

# -- dashboard ---------------------------------------------------------------------------

RANGE = "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
TIME = "strftime(day, '%Y-%m-%d') AS time"

QUESTIONS["dash_cost"] = f"SELECT {TIME}, CAST(sum(total_cost) AS DOUBLE) AS cost FROM e3 WHERE {RANGE} GROUP BY day"
QUESTIONS["dash_tokens"] = f"""
SELECT {TIME}, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out,
       CAST(sum(total_tokens) AS BIGINT) AS tokens_total FROM e3 WHERE {RANGE} GROUP BY day"""
QUESTIONS["dash_cost_by_project"] = f"""
SELECT {TIME}, project_name AS metric, CAST(sum(total_cost) AS DOUBLE) AS value FROM e1 WHERE {RANGE} GROUP BY day, project_name"""
QUESTIONS["dash_cost_by_model"] = f"""
SELECT {TIME}, model AS metric, CAST(sum(total_cost) AS DOUBLE) AS value FROM e1 WHERE {RANGE} GROUP BY day, model"""
QUESTIONS["dash_cache_hit"] = f"""
SELECT {TIME}, model AS metric, avg(cache_hit_rate) AS value FROM e5 WHERE {RANGE} GROUP BY day, model"""
QUESTIONS["dash_cache_hit_weekly"] = f"""
SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS time, model AS metric,
       round(avg(cache_hit_rate), 9) AS value FROM e5 WHERE {RANGE} GROUP BY 1, 2"""
QUESTIONS["dash_cost_per_1k"] = f"""
SELECT {TIME}, model AS metric, avg(cost_per_1k_tokens) AS value FROM e5 WHERE {RANGE} GROUP BY day, model"""
QUESTIONS["dash_top_users"] = f"""
SELECT user_id, CAST(c AS DOUBLE) AS cost, tokens FROM (
  SELECT user_id, sum(total_cost) AS c, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM e1 WHERE {RANGE} GROUP BY 1)
ORDER BY c DESC, user_id LIMIT 10"""
QUESTIONS["dash_efficiency"] = """
SELECT model, cache_hit_rate, reasoning_share, output_input_ratio, cost_per_1k_tokens,
       CAST(total_cost AS DOUBLE) AS total_cost FROM e2"""
QUESTIONS["dash_proposals"] = f"""
SELECT {TIME}, proposals_total AS total, proposals_ratified AS ratified FROM e7 WHERE {RANGE}"""
QUESTIONS["dash_policies"] = f"""
SELECT rule_key, kind, confidence, operator, evidence_traces, strftime(promoted_at, {STAMP}) AS promoted_at FROM policy"""
QUESTIONS["dash_divergence"] = """
SELECT model, task_key, divergent_traces, total_traces,
       round(divergent_traces::DOUBLE / nullif(total_traces, 0), 4) AS divergence_ratio FROM divergence"""
QUESTIONS["dash_coverage"] = "SELECT * FROM e8"


def _pivot(rows: str, value: str, ranks: int) -> str:
    """Days by the labels of largest total cost, one column pair per rank."""
    pairs = ", ".join(
        f"(SELECT label FROM top WHERE rank = {i}) AS label_{i}, "
        f"CAST(max({value}) FILTER (WHERE rank = {i}) AS DOUBLE) AS value_{i}"
        for i in range(1, ranks + 1)
    )
    return f"""
, rows AS ({rows}),
top AS (SELECT label, row_number() OVER (ORDER BY sum(total_cost) DESC, label) AS rank
        FROM rows GROUP BY label ORDER BY sum(total_cost) DESC, label LIMIT {ranks})
SELECT {DAY}, {pairs} FROM rows LEFT JOIN top USING (label) GROUP BY rows.day"""


QUESTIONS["pivot_daily_top6"] = _pivot(
    f"SELECT day, user_id AS label, sum(total_cost) AS total_cost FROM e1 WHERE day >= {SINCE_30} GROUP BY 1, 2",
    "total_cost",
    6,
)
QUESTIONS["pivot_model_top5"] = _pivot(
    f"SELECT day, model AS label, cache_hit_rate, total_cost FROM e5 WHERE day >= {SINCE_30}",
    "cache_hit_rate",
    5,
)
QUESTIONS["hour_of_day"] = f"""
SELECT printf('%02d:00', h) AS hour, round(CAST(coalesce(sum(total_cost), 0) AS DOUBLE), 2) AS cost
FROM range(24) AS hours(h) LEFT JOIN (SELECT * FROM e6 WHERE hour >= {AS_OF} - INTERVAL 7 DAY AND project_name = 'Docs')
  ON hour(hour) = h GROUP BY h"""
QUESTIONS["burn_severity"] = """
SELECT round(mtd_cost / monthly_budget, 4) AS burn_rate, least(round(mtd_cost / monthly_budget, 4) * 100, 100) AS burn_pct,
       CASE WHEN least(round(mtd_cost / monthly_budget, 4) * 100, 100) > 90 THEN 'crit'
            WHEN least(round(mtd_cost / monthly_budget, 4) * 100, 100) > 75 THEN 'warn' ELSE '' END AS severity FROM g"""


def statement(question: str, extra: dict[str, str] | None = None) -> str:
    """The question preceded by the common tables it needs, dependencies first."""
    tables = {**CTE, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
                visit(tables[name])
                if name not in needed:
                    needed.append(name)

    visit(question)
    body = question.strip()
    prefix = ",\n".join(f"{name} AS ({tables[name].strip()})" for name in needed)
    if body.startswith(","):
        return f"WITH {prefix}{body}" if prefix else f"WITH {body[1:].strip()}"
    return f"WITH {prefix}\n{body}" if prefix else body
