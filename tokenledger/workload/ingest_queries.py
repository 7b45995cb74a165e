"""Registered ingest, store and streaming queries and their DuckDB statements."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.scalars import edge
from tokenledger.operators.enrich import enrich_from_traces
from tokenledger.operators.governance_rows import (
    governance_divergence,
    governance_policies,
    governance_snapshots,
)
from tokenledger.operators.latest import latest_by_key
from tokenledger.operators.normalize import normalize_observations, normalize_scores
from tokenledger.operators.session_calls import price_calls, session_calls, session_observations
from tokenledger.operators.store import Store, schema_with_nulls
from tokenledger.plans.kpis import kpi_session_stats
from tokenledger.plans.marts import mrt_daily_usage, mrt_hourly_usage, mrt_model_daily, mrt_org_daily, mrt_session
from tokenledger.reference_data import default_model_prices
from tokenledger.schemas import (
    DIM_POLICY,
    DIM_USER,
    FACT_GOVERNANCE,
    FACT_GOVERNANCE_DIVERGENCE,
    FACT_OBSERVATION,
    FACT_SCORE,
    MONEY,
    RAW_SCORE,
)
from tokenledger.session import scratch_dir
from tokenledger.sources.governance import accepted, read_governance_documents
from tokenledger.sources.landing import (
    lookback,
    in_window,
    project_table,
    read_observations,
    read_scores,
    read_store_observations,
    read_store_scores,
    read_store_traces,
)
from tokenledger.sources.seen_files import SeenFiles
from tokenledger.sources.session_logs import read_session_events
from tokenledger.streaming.jobs import start_observation_sync, start_score_sync, start_trace_store_sync
from tokenledger.streaming.syncs import sync_governance, sync_session_logs
from tokenledger.workload.landed import (
    land_governance,
    land_observations,
    land_scores,
    land_session_logs,
    land_store_export,
    land_store_scores,
)
from tokenledger.workload.projections import (
    AS_OF,
    event_observations,
    event_scores,
    event_users,
    table,
    with_k,
)
from tokenledger.functions import scalars

QUERIES: dict = {}
QUESTIONS: dict[str, str] = {}
CTE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: edge(function(spark, sf_dir))
        if sql is not None:
            QUESTIONS[name] = sql
        return function

    return register


STAMP = "'%Y-%m-%dT%H:%M:%S.%f'"

# -- observations and scores -----------------------------------------------------

CTE["raw"] = """
SELECT event_id, 'ev-' || event_id AS observation_id, 'tr-' || user_id || '-' || d || '-' || (event_id % 3) AS trace_id,
       CASE WHEN event_id % 2 = 1 THEN 'own-' || (user_id % 4) ELSE 'src-' || (user_id % 3) END AS project_id,
       'src-' || (user_id % 3) AS folder,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || user_id END AS user_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'se-' || user_id || '-' || d END AS session_id,
       event_type AS model, 'GENERATION' AS type, 'chat' AS name,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE 'production' END AS environment,
       CASE WHEN event_id % 50 = 49 THEN NULL ELSE ts END AS start_time,
       CASE WHEN event_id % 7 <> 0 THEN ts + to_milliseconds(k) END AS end_time,
       CASE WHEN event_id % 50 <> 49 AND event_id % 7 <> 0 THEN CAST(k AS DOUBLE) END AS latency_ms,
       200 + k * 40 AS input_tokens, 50 + event_id % 30 * 10 AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN 250 ELSE 300 END + k * 40 + event_id % 30 * 10 AS total_tokens,
       k + 6 AS cached_input_tokens,
       CAST(CASE WHEN event_id % 4 = 0 THEN 9 ELSE 3 END AS BIGINT) AS reasoning_tokens,
       CASE WHEN tiny THEN 1E-7 ELSE cents / 400 END AS input_cost, CASE WHEN tiny THEN 2E-7 ELSE cents / 200 END AS output_cost,
       CASE WHEN event_id % 5 <> 0 THEN CASE WHEN tiny THEN 4E-7 ELSE value END
            WHEN tiny THEN 3E-7 ELSE cents * 3 / 400 END AS total_cost,
       'DEFAULT' AS level, CASE WHEN event_type = 'error' THEN 'failed' END AS status_message,
       CASE WHEN event_id % 6 = 0 THEN '["a","b"]' END AS tags
FROM (SELECT *, event_id % 11 = 3 AS tiny, round(value * 100) AS cents FROM ev)"""

_FACT = f"""observation_id, trace_id, project_id, {{project_name}} AS project_name, user_id, session_id, model, type, name,
       environment, strftime(start_time, {STAMP}) AS start_time, strftime(end_time, {STAMP}) AS end_time, latency_ms,
       input_tokens, output_tokens, total_tokens, cached_input_tokens, reasoning_tokens, input_cost, output_cost,
       total_cost, level, status_message, tags"""


@query(
    "ingest_observations",
    "SELECT " + _FACT.format(
        project_name="CASE folder WHEN 'src-0' THEN 'Source zero' WHEN 'src-1' THEN 'src-1' END"
    ) + " FROM raw",
)
def ingest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = project_table(spark, [{"id": "src-0", "name": "Source zero"}, {"id": "src-1"}])
    raw = read_observations(spark, land_observations(spark, sf_dir)).join(projects, "project", "left")
    return normalize_observations(raw).drop("_seq")


CTE["raw_score"] = """
SELECT 'sc-' || event_id AS score_id, 'tr-' || user_id || '-' || d || '-' || (event_id % 3) AS trace_id,
       CASE WHEN event_id % 4 IN (1, 2) THEN 'ev-' || event_id END AS observation_id,
       CAST(NULL AS VARCHAR) AS project_id, CAST(NULL AS VARCHAR) AS project_name,
       CASE WHEN event_id % 2 = 0 THEN 'correctness' ELSE 'helpfulness' END AS name,
       CASE WHEN k = 13 THEN 0 ELSE k / 100.0 END::DOUBLE AS value, 'API' AS source, ts AS timestamp
FROM ev"""


@query("ingest_scores", f"SELECT * REPLACE (strftime(timestamp, {STAMP}) AS timestamp) FROM raw_score")
def ingest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_scores(read_scores(spark, land_scores(spark, sf_dir))).drop("_seq")


@query(
    "ingest_store_scores",
    f"""
SELECT 'sc-' || event_id AS score_id, trace_id, CASE WHEN event_id % 4 = 1 THEN 'ev-' || event_id END AS observation_id,
       'src-' || (user_id % 3) AS project_id, CAST(NULL AS VARCHAR) AS project_name, name, value, source,
       strftime(timestamp, {STAMP}) AS timestamp
FROM (SELECT ev.event_id, ev.user_id, s.* FROM ev JOIN raw_score s ON s.score_id = 'sc-' || ev.event_id)
WHERE timestamp >= TIMESTAMP '2024-01-14 12:00:00' AND timestamp < TIMESTAMP '2024-01-28 12:00:00'""",
)
def ingest_store_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice through a ledger of files; the second scan only lists them."""
    path = land_store_scores(spark, sf_dir)
    seen = SeenFiles(Store(spark, scratch_dir(spark, "store")))
    read_store_scores(spark, path, lookback(AS_OF, 14), seen)
    return normalize_scores(read_store_scores(spark, path, lookback(AS_OF, 14), seen)).drop("_seq")


CTE["store_raw"] = """
SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN '' ELSE trace_id END AS trace_id, folder AS project_id,
         CASE WHEN event_id % 3 <> 0 THEN model WHEN event_id % 6 <> 0 THEN 'internal-' || model ELSE '' END AS model)
FROM raw"""

CTE["trace"] = """
SELECT r.trace_id AS id, CASE WHEN max(r.event_id) % 5 = 0 THEN '' ELSE max(r.user_id) END AS t_user,
       max(r.session_id) AS t_session FROM raw r GROUP BY 1"""


@query(
    "ingest_store_observations",
    "SELECT " + _FACT.format(project_name="CAST(NULL AS VARCHAR)") + """ FROM (
SELECT * REPLACE (CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS tags)
FROM store_raw WHERE start_time >= TIMESTAMP '2024-01-14 12:00:00' AND start_time < TIMESTAMP '2024-01-28 12:00:00')""",
)
def ingest_store_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = land_store_export(spark, sf_dir)
    raw = read_store_observations(spark, f"{root}/observations", lookback(AS_OF, 14))
    return normalize_observations(raw).drop("_seq")


_ENRICHED = """
SELECT observation_id, nullif(t_user, '') AS user_id, t_session AS session_id,
       CASE WHEN environment <> '' THEN environment WHEN t.id IS NOT NULL THEN 'from-trace' ELSE environment END AS environment,
       CASE WHEN t.id IS NOT NULL THEN '["' || t.id || '"]' END AS tags
FROM store_raw s LEFT JOIN trace t ON t.id = s.trace_id"""


@query("enrich_traces", _ENRICHED)
def enrich_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = land_store_export(spark, sf_dir)
    traces = read_store_traces(spark, f"{root}/traces/*")
    enriched = enrich_from_traces(read_store_observations(spark, f"{root}/observations"), traces)
    return normalize_observations(enriched).select(
        "observation_id", "user_id", "session_id", "environment", "tags"
    )


@query(
    "lookback_scan",
    f"""
SELECT observation_id, strftime(start_time, {STAMP}) AS start_time FROM fact
WHERE start_time >= TIMESTAMP '2024-01-14 12:00:00' AND start_time < TIMESTAMP '2024-01-28 12:00:00'""",
)
def lookback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = event_observations(spark, sf_dir)
    return in_window(facts, F.col("start_time"), lookback(AS_OF, 14)).select("observation_id", "start_time")


@query(
    "safe_casts",
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 3 THEN k ELSE 0 END AS as_int,
       CASE event_id % 5 WHEN 4 THEN 0 WHEN 0 THEN k + 0.75 WHEN 2 THEN k + 0.75 ELSE k END::DOUBLE AS as_float
FROM ev""",
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers truncate, whole text counts, fractional text and words are zero."""
    cases = with_k(table(spark, sf_dir, "events")).select(
        "event_id",
        F.expr(
            "CASE event_id % 5 WHEN 0 THEN concat('{\"v\": ', k, '.75}') "
            "WHEN 1 THEN concat('{\"v\": \" ', k, ' \"}') WHEN 2 THEN concat('{\"v\": \"', k, '.75\"}') "
            "WHEN 3 THEN concat('{\"v\": ', k, '}') ELSE '{\"v\": \"abc\"}' END"
        ).alias("text"),
    ).withColumn("doc", scalars.document(F.col("text")))
    return cases.select(
        "event_id",
        scalars.document_int(F.col("doc"), "v").alias("as_int"),
        scalars.document_float(F.col("doc"), "v").alias("as_float"),
    )


# -- session logs --------------------------------------------------------------------

CTE["log_event"] = """
SELECT event_id, user_id, ts, event_id % 17 = 0 AS is_session,
       event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_type <> 'error' AS is_call,
       20 + k AS input_tokens, event_id % 30 AS output_tokens, event_id % 3 AS reasoning_tokens, k * 2 AS counter,
       CASE event_type WHEN 'click' THEN 'deepseek-v4-pro' WHEN 'view' THEN 'deepseek-v4-flash'
            WHEN 'signup' THEN 'unpriced' END AS model FROM ev"""

CTE["log_session"] = """
SELECT *, max(CASE WHEN is_session THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS session_event
FROM log_event"""

CTE["log_call"] = """
SELECT *, 'project-' || (user_id % 3) AS project,
       CASE WHEN session_event IS NULL THEN 'dir' || user_id ELSE 's' || user_id || '-' || session_event END AS session_id,
       coalesce(least(input_tokens, greatest(0, counter - lag(counter) OVER w)), 0) AS cached_input_tokens,
       row_number() OVER w - 1 AS i
FROM log_session WHERE is_call WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""

CTE["log_price"] = """
SELECT * FROM (VALUES ('deepseek-v4-flash', 0.007::DECIMAL(18,6), 0.22::DECIMAL(18,6), 0.66::DECIMAL(18,6)),
  ('deepseek-v4-pro', 0.022, 0.66, 1.98)) AS p(model, hit, miss, output)"""

CTE["log_cost"] = """
SELECT c.*, coalesce(p.hit, 0) * cached_input_tokens + coalesce(p.miss, 0) * (input_tokens - cached_input_tokens) AS cin,
       coalesce(p.output, 0) * output_tokens AS cout
FROM log_call c LEFT JOIN log_price p ON p.model = c.model"""


def _dollars(raw: str) -> str:
    return f"CAST(CAST(CAST({raw} AS DECIMAL(30,6)) * 0.000001 AS DECIMAL(18,6)) AS DOUBLE)"


_COSTS = (
    f"{_dollars('cin')} AS input_cost, {_dollars('cout')} AS output_cost, {_dollars('cin + cout')} AS total_cost"
)


@query(
    "ingest_session_logs",
    f"""
SELECT 'log-' || session_id || '-' || i AS observation_id, 'log-' || session_id || '-' || i AS trace_id,
       project AS project_id, project AS project_name, 'local' AS user_id, session_id,
       coalesce(model, '(unknown)') AS model, 'GENERATION' AS type, 'assistant' AS name, 'cli' AS environment,
       strftime(CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '2024-01-28 12:00:00' ELSE date_trunc('millisecond', ts) END, {STAMP}) AS start_time,
       strftime(CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '2024-01-28 12:00:00' ELSE date_trunc('millisecond', ts) END, {STAMP}) AS end_time,
       0.0::DOUBLE AS latency_ms, input_tokens, output_tokens, input_tokens + output_tokens + reasoning_tokens AS total_tokens,
       cached_input_tokens, reasoning_tokens, {_COSTS},
       CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS status_message, CAST(NULL AS VARCHAR) AS tags
FROM log_cost""",
)
def ingest_session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = land_session_logs(spark, sf_dir)
    # Small chunks, so that state really is handed from chunk to chunk.
    events = read_session_events(spark, root, "part-*", chunk_lines=16)
    return session_observations(events, default_model_prices(spark), as_of=AS_OF).drop("_seq")


def _event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_k(table(spark, sf_dir, "events"))
    parsed = events.select(
        F.col("user_id").cast("string").alias("file"),
        F.struct("event_id").alias("line"),
        F.struct(F.expr("event_id div 1000").alias("run")).alias("chunk"),
        F.lit("project").alias("project_folder"),
        F.concat(F.lit("dir"), "user_id").alias("session_folder"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN 'session' ELSE 'assistant/message' END").alias("type"),
        F.expr("concat('s', user_id, '-', event_id)").alias("id"),
        F.lit(0.0).alias("time"),
        F.expr(
            "named_struct('inputTokens', CASE WHEN event_type = 'error' OR event_id % 19 = 0 THEN 0L ELSE 20 + k END, "
            "'outputTokens', CASE WHEN event_type = 'error' OR event_id % 19 = 0 THEN 0L ELSE event_id % 30 END, "
            "'reasoningTokens', event_id % 3, 'cacheReadTokens', k * 2)"
        ).alias("usage"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 'deepseek-v4-pro' WHEN 'view' THEN 'deepseek-v4-flash' "
            "WHEN 'signup' THEN 'unpriced' END"
        ).alias("model"),
    )
    return session_calls(parsed)


@query(
    "session_cache_delta",
    "SELECT event_id, session_id, input_tokens, cached_input_tokens, i AS call_index FROM log_call",
)
def session_cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_calls(spark, sf_dir).select(
        F.col("line.event_id").alias("event_id"),
        "session_id", "input_tokens", "cached_input_tokens", "call_index",
    )


@query("price_observations", f"SELECT event_id, {_COSTS} FROM log_cost")
def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = price_calls(_event_calls(spark, sf_dir), default_model_prices(spark))
    return priced.select(
        F.col("line.event_id").alias("event_id"), "input_cost", "output_cost", "total_cost"
    )


# -- governance documents ---------------------------------------------------------------

CTE["doc"] = """
SELECT s_suppkey // 5 AS doc, CASE WHEN (s_suppkey // 5) % 4 <> 3 THEN 'prj-' || (s_suppkey // 5) ELSE '(unknown)' END AS project_id,
       supplier.* FROM supplier WHERE (s_suppkey // 5) % 7 <> 6"""


@query(
    "ingest_governance",
    """
SELECT project_id || ':2024-01-' || lpad(CAST(doc % 28 + 1 AS VARCHAR), 2, '0') || 'T12:00:00+00:00' AS snapshot_id, project_id,
       '2024-01-' || lpad(CAST(doc % 28 + 1 AS VARCHAR), 2, '0') || 'T12:00:00.000000' AS exported_at,
       CASE WHEN doc % 5 <> 0 THEN CAST(doc * 1000 AS DOUBLE) END AS ttrp_ms,
       doc % 3 AS precision14_numerator, CAST(3 AS BIGINT) AS precision14_denominator,
       (doc % 3) / 4.0::DOUBLE AS precision14_ratio, doc + 4 AS proposals_total, doc AS proposals_pending,
       CAST(2 AS BIGINT) AS proposals_ratified, CAST(1 AS BIGINT) AS proposals_rejected, CAST(1 AS BIGINT) AS proposals_decayed
FROM (SELECT DISTINCT doc, project_id FROM doc)""",
)
def ingest_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance_snapshots(_documents(spark, sf_dir), AS_OF).drop("_seq")


@query(
    "ingest_policies",
    """
SELECT 'rule-' || s_suppkey AS rule_key, project_id, 'tool-choice' AS kind,
       CASE WHEN s_suppkey % 3 = 0 THEN 'ratified' ELSE 'proposed' END AS status,
       CAST((s_suppkey % 10) / 10.0 AS DOUBLE) AS confidence, '2024-01-05T10:00:00.000000' AS promoted_at,
       s_name AS operator, s_suppkey AS evidence_traces FROM doc""",
)
def ingest_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance_policies(_documents(spark, sf_dir)).drop("_seq")


@query(
    "ingest_divergence",
    """
SELECT project_id, 'model-' || s_nationkey AS model, s_name AS task_key, s_suppkey % 4 AS divergent_traces,
       s_suppkey + 5 AS total_traces FROM doc""",
)
def ingest_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance_divergence(_documents(spark, sf_dir)).drop("_seq")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(read_governance_documents(spark, f"{land_governance(spark, sf_dir)}/*/"))


# -- store -----------------------------------------------------------------------------

CTE["stored"] = """
SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN start_time + INTERVAL 1 DAY ELSE start_time END AS start_time,
                  CASE WHEN event_id % 3 = 0 THEN total_cost * 2 ELSE total_cost END AS total_cost)
FROM (SELECT CAST(replace(observation_id, 'ev-', '') AS BIGINT) AS event_id, * FROM fact)"""


def _corrections(facts: DataFrame) -> DataFrame:
    """Every third observation again: a stale copy, then one a day later at twice the cost."""
    number = F.substring("observation_id", 4, 20).cast("bigint")
    third = facts.where(number % 3 == 0)
    stale = third.withColumn("total_cost", F.lit(-1).cast(MONEY)).withColumn("_seq", F.struct(F.lit(1)))
    final = (
        third.withColumn("total_cost", (F.col("total_cost") * 2).cast(MONEY))
        .withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 1 DAY"))
        .withColumn("_seq", F.struct(F.lit(2)))
    )
    return final.unionByName(stale)


@query(
    "upsert_observations",
    f"""
SELECT observation_id, strftime(start_time, {STAMP}) AS start_time, strftime(start_time, '%Y-%m-%d') AS day,
       CAST(total_cost AS DOUBLE) AS total_cost, user_id FROM stored""",
)
def upsert_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark, "store"))
    facts = event_observations(spark, sf_dir)
    store.upsert_observations(facts, AS_OF)
    store.upsert_observations(_corrections(facts), AS_OF)
    return store.read(FACT_OBSERVATION).select(
        "observation_id", "start_time", "day", "total_cost", "user_id"
    )


@query(
    "upsert_scores",
    "SELECT score_id, trace_id, name, CASE WHEN name = 'correctness' THEN 1.0 ELSE value END::DOUBLE AS value FROM score",
)
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark, "store"))
    scores = event_scores(spark, sf_dir)
    store.upsert_scores(scores)
    store.upsert_scores(scores.where("name = 'correctness'").withColumn("value", F.lit(1.0)))
    return store.read(FACT_SCORE).select("score_id", "trace_id", "name", "value")


@query(
    "upsert_policies",
    """
SELECT 'rule-' || s_suppkey AS rule_key, CASE WHEN s_suppkey % 2 = 0 THEN 'moved' ELSE project_id END AS project_id,
       CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 THEN 'ratified' ELSE 'proposed' END AS status FROM doc""",
)
def upsert_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule key alone is the key: a rule that comes back from another project replaces the first."""
    store = Store(spark, scratch_dir(spark, "store"))
    policies = governance_policies(_documents(spark, sf_dir)).drop("_seq")
    store.upsert_policies(policies)
    even = policies.where(F.substring("rule_key", 6, 20).cast("bigint") % 2 == 0)
    store.upsert_policies(even.withColumn("project_id", F.lit("moved")).withColumn("status", F.lit("ratified")))
    return store.read(DIM_POLICY).select("rule_key", "project_id", "status")


@query(
    "upsert_governance",
    f"""
SELECT project_id || ':2024-01-' || lpad(CAST(doc % 28 + 1 AS VARCHAR), 2, '0') || 'T12:00:00+00:00' AS snapshot_id,
       CASE WHEN doc % 2 = 0 THEN '2024-02-01' ELSE '2024-01-' || lpad(CAST(doc % 28 + 1 AS VARCHAR), 2, '0') END AS day,
       doc + 4 + CASE WHEN doc % 2 = 0 THEN 100 ELSE 0 END AS proposals_total
FROM (SELECT DISTINCT doc, project_id FROM doc WHERE project_id <> '(unknown)')""",
)
def upsert_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that are sent again are replaced, their time of export too."""
    store = Store(spark, scratch_dir(spark, "store"))
    snapshots = governance_snapshots(_documents(spark, sf_dir), AS_OF).drop("_seq").where("project_id <> '(unknown)'")
    store.upsert_governance(snapshots)
    again = snapshots.where("proposals_total % 2 = 0").withColumn("proposals_total", F.col("proposals_total") + 100)
    store.upsert_governance(again.withColumn("exported_at", F.lit("2024-02-01 00:00:00").cast("timestamp")))
    day = F.to_date("exported_at").alias("day")
    return store.read(FACT_GOVERNANCE).select("snapshot_id", day, "proposals_total")


@query(
    "upsert_divergence",
    """
SELECT project_id, 'model-' || s_nationkey AS model, s_name AS task_key,
       CASE WHEN s_nationkey % 2 = 0 THEN 99 ELSE s_suppkey % 4 END AS divergent_traces, s_suppkey + 5 AS total_traces FROM doc""",
)
def upsert_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark, "store"))
    rows = governance_divergence(_documents(spark, sf_dir)).drop("_seq")
    store.upsert_governance_divergence(rows)
    even = rows.where(F.substring("model", 7, 20).cast("bigint") % 2 == 0)
    store.upsert_governance_divergence(even.withColumn("divergent_traces", F.lit(99).cast("bigint")))
    columns = ["project_id", "model", "task_key", "divergent_traces", "total_traces"]
    return store.read(FACT_GOVERNANCE_DIVERGENCE).select(*columns)


@query(
    "truncate_and_append",
    """
SELECT observation_id, strftime(start_time, '%Y-%m-%d') AS day, user_id
FROM (SELECT CAST(replace(observation_id, 'ev-', '') AS BIGINT) AS event_id, * FROM fact) WHERE event_id % 2 = 0""",
)
def truncate_and_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, then none, then those with even numbers."""
    store = Store(spark, scratch_dir(spark, "store"))
    facts = event_observations(spark, sf_dir)
    store.append(FACT_OBSERVATION, facts)
    store.truncate(FACT_OBSERVATION)
    store.append(FACT_OBSERVATION, facts.where(F.substring("observation_id", 4, 20).cast("bigint") % 2 == 0))
    return store.read(FACT_OBSERVATION).select("observation_id", "day", "user_id")


@query("sync_session_logs", QUESTIONS["ingest_session_logs"])
def synced_session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs through the batch sync, twice; the second run finds every call stored as it is."""
    root = land_session_logs(spark, sf_dir)
    store = Store(spark, scratch_dir(spark, "store"))
    for _ in range(2):
        sync_session_logs(spark, root, store, "part-*", as_of=AS_OF)
    return store.read(FACT_OBSERVATION).drop("day")


@query(
    "sync_governance",
    """
SELECT 'rule-' || s_suppkey AS rule_key, project_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ratified' ELSE 'proposed' END AS status,
       'model-' || s_nationkey AS model, s_suppkey % 4 AS divergent_traces FROM doc""",
)
def synced_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the batch sync, twice: policies beside the divergence rows of their task."""
    folder = f"{land_governance(spark, sf_dir)}/*/"
    store = Store(spark, scratch_dir(spark, "store"))
    for _ in range(2):
        sync_governance(spark, folder, store, AS_OF)
    policies = store.read(DIM_POLICY).select("rule_key", "project_id", "status", F.col("operator").alias("task_key"))
    rows = store.read(FACT_GOVERNANCE_DIVERGENCE).select("task_key", "model", "divergent_traces")
    return policies.join(rows, "task_key").drop("task_key")


@query(
    "register_users",
    """
SELECT user_id, max(team) AS team FROM (
  SELECT user_id, team FROM dim_user UNION ALL SELECT user_id, NULL FROM fact WHERE user_id IS NOT NULL) GROUP BY 1""",
)
def register_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark, "store"))
    store.append(DIM_USER, event_users(spark, sf_dir))
    store.register_users(event_observations(spark, sf_dir))
    store.register_users(event_observations(spark, sf_dir))
    return store.read(DIM_USER).select("user_id", "team")


@query(
    "schema_evolution",
    """
SELECT observation_id, CASE WHEN event_id % 2 = 1 THEN session_id END AS session_id
FROM (SELECT CAST(replace(observation_id, 'ev-', '') AS BIGINT) AS event_id, * FROM fact)""",
)
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written before a column existed read as NULL in it."""
    store = Store(spark, scratch_dir(spark, "store"))
    facts = event_observations(spark, sf_dir).withColumn("n", F.substring("observation_id", 4, 20).cast("bigint"))
    old = facts.where("n % 2 = 0").drop("session_id", "n").withColumn("day", F.to_date("start_time"))
    old.write.partitionBy("day").parquet(store.path(FACT_OBSERVATION))
    store.append(FACT_OBSERVATION, facts.where("n % 2 = 1").drop("n"))
    return store.read(FACT_OBSERVATION).select("observation_id", "session_id")


@query(
    "latest_by_key",
    f"""
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_partkey, l_suppkey, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate"),
        "l_partkey", "l_suppkey", "l_quantity",
    )
    return latest_by_key(
        lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    )


# -- streams ---------------------------------------------------------------------------


@query(
    "stream_observations",
    "SELECT " + _FACT.format(project_name="CAST(NULL AS VARCHAR)") + " FROM raw",
)
def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed files through the stream into an empty store."""
    landing = land_observations(spark, sf_dir)
    store = Store(spark, scratch_dir(spark, "store"))
    sync = start_observation_sync(
        spark, landing, store, scratch_dir(spark, "stream"), available_now=True
    )
    sync.awaitTermination()
    return store.read(FACT_OBSERVATION).drop("day")


@query(
    "stream_late_scores",
    """
SELECT score_id, trace_id, name, CASE WHEN CAST(replace(score_id, 'sc-', '') AS BIGINT) % 3 = 0 THEN 0.5 ELSE value END::DOUBLE AS value
FROM raw_score""",
)
def stream_late_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores through the stream; every third comes again later, in a new file, and replaces the first."""
    landing = land_scores(spark, sf_dir)
    store = Store(spark, scratch_dir(spark, "store"))
    checkpoint = scratch_dir(spark, "stream")
    start_score_sync(spark, landing, store, checkpoint, available_now=True).awaitTermination()
    late = spark.read.schema(RAW_SCORE).json(landing).where(F.substring("id", 4, 20).cast("bigint") % 3 == 0)
    late.withColumn("value", F.lit("0.5")).write.mode("append").json(landing)
    start_score_sync(spark, landing, store, checkpoint, available_now=True).awaitTermination()
    return store.read(FACT_SCORE).select("score_id", "trace_id", "name", "value")


@query("stream_late_traces", _ENRICHED)
def stream_late_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations through the stream with older rows of half the traces; the rest and the newer row of each come later."""
    landing, checkpoint = land_store_export(spark, sf_dir, "not-yet"), scratch_dir(spark, "stream")
    store = Store(spark, scratch_dir(spark, "store"))

    def arrive(traces: DataFrame) -> None:
        traces.write.mode("append").text(f"{landing}/traces", compression="gzip")

    older = spark.read.text(f"{landing}/not-yet/first")
    arrive(older.where(F.xxhash64("value") % 2 == 0))
    start_trace_store_sync(spark, landing, store, checkpoint, available_now=True).awaitTermination()
    arrive(older.where(F.xxhash64("value") % 2 != 0))
    arrive(spark.read.text(f"{landing}/not-yet/second"))
    start_trace_store_sync(spark, landing, store, checkpoint, available_now=True).awaitTermination()
    return store.read(FACT_OBSERVATION).select("observation_id", "user_id", "session_id", "environment", "tags")


@query(
    "stream_hourly_usage",
    f"""
, late AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN total_cost * 2 ELSE total_cost END AS total_cost,
                             CASE WHEN event_id % 50 = 49 THEN NULL ELSE start_time END AS start_time)
           FROM (SELECT CAST(replace(observation_id, 'ev-', '') AS BIGINT) AS event_id, * FROM fact))
SELECT strftime(date_trunc('hour', start_time), {STAMP}) AS hour, coalesce(project_name, project_id, '(unknown)') AS project_name,
       count(*) AS observations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(total_cost) AS DOUBLE) AS total_cost
FROM late GROUP BY date_trunc('hour', start_time), 2""",
)
def stream_hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly roll-up after rows that are sent twice, late corrections, and rows without a time."""
    store = Store(spark, scratch_dir(spark, "store"))
    number = F.substring("observation_id", 4, 20).cast("bigint")
    facts = event_observations(spark, sf_dir)
    facts = facts.withColumn("start_time", F.when(number % 50 != 49, F.col("start_time")))
    store.refresh_usage_hourly()
    store.upsert_observations(facts, AS_OF)
    late = F.when(number % 7 == 0, F.col("total_cost") * 2).otherwise(F.col("total_cost"))
    store.upsert_observations(facts.withColumn("total_cost", late.cast(MONEY)), AS_OF)
    return mrt_hourly_usage(store.tables())


@query(
    "stream_daily_mart",
    """
SELECT strftime(CAST(s.start_time AS DATE), '%Y-%m-%d') AS day, coalesce(s.project_name, s.project_id, '(unknown)') AS project_name,
       coalesce(nullif(u.team, ''), 'Unassigned') AS team, count(*) AS observations,
       CAST(sum(s.total_tokens) AS BIGINT) AS total_tokens, CAST(sum(s.total_cost) AS DOUBLE) AS total_cost
FROM stored s LEFT JOIN dim_user u ON u.user_id = s.user_id GROUP BY CAST(s.start_time AS DATE), 2, 3""",
)
def stream_daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored roll-up after a first load and late corrections that move days."""
    store = Store(spark, scratch_dir(spark, "store"))
    facts = event_observations(spark, sf_dir)
    store.append(DIM_USER, event_users(spark, sf_dir))
    store.refresh_usage_daily()
    store.upsert_observations(facts, AS_OF)
    store.upsert_observations(_corrections(facts), AS_OF)
    return (
        mrt_daily_usage(store.tables())
        .groupBy("day", "project_name", "team")
        .agg(
            F.sum("observations").alias("observations"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost").alias("total_cost"),
        )
    )


# -- stored roll-ups -----------------------------------------------------------------------

CTE["stored_sessions"] = """
SELECT coalesce(session_id, trace_id) AS session_id, coalesce(user_id, '(unattributed)') AS user_id,
       coalesce(project_name, project_id, '(unknown)') AS project_name, min(start_time) AS first_seen, max(start_time) AS last_seen,
       count(DISTINCT trace_id) AS turns, count(*) AS observations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       sum(total_cost) AS total_cost
FROM stored GROUP BY 1, 2, 3"""


def _corrected_store(spark: SparkSession, sf_dir: str, *rollups: str) -> Store:
    """A store with some roll-ups, filled by a first load and by late corrections that move days."""
    store = Store(spark, scratch_dir(spark, "store"))
    facts = event_observations(spark, sf_dir)
    for rollup in rollups:
        getattr(store, f"refresh_{rollup}")()
    store.upsert_observations(facts, AS_OF)
    store.upsert_observations(_corrections(facts), AS_OF)
    return store


@query(
    "rollup_session",
    f"""
SELECT * REPLACE (strftime(first_seen, {STAMP}) AS first_seen, strftime(last_seen, {STAMP}) AS last_seen,
                  CAST(total_cost AS DOUBLE) AS total_cost) FROM stored_sessions""",
)
def rollup_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from the stored usage by trace."""
    return mrt_session(_corrected_store(spark, sf_dir, "usage_traces").tables())


@query(
    "rollup_session_stats",
    f"""
SELECT count(*) AS sessions, round(sum(input_tokens)::DOUBLE / count(input_tokens), 1) AS avg_context_tokens,
       round(sum(turns)::DOUBLE / count(turns), 1) AS avg_turns, round(sum(total_cost)::DOUBLE / count(total_cost), 4) AS avg_cost,
       round(sum(input_tokens)::DOUBLE / nullif(sum(turns), 0)::DOUBLE, 1) AS avg_input_per_turn
FROM stored_sessions WHERE last_seen >= TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL 30 DAY""",
)
def rollup_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over recent sessions from the stored usage by trace; no fact is read."""
    return kpi_session_stats(_corrected_store(spark, sf_dir, "usage_traces").tables(), 30, AS_OF)


@query(
    "rollup_exact_traces",
    """
SELECT strftime(CAST(start_time AS DATE), '%Y-%m-%d') AS day, count(*) AS observations, count(DISTINCT trace_id) AS traces_distinct
FROM stored GROUP BY CAST(start_time AS DATE)""",
)
def rollup_exact_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with their true numbers of traces, from two stored roll-ups."""
    store = _corrected_store(spark, sf_dir, "usage_daily", "usage_traces")
    daily = mrt_org_daily(store.tables(), exact_traces=True)
    return daily.select("day", "observations", "traces_distinct")


@query(
    "rollup_model_daily",
    """
SELECT strftime(CAST(start_time AS DATE), '%Y-%m-%d') AS day, coalesce(model, '(unknown)') AS model,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DOUBLE) AS total_cost,
       avg(latency_ms) AS avg_latency_ms,
       round(sum(cached_input_tokens)::DOUBLE / nullif(sum(input_tokens), 0)::DOUBLE, 4) AS cache_hit_rate
FROM stored GROUP BY CAST(start_time AS DATE), 2""",
)
def rollup_model_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency by day and model from the stored sums."""
    daily = mrt_model_daily(_corrected_store(spark, sf_dir, "usage_models").tables())
    return daily.select("day", "model", "total_tokens", "total_cost", "avg_latency_ms", "cache_hit_rate")
