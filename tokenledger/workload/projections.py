"""The driver's tables seen as cost telemetry.

``events`` becomes observations, scores, users and governance snapshots;
``part`` and ``supplier`` the policy registry and the divergence counts;
``orders`` and ``lineitem`` longer and larger observation sets.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.reference_data import DEFAULT_TARGETS
from tokenledger.schemas import BUDGET, FACT_OBSERVATION, TARGETS
from tokenledger.session import pin_utc
from tokenledger.tables import Tables

# Questions over events are asked two days before the data ends, so rows later
# than the asking time are part of every check.
AS_OF = datetime(2024, 1, 28, 12, tzinfo=timezone.utc)
AS_OF_LONG = datetime(2001, 8, 2, tzinfo=timezone.utc)

# The files carry zone-less timestamps. Reading them as UTC instants through the
# schema, not through a cast, keeps time filters pushable.
_SCHEMAS = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, "
    "value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _observations(source: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Observation facts from SQL expressions; anything not given is NULL."""
    out = []
    for field in FACT_OBSERVATION.schema.fields:
        expression = columns.get(field.name, "NULL")
        out.append(F.expr(expression).cast(field.dataType).alias(field.name))
    return source.select(*out)


EVENT_OBSERVATION = {
    "observation_id": "concat('ev-', event_id)",
    "trace_id": "concat('tr-', user_id, '-', CAST(ts AS DATE), '-', event_id % 3)",
    "project_id": "CASE user_id % 4 WHEN 3 THEN NULL ELSE concat('p', user_id % 4) END",
    "project_name": "CASE user_id % 4 WHEN 0 THEN 'App' WHEN 2 THEN 'Docs' END",
    "user_id": "CASE WHEN user_id % 10 <> 0 THEN concat('u', user_id) END",
    "session_id": "CASE WHEN event_id % 5 <> 0 "
    "THEN concat('se-', user_id, '-', CAST(ts AS DATE)) END",
    "model": "CASE event_type WHEN 'click' THEN 'model-a' WHEN 'view' THEN 'model-b' "
    "WHEN 'purchase' THEN 'model-c' WHEN 'error' THEN 'model-z' END",
    "type": "'GENERATION'",
    "name": "'chat'",
    "environment": "'production'",
    "start_time": "ts",
    "end_time": "ts",
    "latency_ms": "CASE WHEN event_type <> 'error' THEN k * 100 END",
    "input_tokens": "CASE event_type WHEN 'error' THEN 0 ELSE 200 + k * 40 END",
    "output_tokens": "CASE event_type WHEN 'error' THEN 0 ELSE 50 + event_id % 30 * 10 END",
    "total_tokens": "CASE event_type WHEN 'error' THEN 0 "
    "ELSE 250 + k * 40 + event_id % 30 * 10 END",
    "cached_input_tokens": "CASE WHEN event_type IN ('click', 'view') THEN k * 10 ELSE 0 END",
    "reasoning_tokens": "CASE event_type WHEN 'purchase' THEN event_id % 7 * 10 ELSE 0 END",
    "input_cost": "CAST(value AS DECIMAL(18, 6)) * 0.25",
    "output_cost": "CAST(value AS DECIMAL(18, 6)) * 0.75",
    "total_cost": "value",
    "level": "'DEFAULT'",
}


def with_k(events: DataFrame, spread: bool = True) -> DataFrame:
    """Events over some four months, so that every window has rows on both sides, and with one day of high cost;
    without ``spread`` as they are, all within a month."""
    if spread:
        moved = F.expr("ts - make_dt_interval(CAST(event_id % 5 AS INT) * 25)")
        value = F.expr("CASE WHEN CAST(ts AS DATE) = DATE '2024-01-17' THEN value * 8 ELSE value END")
        events = events.withColumn("ts", moved).withColumn("value", value)
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))


def event_observations(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    return _observations(with_k(table(spark, sf_dir, "events"), spread), EVENT_OBSERVATION)


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(
        table(spark, sf_dir, "orders"),
        {
            "observation_id": "concat('or-', o_orderkey)",
            "trace_id": "concat('or-', o_orderkey)",
            "project_id": "o_orderpriority",
            "user_id": "concat('c', o_custkey)",
            "model": "o_orderstatus",
            "start_time": "o_orderdate",
            "input_tokens": "0",
            "output_tokens": "0",
            "total_tokens": "0",
            "cached_input_tokens": "0",
            "reasoning_tokens": "0",
            "total_cost": "o_totalprice",
        },
    )


LINE_COST = "CAST(l_extendedprice AS DECIMAL(18, 6)) * (1 - CAST(l_discount AS DECIMAL(18, 6)))"


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume set: one observation per line item, user and project from its order."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")
    )
    return _observations(
        lines,
        {
            "trace_id": "concat('or-', l_orderkey)",
            "project_id": "o_orderpriority",
            "user_id": "concat('c', o_custkey)",
            "model": "concat(l_returnflag, l_linestatus)",
            "start_time": "l_shipdate",
            "input_tokens": "CAST(l_quantity AS BIGINT) * 100",
            "output_tokens": "CAST(l_quantity AS BIGINT) * 10",
            "total_tokens": "CAST(l_quantity AS BIGINT) * 110",
            "cached_input_tokens": "l_linenumber * 10",
            "reasoning_tokens": "0",
            "total_cost": LINE_COST,
        },
    )


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            # Some users of the facts are unknown here, and some here never appear in the facts.
            "concat(CASE user_id % 8 WHEN 5 THEN 'idle-' ELSE 'u' END, user_id) AS user_id",
            "CAST(NULL AS STRING) AS display_name",
            "CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Platform' WHEN 2 THEN 'Product' "
            "WHEN 3 THEN 'Support' WHEN 5 THEN 'Research' END AS team",
            "CAST(NULL AS STRING) AS department",
        )
        .distinct()
    )


def event_scores(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """A score for every event. Those of some users are of traces that the facts do not have."""
    return (
        with_k(table(spark, sf_dir, "events"), spread)
        .selectExpr(
            "concat('sc-', event_id) AS score_id",
            f"concat(CASE user_id % 3 WHEN 0 THEN 'other-' ELSE '' END, {EVENT_OBSERVATION['trace_id']}) AS trace_id",
            "concat('ev-', event_id) AS observation_id",
            f"{EVENT_OBSERVATION['project_id']} AS project_id",
            f"{EVENT_OBSERVATION['project_name']} AS project_name",
            "CASE event_id % 2 WHEN 0 THEN 'correctness' ELSE 'helpfulness' END AS name",
            "CASE WHEN k <> 13 THEN k / 100.0D END AS value",
            "'API' AS source",
            "ts AS timestamp",
        )
    )


def event_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        with_k(table(spark, sf_dir, "events"))
        .selectExpr(
            "concat('sn-', event_id) AS snapshot_id",
            "concat('g', user_id % 2) AS project_id",
            "ts AS exported_at",
            "CAST(CASE WHEN k % 9 <> 0 THEN k * 1000 END AS DOUBLE) AS ttrp_ms",
            "k % 5 AS precision14_numerator",
            "5 + k % 3 AS precision14_denominator",
            "CAST(k % 5 AS DOUBLE) / (5 + k % 3) AS precision14_ratio",
            "k % 20 + 10 AS proposals_total",
            "k % 20 AS proposals_pending",
            "6L AS proposals_ratified",
            "3L AS proposals_rejected",
            "1L AS proposals_decayed",
        )
    )


def part_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('rule-', p_partkey) AS rule_key",
        "concat('g', p_partkey % 2) AS project_id",
        "p_brand AS kind",
        "CASE WHEN p_partkey % 6 = 5 THEN 'proposed' ELSE 'ratified' END AS status",
        "p_size % 10 / 10.0D AS confidence",
        "timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00') AS promoted_at",
        "concat('reviewer-', p_size % 3) AS operator",
        "CAST(p_size * 3 AS BIGINT) AS evidence_traces",
    )


def supplier_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('g', s_suppkey % 2) AS project_id",
        "concat('model-', s_nationkey) AS model",
        "s_name AS task_key",
        "s_suppkey % 4 AS divergent_traces",
        "CASE WHEN s_suppkey % 7 = 0 THEN 0L ELSE s_suppkey + 5 END AS total_traces",
    )


BUDGETS = [("global", "*", "monthly", 500000.0), ("team", "Platform", "monthly", 4000.0)]
# Beyond the default targets: one with another comparison, one without a current value.
TARGET_ROWS = [
    (m, "eq" if m == "output_input_ratio" else op, t, label) for m, op, t, label in DEFAULT_TARGETS
] + [("unheard_of", "gte", 1.0, "Not a known metric")]


def event_tables(spark: SparkSession, sf_dir: str, spread: bool = True) -> Tables:
    """The standard workload."""
    return Tables(
        spark,
        {
            "fact_observation": lambda: event_observations(spark, sf_dir, spread),
            "fact_score": lambda: event_scores(spark, sf_dir, spread),
            "dim_user": lambda: event_users(spark, sf_dir),
            "fact_governance": lambda: event_governance(spark, sf_dir),
            "dim_policy": lambda: part_policies(spark, sf_dir),
            "fact_governance_divergence": lambda: supplier_divergence(spark, sf_dir),
            "budget": lambda: spark.createDataFrame(BUDGETS, BUDGET.schema),
            "targets": lambda: spark.createDataFrame(TARGET_ROWS, TARGETS.schema),
        },
    )


def order_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The long series: 1995 to 2001."""
    return Tables(spark, {"fact_observation": lambda: order_observations(spark, sf_dir)})


def line_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The volume set."""
    return Tables(spark, {"fact_observation": lambda: line_observations(spark, sf_dir)})
