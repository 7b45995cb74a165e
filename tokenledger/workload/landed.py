"""Raw files that Spark derives from the driver's tables, for the ingest queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.session import scratch_dir
from tokenledger.workload.projections import EVENT_OBSERVATION, table, with_k

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _columns(rows: DataFrame, **expressions: str | Column) -> DataFrame:
    return rows.select(
        *((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in expressions.items())
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw observations with every quirk ingest must handle.

    Usage is an object for even ids and text for odd ones; cache tokens come
    under three spellings; totals, ends and total costs go missing in turn.
    Some amounts are far below a millionth.
    """
    events = with_k(table(spark, sf_dir, "events")).withColumn(
        "value", F.expr("CASE WHEN event_id % 11 = 3 THEN 4E-7D ELSE value END")
    )
    usage = F.expr(
        "named_struct('input', 200 + k * 40, 'output', 50 + event_id % 30 * 10, "
        "'total', CASE WHEN event_id % 3 = 0 THEN 0 ELSE 300 + k * 40 + event_id % 30 * 10 END, "
        "'cachedInput', k, 'cacheReadInput', 2, 'cache_read_input_tokens', '4', "
        "'reasoning', CASE WHEN event_id % 4 = 0 THEN 0 ELSE 3 END, 'reasoningTokens', 9)"
    )
    cost = F.expr("named_struct('input', value / 4, 'output', value / 2)")
    return _columns(
        events,
        event_id="event_id",
        id="concat('ev-', event_id)",
        traceId=EVENT_OBSERVATION["trace_id"],
        projectId="CASE WHEN event_id % 2 = 1 THEN concat('own-', user_id % 4) END",
        project="concat('src-', user_id % 3)",
        userId=EVENT_OBSERVATION["user_id"],
        sessionId=EVENT_OBSERVATION["session_id"],
        model="event_type",
        type="'GENERATION'",
        name="'chat'",
        environment="CASE WHEN event_id % 9 = 0 THEN '' ELSE 'production' END",
        startTime=F.when(F.expr("event_id % 50 <> 49"), F.date_format("ts", ISO)).otherwise("not a time"),
        endTime=F.expr(f"CASE WHEN event_id % 7 <> 0 THEN date_format(ts + make_dt_interval(0, 0, 0, k / 1000.0), \"{ISO}\") END"),
        usage=usage,
        cost=cost,
        totalCost="CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END",
        level="'DEFAULT'",
        statusMessage="CASE WHEN event_type = 'error' THEN 'failed' END",
        tags="CASE WHEN event_id % 6 = 0 THEN array('a', 'b') END",
    )


_PLAIN = (
    "id", "traceId", "projectId", "userId", "sessionId", "model", "type", "name", "environment",
    "startTime", "endTime", "totalCost", "level", "statusMessage", "tags",
)


def land_observations(spark: SparkSession, sf_dir: str) -> str:
    raw = raw_observations(spark, sf_dir)
    as_object = F.to_json(F.struct(*_PLAIN, F.col("usage").alias("usageDetails"), F.col("cost").alias("costDetails")))
    as_text = F.to_json(
        F.struct(*_PLAIN, F.to_json("usage").alias("usageDetails"), F.to_json("cost").alias("costDetails"))
    )
    path = scratch_dir(spark, "landed-observations")
    lines = raw.select("project", F.when(F.col("event_id") % 2 == 0, as_object).otherwise(as_text).alias("value"))
    lines.write.partitionBy("project").text(path)
    return path


def land_scores(spark: SparkSession, sf_dir: str) -> str:
    """Scores in three shapes: flat, nested under an observation, nested under a trace."""
    events = with_k(table(spark, sf_dir, "events"))
    shaped = _columns(
        events,
        event_id="event_id",
        id="concat('sc-', event_id)",
        name="CASE event_id % 2 WHEN 0 THEN 'correctness' ELSE 'helpfulness' END",
        value="CASE WHEN k = 13 THEN NULL ELSE k / 100.0D END",
        source="'API'",
        timestamp=F.date_format("ts", ISO),
        trace=EVENT_OBSERVATION["trace_id"],
        observation="concat('ev-', event_id)",
    )
    common = ("id", "name", "value", "source", "timestamp")
    flat = F.struct(*common, F.col("trace").alias("traceId"), F.col("observation").alias("observationId"))

    def nested(kind: str) -> Column:
        subject = F.struct(F.lit(kind).alias("kind"), F.col("observation").alias("id"), F.col("trace").alias("traceId"))
        return F.struct(*common, subject.alias("subject"))

    line = (
        F.when(F.expr("event_id % 4 = 1"), F.to_json(flat))
        .when(F.expr("event_id % 4 = 2"), F.to_json(nested("OBSERVATION")))
        .otherwise(F.to_json(nested("TRACE")))
    )
    path = scratch_dir(spark, "landed-scores")
    shaped.select(line.alias("value")).write.text(path)
    return path


def land_store_scores(spark: SparkSession, sf_dir: str) -> str:
    """Scores as a trace store exports them: flat, in snake case."""
    path = scratch_dir(spark, "landed-store-scores")
    _columns(
        with_k(table(spark, sf_dir, "events")),
        id="concat('sc-', event_id)",
        trace_id=EVENT_OBSERVATION["trace_id"],
        observation_id="CASE WHEN event_id % 4 = 1 THEN concat('ev-', event_id) WHEN event_id % 4 = 3 THEN '' END",
        project_id="concat('src-', user_id % 3)",
        name="CASE event_id % 2 WHEN 0 THEN 'correctness' ELSE 'helpfulness' END",
        value="CASE WHEN k = 13 THEN NULL ELSE k / 100.0D END",
        source="'API'",
        timestamp=F.date_format("ts", ISO),
    ).write.json(path)
    return path


def land_store_export(spark: SparkSession, sf_dir: str, traces_in: str = "traces") -> str:
    """A trace-store export: observations in snake case, and their traces in the folder ``traces_in`` beside them.

    Each trace appears twice. The later row, in the file of later time, has the
    context; every fifth trace has none. The lines repeat their field names, so files are compressed.
    """
    raw = raw_observations(spark, sf_dir)
    root = scratch_dir(spark, "landed-store")
    _columns(
        raw,
        id="id",
        trace_id="CASE WHEN event_id % 11 = 0 THEN '' ELSE traceId END",
        project_id="project",
        type="type",
        name="name",
        provided_model_name="CASE WHEN event_id % 3 = 0 THEN '' ELSE model END",
        internal_model_id="CASE WHEN event_id % 6 <> 0 THEN concat('internal-', model) END",
        start_time="startTime",
        end_time="endTime",
        usage_details="usage",
        cost_details="cost",
        total_cost="totalCost",
        level="level",
        status_message="statusMessage",
        environment="environment",
    ).write.json(f"{root}/observations", compression="gzip")
    traces = raw.groupBy(F.col("traceId").alias("id")).agg(
        F.max("userId").alias("user_id"),
        F.max("sessionId").alias("session_id"),
        F.min("startTime").alias("timestamp"),
        F.max("event_id").alias("n"),
    )
    older = _columns(traces, id="id", user_id="'stale'", environment="'stale'", timestamp="timestamp")
    older.write.json(f"{root}/{traces_in}/first", compression="gzip")
    newer = _columns(
        traces,
        id="id",
        user_id="CASE WHEN n % 5 = 0 THEN '' ELSE user_id END",
        session_id="session_id",
        environment="'from-trace'",
        tags="array(id)",
        timestamp="timestamp",
    )
    newer.write.json(f"{root}/{traces_in}/second", compression="gzip")
    return root


def land_session_logs(spark: SparkSession, sf_dir: str) -> str:
    """One log per user: session events, usable and unusable messages, noise.

    ``{root}/project=<slug>/session=<user>/part-*``; lines are in event order.
    """
    events = with_k(table(spark, sf_dir, "events"))
    time = F.expr("CASE WHEN event_id % 13 = 0 THEN 0 ELSE unix_millis(ts) END")
    session = F.struct(
        F.lit("session").alias("type"),
        F.expr("concat('s', user_id, '-', event_id)").alias("id"),
        time.alias("time"),
    )
    usage = F.expr(
        "named_struct('inputTokens', CASE WHEN event_type = 'error' THEN 0 ELSE 20 + k END, "
        "'outputTokens', CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 30 END, "
        "'reasoningTokens', event_id % 3, 'cacheReadTokens', k * 2)"
    )
    model = F.expr(
        "CASE event_type WHEN 'click' THEN 'deepseek-v4-pro' WHEN 'view' THEN 'deepseek-v4-flash' "
        "WHEN 'signup' THEN 'unpriced' END"
    )
    message = F.struct(
        F.lit("assistant/message").alias("type"),
        time.alias("time"),
        F.struct(
            usage.alias("usage"),
            F.struct(F.struct(model.alias("model")).alias("source")).alias("message"),
        ).alias("data"),
    )
    lines = events.select(
        "event_id",
        F.expr("concat('-home-dev-project-', user_id % 3)").alias("project"),
        F.expr("concat('dir', user_id)").alias("session"),
        F.when(F.expr("event_id % 17 = 0"), F.to_json(session))
        .when(F.expr("event_id % 19 = 0"), F.lit("not json {"))
        .otherwise(F.to_json(message))
        .alias("value"),
    )
    root = scratch_dir(spark, "session-logs")
    (
        lines.repartition("project", "session")
        .sortWithinPartitions("project", "session", "event_id")
        .drop("event_id")
        .write.partitionBy("project", "session")
        .text(root)
    )
    return root


def land_governance(spark: SparkSession, sf_dir: str) -> str:
    """One export document per five suppliers, with five policies and divergence rows each.

    Every seventh document is of another version; every fourth has no project id.
    """
    suppliers = table(spark, sf_dir, "supplier").withColumn("doc", F.expr("s_suppkey div 5"))
    policy = F.expr(
        "named_struct('ruleKey', concat('rule-', s_suppkey), 'kind', 'tool-choice', "
        "'status', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'proposed' END, "
        "'confidence', s_suppkey % 10 / 10.0D, 'promotedAt', '2024-01-05T10:00:00.000Z', "
        "'operator', s_name, 'evidenceTraces', s_suppkey)"
    )
    divergence = F.expr(
        "named_struct('model', concat('model-', s_nationkey), 'taskKey', s_name, "
        "'divergentTraces', s_suppkey % 4, 'totalTraces', s_suppkey + 5)"
    )
    documents = suppliers.groupBy("doc").agg(
        F.collect_list(policy).alias("policies"), F.collect_list(divergence).alias("divergence")
    )
    rows = documents.select(
        "doc",
        F.expr("CASE WHEN doc % 7 = 6 THEN 2 ELSE 1 END").alias("version"),
        F.expr("named_struct('id', CASE WHEN doc % 4 <> 3 THEN concat('prj-', doc) END)").alias("project"),
        F.expr("concat('2024-01-', lpad(CAST(doc % 28 + 1 AS STRING), 2, '0'), 'T12:00:00.000Z')").alias("exportedAt"),
        F.expr(
            "named_struct('ttrpMs', CASE WHEN doc % 5 <> 0 THEN doc * 1000 END, "
            "'precision14', named_struct('numerator', doc % 3, 'denominator', 3, 'ratio', doc % 3 / 4.0D), "
            "'proposals', named_struct('total', doc + 4, 'pending', doc, 'ratified', 2, 'rejected', 1, 'decayed', 1))"
        ).alias("metrics"),
        "policies",
        "divergence",
    )
    root = scratch_dir(spark, "governance")
    rows.write.partitionBy("doc").json(root)
    return root
