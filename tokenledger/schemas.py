"""Fixed table schemas, their keys and the day column they are partitioned by.

Nothing is inferred on read: a stored file that lacks a column added later
reads as NULL in that column, which is the whole of the additive migration.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Cheap models cost well under a millionth of a dollar a call, so amounts keep twelve digits and are rounded only where
# they leave a question. An amount of a trillion or more, or one that is no number, is NULL.
MONEY = T.DecimalType(24, 12)
MONEY_SUM = T.DecimalType(34, 12)

_TYPES = {
    "text": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "money": MONEY,
    "money_sum": MONEY_SUM,
    "ts": T.TimestampType(),
    "date": T.DateType(),
    "json": T.VariantType(),
}


def struct_of(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in columns.items()])


@dataclass(frozen=True)
class TableSpec:
    """A stored table: columns, upsert key and (for facts) the event time.

    A table with an event time is stored partitioned by ``day``, the UTC date
    of that time. Within a file rows are sorted by ``cluster``, so that filters
    on those columns skip row groups and repeated values compress.
    """

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    event_time: str | None = None
    cluster: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def stored_schema(self) -> T.StructType:
        if self.event_time is None:
            return self.schema
        return T.StructType([*self.schema.fields, T.StructField("day", T.DateType(), True)])


FACT_OBSERVATION = TableSpec(
    "fact_observation",
    struct_of(
        observation_id="text",
        trace_id="text",
        project_id="text",
        project_name="text",
        user_id="text",
        session_id="text",
        model="text",
        type="text",
        name="text",
        environment="text",
        start_time="ts",
        end_time="ts",
        latency_ms="double",
        input_tokens="bigint",
        output_tokens="bigint",
        total_tokens="bigint",
        cached_input_tokens="bigint",
        reasoning_tokens="bigint",
        input_cost="money",
        output_cost="money",
        total_cost="money",
        level="text",
        status_message="text",
        tags="text",
    ),
    ("observation_id",),
    "start_time",
    ("project_id", "model", "user_id"),
)

FACT_SCORE = TableSpec(
    "fact_score",
    struct_of(
        score_id="text",
        trace_id="text",
        observation_id="text",
        project_id="text",
        project_name="text",
        name="text",
        value="double",
        source="text",
        timestamp="ts",
    ),
    ("score_id",),
    "timestamp",
)

DIM_USER = TableSpec(
    "dim_user",
    struct_of(user_id="text", display_name="text", team="text", department="text"),
    ("user_id",),
)

BUDGET = TableSpec(
    "budget",
    struct_of(scope_type="text", scope_id="text", period="text", budget_usd="double"),
    ("scope_type", "scope_id", "period"),
)

MODEL_PRICES = TableSpec(
    "model_prices",
    struct_of(
        model="text",
        input_hit_per_1m="double",
        input_miss_per_1m="double",
        output_per_1m="double",
    ),
    ("model",),
)

TARGETS = TableSpec(
    "targets",
    struct_of(metric="text", op="text", threshold="double", label="text"),
    ("metric",),
)

SYNC_STATE = TableSpec("sync_state", struct_of(key="text", value="text", updated_at="ts"), ("key",))

DIM_POLICY = TableSpec(
    "dim_policy",
    struct_of(
        rule_key="text",
        project_id="text",
        kind="text",
        status="text",
        confidence="double",
        promoted_at="ts",
        operator="text",
        evidence_traces="bigint",
    ),
    ("rule_key",),
)

FACT_GOVERNANCE = TableSpec(
    "fact_governance",
    struct_of(
        snapshot_id="text",
        project_id="text",
        exported_at="ts",
        ttrp_ms="double",
        precision14_numerator="bigint",
        precision14_denominator="bigint",
        precision14_ratio="double",
        proposals_total="bigint",
        proposals_pending="bigint",
        proposals_ratified="bigint",
        proposals_rejected="bigint",
        proposals_decayed="bigint",
    ),
    ("snapshot_id",),
)

FACT_GOVERNANCE_DIVERGENCE = TableSpec(
    "fact_governance_divergence",
    struct_of(
        project_id="text",
        model="text",
        task_key="text",
        divergent_traces="bigint",
        total_traces="bigint",
    ),
    ("project_id", "model", "task_key"),
)

# The stored roll-up behind the daily mart. Teams are left out on purpose: they
# are joined on read, so re-assigning a user takes effect without a rebuild.
USAGE_DAILY = TableSpec(
    "usage_daily",
    struct_of(
        day="date",
        project_id="text",
        project_name="text",
        user_id="text",
        model="text",
        observations="bigint",
        traces="bigint",
        input_tokens="bigint",
        output_tokens="bigint",
        total_tokens="bigint",
        cached_input_tokens="bigint",
        reasoning_tokens="bigint",
        input_cost="money_sum",
        output_cost="money_sum",
        total_cost="money_sum",
    ),
    ("day", "project_id", "project_name", "user_id", "model"),
)

# The stored roll-up behind the hourly mart.
USAGE_HOURLY = TableSpec(
    "usage_hourly",
    struct_of(
        hour="ts",
        project_name="text",
        observations="bigint",
        input_tokens="bigint",
        output_tokens="bigint",
        total_tokens="bigint",
        total_cost="money_sum",
    ),
    ("hour", "project_name"),
    "hour",
)

# The stored roll-up behind sessions and exact trace counts: a session is merged over its days, and a trace counts once
# however many days and users it spans.
USAGE_TRACES = TableSpec(
    "usage_traces",
    struct_of(
        day="date",
        session_id="text",
        user_id="text",
        project_name="text",
        trace_id="text",
        first_seen="ts",
        last_seen="ts",
        observations="bigint",
        input_tokens="bigint",
        output_tokens="bigint",
        total_tokens="bigint",
        total_cost="money_sum",
    ),
    ("day", "session_id", "user_id", "project_name", "trace_id"),
)

# The stored roll-up behind model efficiency; the mean latency is the quotient of two sums.
USAGE_MODELS = TableSpec(
    "usage_models",
    struct_of(
        day="date",
        model="text",
        input_tokens="bigint",
        output_tokens="bigint",
        total_tokens="bigint",
        cached_input_tokens="bigint",
        reasoning_tokens="bigint",
        total_cost="money_sum",
        latency_sum="double",
        latency_count="bigint",
    ),
    ("day", "model"),
)

ROLLUPS = (USAGE_DAILY, USAGE_HOURLY, USAGE_TRACES, USAGE_MODELS)

# Landed files that syncs have seen, with the event times they hold.
#: Traces as landed, the newest row of each, for streams to take context from.
STORED_TRACE = TableSpec(
    "stored_trace",
    struct_of(id="text", userId="text", sessionId="text", environment="text", tags="text", timestamp="text", at="ts"),
    ("id",),
    event_time="at",
    cluster=("id",),
)
LANDED_FILE = TableSpec(
    "landed_file",
    struct_of(file="text", length="bigint", modified="ts", least="ts", greatest="ts", rows="bigint"),
    ("file", "length", "modified"),
)

TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        FACT_OBSERVATION,
        FACT_SCORE,
        DIM_USER,
        BUDGET,
        MODEL_PRICES,
        TARGETS,
        SYNC_STATE,
        DIM_POLICY,
        FACT_GOVERNANCE,
        FACT_GOVERNANCE_DIVERGENCE,
    )
}

# ---------------------------------------------------------------------------
# Raw (landed) shapes. Scalars are read as text and cast later: the JSON reader
# hands over an object's own text for a string-typed field, so one schema covers
# "object", "text holding an object" and "number" alike. Prompt and completion
# bodies are not listed and so are never parsed.
# ---------------------------------------------------------------------------

RAW_OBSERVATION = struct_of(
    id="text",
    traceId="text",
    projectId="text",
    userId="text",
    sessionId="text",
    model="text",
    type="text",
    name="text",
    environment="text",
    startTime="text",
    endTime="text",
    usageDetails="text",
    costDetails="text",
    totalCost="text",
    level="text",
    statusMessage="text",
    tags="text",
)

RAW_STORE_OBSERVATION = struct_of(
    id="text",
    trace_id="text",
    project_id="text",
    type="text",
    name="text",
    provided_model_name="text",
    internal_model_id="text",
    start_time="text",
    end_time="text",
    usage_details="text",
    cost_details="text",
    total_cost="text",
    level="text",
    status_message="text",
    environment="text",
)

RAW_SCORE = T.StructType(
    [
        *struct_of(
            id="text",
            traceId="text",
            observationId="text",
            projectId="text",
            name="text",
            value="text",
            source="text",
            timestamp="text",
        ).fields,
        T.StructField("subject", struct_of(kind="text", id="text", traceId="text"), True),
    ]
)

RAW_STORE_SCORE = struct_of(
    id="text",
    trace_id="text",
    observation_id="text",
    project_id="text",
    name="text",
    value="text",
    source="text",
    timestamp="text",
)

RAW_TRACE = struct_of(
    id="text", userId="text", sessionId="text", environment="text", tags="text", timestamp="text"
)

RAW_STORE_TRACE = struct_of(
    id="text", user_id="text", session_id="text", environment="text", tags="text", timestamp="text"
)

# Counts are read as doubles, because a fraction would spoil an integer field; they are truncated later.
SESSION_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("time", T.DoubleType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "usage",
                        struct_of(
                            inputTokens="double",
                            outputTokens="double",
                            reasoningTokens="double",
                            cacheReadTokens="double",
                        ),
                    ),
                    T.StructField(
                        "message",
                        T.StructType([T.StructField("source", struct_of(model="text"))]),
                    ),
                ]
            ),
        ),
    ]
)

GOVERNANCE_DOCUMENT = T.StructType(
    [
        T.StructField("version", T.VariantType()),
        T.StructField("project", struct_of(id="text", name="text")),
        T.StructField("exportedAt", T.StringType()),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("ttrpMs", T.VariantType()),
                    T.StructField(
                        "precision14", struct_of(numerator="json", denominator="json", ratio="json")
                    ),
                    T.StructField(
                        "proposals",
                        struct_of(
                            total="json",
                            pending="json",
                            ratified="json",
                            rejected="json",
                            decayed="json",
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "policies",
            T.ArrayType(
                struct_of(
                    ruleKey="text",
                    kind="text",
                    status="text",
                    confidence="json",
                    promotedAt="text",
                    operator="text",
                    evidenceTraces="json",
                )
            ),
        ),
        T.StructField(
            "divergence",
            T.ArrayType(
                struct_of(model="text", taskKey="text", divergentTraces="json", totalTraces="json")
            ),
        ),
    ]
)
