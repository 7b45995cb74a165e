import re

"""Hot keys: a third of the rows on one key, joins forced to shuffle, results against plain loops."""

import pytest
from pyspark.sql import functions as F

from tokenledger.operators.enrich import CONTEXT, enrich_from_traces
from tokenledger.plans import kpis
from tokenledger.schemas import FACT_OBSERVATION, FACT_SCORE, RAW_OBSERVATION, RAW_TRACE
from tokenledger.tables import Tables
from tests.test_store import observations

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16kb",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def shuffled(spark):
    before = {k: spark.conf.get(k) for k in SHUFFLED if spark.conf.get(k, None) is not None}
    for k, v in SHUFFLED.items():
        spark.conf.set(k, v)
    yield spark
    for k in SHUFFLED:
        if k in before:
            spark.conf.set(k, before[k])
        else:
            spark.conf.unset(k)


def trace_of(i):
    return "hot" if i % 3 == 0 else None if i % 3 == 1 else f"t{i % 50}"


def test_enrichment_of_one_hot_trace(shuffled):
    n = 12_000
    i = F.col("id")
    given = {
        "id": i.cast("string"),
        "traceId": F.when(i % 3 == 0, "hot").when(i % 3 == 2, F.concat(F.lit("t"), i % 50)),
        "usageDetails": F.sha2(i.cast("string"), 512),
    }
    raw = shuffled.range(0, n, 1, 8).select(
        *(given.get(f, F.lit(None).cast("string")).alias(f) for f in RAW_OBSERVATION.fieldNames())
    )
    known = [("hot", "hot-user")] + [(f"t{k}", f"user{k}") for k in range(0, 50, 2)]
    traces = shuffled.createDataFrame(known, "id string, userId string").select(
        *(F.col(f) if f in ("id", "userId") else F.lit(None).cast("string").alias(f) for f in RAW_TRACE.fieldNames()),
        F.struct("id").alias("_seq"),
    )
    enriched = enrich_from_traces(raw, traces)
    got = {r["id"]: r["userId"] for r in enriched.collect()}
    users = dict(known)
    assert got == {str(k): users.get(trace_of(k)) for k in range(n)}
    assert set(CONTEXT) <= set(enriched.columns)
    plan = enriched._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan, plan


def test_outcomes_of_one_hot_trace(shuffled):
    n = 9_000
    i = F.col("id")
    facts = shuffled.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 3 == 2, F.concat(F.lit("t"), i % 50)).alias("trace_id"),
        (i % 10).cast("decimal(18,6)").alias("total_cost"),
    )
    scores = shuffled.range(n).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), i % 40)).alias("trace_id"),
        ((i % 100) / 100).alias("value"),
    )

    def shaped(df, spec):
        return df.select(
            *((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
              for f in spec.schema.fields)
        )

    tables = Tables(shuffled, {"fact_observation": shaped(facts, FACT_OBSERVATION), "fact_score": shaped(scores, FACT_SCORE)})
    outcomes = kpis.kpi_trace_outcomes(tables)
    got = {r["trace_id"]: (r["cost"], r["best_score"]) for r in outcomes.collect()}
    # Facts and scores are summed in their tasks before they cross, and nothing crosses again for the join.
    plan = outcomes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    below = [lines[i + 1] for i, line in enumerate(lines) if line.startswith("Exchange hashpartitioning(trace_id")]
    assert len(below) == 2 and all(re.match(r"(Sort|Hash)Aggregate\(keys=\[trace_id#\d+L?\], functions=\[partial_", x) for x in below), plan
    cost, best = {}, {}
    for k in range(n):
        if trace_of(k) is not None:
            cost[trace_of(k)] = cost.get(trace_of(k), 0) + k % 10
        scored = "hot" if k % 3 == 0 else f"t{k % 40}"
        best[scored] = max(best.get(scored, 0.0), (k % 100) / 100)
    assert got == {t: (float(cost[t]), best[t]) for t in cost if t in best}


def test_upsert_of_one_hot_key(shuffled, store):
    """A batch in which a third of all rows are copies of one observation."""
    first = [(f"k{k}", f"2024-01-0{k % 9 + 1}", str(k), "u", k) for k in range(600)]
    store.upsert_observations(observations(shuffled, first))
    batch = [("k7" if k % 3 == 0 else f"k{k}", f"2024-01-1{k % 10}", str(k), "u", k) for k in range(900)]
    assert store.upsert_observations(observations(shuffled, batch)) == 900
    expected = {key: (day, int(cost)) for key, day, cost, _, _ in first}
    for key, day, cost, _, _ in batch:
        expected[key] = (day, int(cost))
    got = {r["observation_id"]: (str(r["day"]), int(r["total_cost"])) for r in store.read(FACT_OBSERVATION).collect()}
    assert got == expected
    assert store.read(FACT_OBSERVATION).count() == len(expected)
