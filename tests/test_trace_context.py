"""Context of observations from traces in any order of arrival."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import trace_context
from tokenledger.operators.enrich import enrich_from_traces
from tokenledger.operators.normalize import normalize_observations
from tokenledger.operators.trace_context import TraceContext
from tokenledger.operators.versions import Files
from tokenledger.schemas import DIM_USER, FACT_OBSERVATION, RAW_OBSERVATION, RAW_TRACE, STORED_TRACE
from tokenledger.streaming.jobs import start_trace_store_sync
from tokenledger.workload.landed import land_store_export

SEEN = ["observation_id", "trace_id", "user_id", "session_id", "environment", "tags"]


def raw(spark, schema, rows):
    """Rows of dicts in a raw shape, in order of arrival."""
    table = [tuple(r.get(f) for f in schema.fieldNames()) + (i,) for i, r in enumerate(rows)]
    df = spark.createDataFrame(table, ", ".join(f"{f} string" for f in schema.fieldNames()) + ", n int")
    return df.withColumn("project", F.lit(None).cast("string")).withColumn("_seq", F.struct("n")).drop("n")


def call(i, trace="t", start="2024-01-10T10:00:00Z", **more):
    return {"id": i, "traceId": trace, "startTime": start, **more}


def trace(i, at="2024-01-10T09:00:00Z", **more):
    return {"id": i, "timestamp": at, **more}


def facts(store):
    return {r["observation_id"]: tuple(r[c] for c in SEEN[1:]) for r in store.read(FACT_OBSERVATION).collect()}


OLD = [trace("t", userId="old", environment="e"), trace("u", userId="v"), trace("", userId="none"), trace(None, userId="none")]
NEW = [trace("t", at="2024-01-12T09:00:00Z", userId="new", sessionId="s", tags='["x"]')]
CALLS = [
    call("a"),
    call("b", userId="own", tags="[]"),
    call("c", "u", start=None),
    call("d", ""),
    call("e", None),
    call("f", "nowhere"),
    call("g", "t", environment="mine"),
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_gives_what_one_enrichment_gives(spark, store, order):
    """The newer row of a trace counts if it comes last, so orders that swap the two end with the older one."""
    steps = [OLD, NEW, CALLS]
    for step in order:
        context = TraceContext(store)
        if step == 2:
            context.take_observations(raw(spark, RAW_OBSERVATION, CALLS))
        else:
            context.take_traces(raw(spark, RAW_TRACE, steps[step]))
    arrived = [t for step in order if step != 2 for t in steps[step]]
    want = normalize_observations(enrich_from_traces(raw(spark, RAW_OBSERVATION, CALLS), raw(spark, RAW_TRACE, arrived)))
    assert facts(store) == {r["observation_id"]: tuple(r[c] for c in SEEN[1:]) for r in want.collect()}


def test_a_later_observation_is_not_undone(spark, store):
    """Its newest arrival counts: another trace, context of its own, or no trace at all."""
    context = TraceContext(store)
    context.take_observations(raw(spark, RAW_OBSERVATION, [call("a"), call("b"), call("c")]))
    later = [call("a", "other"), call("b", userId="own"), call("c", "", start="2024-01-20T10:00:00Z")]
    context.take_observations(raw(spark, RAW_OBSERVATION, later))
    context.take_traces(raw(spark, RAW_TRACE, [trace("t", userId="u", sessionId="s")]))
    got = facts(store)
    assert {k: v[:3] for k, v in got.items()} == {"a": ("other", None, None), "b": ("t", "own", "s"), "c": ("", None, None)}
    assert store.read(DIM_USER).count() == 1


def test_repeated_batches_change_nothing(spark, store):
    context = TraceContext(store)
    for _ in range(2):
        context.take_observations(raw(spark, RAW_OBSERVATION, CALLS))
        context.take_traces(raw(spark, RAW_TRACE, NEW))
    first, number = facts(store), store.versions(FACT_OBSERVATION).current().number
    context.take_traces(raw(spark, RAW_TRACE, NEW))
    assert facts(store) == first
    assert store.versions(FACT_OBSERVATION).current().number == number
    assert store.read(STORED_TRACE).count() == 1


def test_empty_batches(spark, store):
    context = TraceContext(store)
    assert context.take_traces(raw(spark, RAW_TRACE, [])) == 0
    assert context.take_observations(raw(spark, RAW_OBSERVATION, [])) == 0
    assert context.take_observations(raw(spark, RAW_OBSERVATION, [call("a", None)])) == 1
    assert context.take_traces(raw(spark, RAW_TRACE, [trace("t", userId="u")])) == 1
    assert facts(store)["a"][1] is None


def test_many_batches_leave_few_versions(spark, store, monkeypatch):
    monkeypatch.setattr(trace_context, "GATHER", 3)
    context = TraceContext(store)
    for i in range(5):
        context.take_observations(raw(spark, RAW_OBSERVATION, [call("a", userId=f"u{i}"), call(f"k{i}")]))
    assert max(map(len, context.calls.current().parts.values())) <= 3
    context.take_traces(raw(spark, RAW_TRACE, [trace("t", userId="late", sessionId="s")]))
    got = facts(store)
    assert got["a"][1:3] == ("u4", "s")
    assert all(got[f"k{i}"][1:3] == ("late", "s") for i in range(5))


def test_keep_days(spark, store):
    from datetime import datetime, timezone

    as_of = datetime(2024, 1, 31, tzinfo=timezone.utc)
    context = TraceContext(store, keep_days=10, as_of=as_of)
    rows = [call("old", start="2024-01-05T10:00:00Z"), call("new", start="2024-01-25T10:00:00Z"), call("none", start=None)]
    context.take_observations(raw(spark, RAW_OBSERVATION, rows))
    context.take_traces(raw(spark, RAW_TRACE, [trace("t", userId="u")]))
    assert {k: v[1] for k, v in facts(store).items()} == {"old": None, "new": "u", "none": "u"}


def test_only_days_of_the_batch_are_read(spark, store):
    """Days of other traces and observations stay unopened: their files may even be gone."""
    context = TraceContext(store)
    rows = [call(f"o{d}", f"t{d}", f"2024-01-{d:02}T10:00:00Z") for d in range(10, 20)]
    context.take_observations(raw(spark, RAW_OBSERVATION, rows))
    context.take_traces(raw(spark, RAW_TRACE, [trace(f"t{d}", f"2024-01-{d:02}T09:00:00Z") for d in range(10, 20)]))
    wanted = spark.createDataFrame([("o12",)], "observation_id string")
    files = store.of_keys(FACT_OBSERVATION, wanted).inputFiles()
    assert {f.split("day=")[1].split("/")[0] for f in files if "day=" in f} == {"2024-01-12"}
    wanted = spark.createDataFrame([("t12",), ("t15",), ("absent",)], "id string")
    files = store.of_keys(STORED_TRACE, wanted).inputFiles()
    assert {f.split("day=")[1].split("/")[0] for f in files if "day=" in f} == {"2024-01-12", "2024-01-15"}


def test_hot_trace(spark, store):
    """One trace of most observations, brought in by one batch and filled by the next."""
    rows = spark.range(3000).select(
        F.concat(F.lit("o"), "id").alias("id"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("traceId"),
        F.lit("2024-01-10T10:00:00Z").alias("startTime"),
        *(F.lit(None).cast("string").alias(c) for c in RAW_OBSERVATION.fieldNames() if c not in ("id", "traceId", "startTime")),
        F.lit(None).cast("string").alias("project"),
        F.struct(F.col("id").alias("n")).alias("_seq"),
    )
    context = TraceContext(store)
    context.take_observations(rows)
    context.take_traces(raw(spark, RAW_TRACE, [trace("hot", userId="u")]))
    assert store.read(FACT_OBSERVATION).where("user_id = 'u' AND trace_id = 'hot'").count() == 2000
    assert store.read(FACT_OBSERVATION).where("user_id IS NULL").count() == 1000


def test_an_observation_that_named_two_traces_is_filled_from_the_one_it_has(spark, store):
    context = TraceContext(store)
    context.take_observations(raw(spark, RAW_OBSERVATION, [call("a"), call("b")]))
    context.take_observations(raw(spark, RAW_OBSERVATION, [call("a", "other")]))
    context.take_traces(raw(spark, RAW_TRACE, [trace("t", userId="u"), trace("other", userId="v")]))
    assert {k: v[:2] for k, v in facts(store).items()} == {"a": ("other", "v"), "b": ("t", "u")}


def test_a_landed_export_is_small(spark, tmp_path):
    """An export repeats its field names in every line, and the stream query lands it whole before it begins."""
    spark.range(2000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, id) AS ts", "id % 50 AS user_id",
        "'click' AS event_type", "id / 7D AS value", "concat('{\"k\": ', id % 99, '}') AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    root = land_store_export(spark, str(tmp_path))
    lines = spark.read.text([f"{root}/observations", f"{root}/traces/first", f"{root}/traces/second"])
    assert lines.count() == 2000 + 2 * lines.where("value LIKE '%stale%'").count()
    size = sum(Files(spark).size(f"{root}/{x}") for x in ("observations", "traces"))
    assert size < lines.select(F.sum(F.length("value"))).first()[0] / 4


def test_stream_fills_observations_that_came_first(spark, tmp_path, store):
    def land(folder, name, rows):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        start_trace_store_sync(spark, str(tmp_path), store, str(tmp_path / "check"), True).awaitTermination()

    store.refresh_usage_daily()
    land("traces", "0.json", [])
    land("observations", "1.json", [{"id": "a", "trace_id": "t", "start_time": "2024-01-10 10:00:00"}])
    run()
    assert facts(store)["a"][1] is None
    land("traces", "1.json", [{"id": "t", "user_id": "u", "timestamp": "2023-12-20 10:00:00", "tags": ["x"]}])
    run()
    assert facts(store)["a"] == ("t", "u", None, None, '["x"]')
    land("observations", "2.json", [{"id": "b", "trace_id": "t", "start_time": "2024-01-11 10:00:00"}])
    run()
    assert facts(store)["b"][1] == "u"


@pytest.mark.parametrize("broken", ["_note", "_refill"])
def test_a_batch_that_failed_half_way_is_made_good_by_its_retry(spark, store, monkeypatch, broken):
    def fail(*_):
        raise OSError("executor lost")

    def step(take, rows):
        with monkeypatch.context() as m:
            m.setattr(TraceContext, broken, fail)
            try:
                take(TraceContext(store), rows)
            except OSError:
                pass
        take(TraceContext(store), rows)

    step(TraceContext.take_observations, raw(spark, RAW_OBSERVATION, [call("a"), call("b", userId="own")]))
    step(TraceContext.take_traces, raw(spark, RAW_TRACE, [trace("t", userId="u", sessionId="s")]))
    assert {k: v[1:3] for k, v in facts(store).items()} == {"a": ("u", "s"), "b": ("own", "s")}
