"""Ingest edge rules on hand-made rows."""

import json
from decimal import Decimal

import pytest

from tokenledger.operators.enrich import enrich_from_traces
from tokenledger.operators.normalize import normalize_observations, normalize_scores
from tokenledger.sources.landing import (
    project_table,
    read_observations,
    read_scores,
    read_store_observations,
    read_store_scores,
    read_store_traces,
    read_traces,
)


def land(folder, rows, name="rows.json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    return str(folder)


def normalized(spark, tmp_path, rows):
    raw = read_observations(spark, land(tmp_path / "obs", rows))
    return {r["observation_id"]: r for r in normalize_observations(raw).collect()}


def test_usage_as_object_or_text(spark, tmp_path):
    usage = {"input": 5, "output": 7, "total": 0, "cachedInput": 1, "cacheReadInput": "2", "cache_read_input_tokens": 4}
    got = normalized(
        spark,
        tmp_path,
        [
            {"id": "object", "usageDetails": usage},
            {"id": "text", "usageDetails": json.dumps(usage)},
            {"id": "blank", "usageDetails": "  "},
            {"id": "invalid", "usageDetails": "{oops"},
            {"id": "missing"},
        ],
    )
    for key in ("object", "text"):
        assert (got[key]["input_tokens"], got[key]["output_tokens"]) == (5, 7)
        assert (got[key]["total_tokens"], got[key]["cached_input_tokens"]) == (12, 7)
    for key in ("blank", "invalid", "missing"):
        assert (got[key]["input_tokens"], got[key]["total_tokens"]) == (0, 0)


def test_reasoning_falls_back_when_falsy(spark, tmp_path):
    def usage(**u):
        return {"usageDetails": u}

    got = normalized(
        spark,
        tmp_path,
        [
            {"id": "first", **usage(reasoning=3, reasoningTokens=9)},
            {"id": "zero", **usage(reasoning=0, reasoningTokens=9)},
            {"id": "absent", **usage(reasoningTokens=9)},
            {"id": "invalid", **usage(reasoning="abc", reasoningTokens=9)},
        ],
    )
    assert {k: r["reasoning_tokens"] for k, r in got.items()} == {"first": 3, "zero": 9, "absent": 9, "invalid": 0}


def test_costs(spark, tmp_path):
    got = normalized(
        spark,
        tmp_path,
        [
            {"id": "parts", "totalCost": 0, "costDetails": {"input": 0.2, "output": 0.3}},
            {"id": "total", "totalCost": "1.5", "costDetails": {"input": 0.2}},
            {"id": "none", "totalCost": None},
        ],
    )
    assert got["parts"]["total_cost"] == Decimal("0.500000")
    assert got["total"]["total_cost"] == Decimal("1.500000")
    assert got["none"]["total_cost"] == 0


def test_latency_needs_both_ends(spark, tmp_path):
    got = normalized(
        spark,
        tmp_path,
        [
            {"id": "both", "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T00:00:01.5Z"},
            {"id": "open", "startTime": "2024-01-01T00:00:00Z"},
            {"id": "bad", "startTime": "yesterday", "endTime": "2024-01-01T00:00:01Z"},
        ],
    )
    assert [got[k]["latency_ms"] for k in ("both", "open", "bad")] == [1500.0, None, None]


def test_bodies_are_never_read(spark, tmp_path):
    got = normalized(spark, tmp_path, [{"id": "a", "input": "secret prompt", "output": "secret reply"}])
    assert "secret" not in str(got["a"])


def test_projects_by_folder(spark, tmp_path):
    land(tmp_path / "obs" / "project=app", [{"id": "1"}, {"id": "2", "projectId": "own"}])
    land(tmp_path / "obs" / "project=key-9", [{"id": "3"}])
    projects = project_table(spark, [{"id": "app", "name": "App"}, {"name": None, "key": "key-9"}])
    raw = read_observations(spark, str(tmp_path / "obs")).join(projects, "project", "left")
    got = {r["observation_id"]: (r["project_id"], r["project_name"]) for r in normalize_observations(raw).collect()}
    assert got == {"1": ("app", "App"), "2": ("own", "App"), "3": ("key-9", "key-9")}


def test_scores_flat_and_nested(spark, tmp_path):
    rows = [
        {"id": "flat", "traceId": "t", "observationId": "o", "value": 0.5},
        {"id": "observation", "subject": {"kind": "OBSERVATION", "id": "o2", "traceId": "t2"}, "value": "0.25"},
        {"id": "trace", "subject": {"kind": "TRACE", "id": "x", "traceId": "t3"}, "value": None},
    ]
    got = {
        r["score_id"]: (r["trace_id"], r["observation_id"], r["value"])
        for r in normalize_scores(read_scores(spark, land(tmp_path / "s", rows))).collect()
    }
    assert got == {"flat": ("t", "o", 0.5), "observation": ("t2", "o2", 0.25), "trace": ("t3", None, 0.0)}


def test_store_exports(spark, tmp_path):
    observations = land(
        tmp_path / "o",
        [
            {"id": "1", "provided_model_name": "m", "internal_model_id": "i", "usage_details": {"input": 3}},
            {"id": "2", "provided_model_name": "", "internal_model_id": "i", "total_cost": 2},
            {"id": "3"},
        ],
    )
    got = {r["observation_id"]: r for r in normalize_observations(read_store_observations(spark, observations)).collect()}
    assert [got[k]["model"] for k in "123"] == ["m", "i", ""]
    assert got["1"]["input_tokens"] == 3 and got["2"]["total_cost"] == 2
    scores = land(tmp_path / "s", [{"id": "s", "trace_id": "t", "observation_id": "", "value": 1}])
    row = normalize_scores(read_store_scores(spark, scores)).first()
    assert (row["trace_id"], row["observation_id"], row["value"]) == ("t", None, 1.0)
    traces = land(tmp_path / "t", [{"id": "t", "user_id": "u", "session_id": "s", "tags": ["a"]}])
    row = read_store_traces(spark, traces).first()
    assert (row["userId"], row["sessionId"], row["tags"]) == ("u", "s", '["a"]')


def test_enrichment(spark, tmp_path):
    observations = read_observations(
        spark,
        land(
            tmp_path / "o",
            [
                {"id": "own", "traceId": "t", "userId": "mine"},
                {"id": "empty", "traceId": "t", "userId": "", "tags": []},
                {"id": "missing-trace", "traceId": "nowhere", "userId": ""},
                {"id": "no-trace-id", "userId": None},
                {"id": "both-empty", "traceId": "e", "userId": ""},
                {"id": "complete", "traceId": "t", "userId": "a", "sessionId": "b", "environment": "c", "tags": ["d"]},
            ],
        ),
    )
    traces = read_traces(
        spark,
        land(
            tmp_path / "t",
            [
                {"id": "t", "userId": "stale"},
                {"id": "t", "userId": "trace-user", "tags": ["x"], "sessionId": "s"},
                {"id": "e", "userId": ""},
                {"id": "", "userId": "nobody"},
            ],
        ),
    )
    enriched = enrich_from_traces(observations, traces)
    assert enriched.columns == observations.columns
    got = {r["id"]: r for r in enriched.collect()}
    assert len(got) == 6
    assert got["own"]["userId"] == "mine" and got["own"]["sessionId"] == "s"
    assert got["empty"]["userId"] == "trace-user" and got["empty"]["tags"] == '["x"]'
    assert got["missing-trace"]["userId"] == ""
    assert got["no-trace-id"]["userId"] is None
    assert got["both-empty"]["userId"] == ""
    assert got["complete"]["tags"] == '["d"]'


def test_lookback_is_half_open(spark, tmp_path):
    from datetime import datetime, timezone

    from tokenledger.sources.landing import lookback

    rows = [
        {"id": "before", "startTime": "2024-01-01T11:59:59Z"},
        {"id": "first", "startTime": "2024-01-01T12:00:00Z"},
        {"id": "last", "startTime": "2024-01-31T11:59:59Z"},
        {"id": "after", "startTime": "2024-01-31T12:00:00Z"},
        {"id": "undated"},
    ]
    window = lookback(datetime(2024, 1, 31, 12, tzinfo=timezone.utc))
    got = read_observations(spark, land(tmp_path / "o", rows), window)
    assert {r["id"] for r in got.collect()} == {"first", "last"}


@pytest.mark.parametrize("suffix", ["csv", "json"])
def test_reference_tables_from_files(spark, tmp_path, suffix):
    from tokenledger.schemas import BUDGET
    from tokenledger.sources.small_tables import read_reference_table

    path = tmp_path / f"budget.{suffix}"
    if suffix == "csv":
        path.write_text("scope_type,scope_id,period,budget_usd\nglobal,*,monthly,100.5\n")
    else:
        path.write_text('{"scope_type":"global","scope_id":"*","period":"monthly","budget_usd":100.5}\n')
    assert read_reference_table(spark, BUDGET, str(path)).first()["budget_usd"] == 100.5


def test_amounts_far_below_a_millionth_add_up(spark):
    from pyspark.sql import functions as F

    from tokenledger.plans.rollup import usage_rollup
    from tokenledger.schemas import RAW_OBSERVATION
    from tokenledger.tables import Tables

    raw = spark.range(1000).select(
        *[
            (F.concat(F.lit("o"), "id") if f.name == "id" else F.lit(4e-7) if f.name == "totalCost" else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in RAW_OBSERVATION.fields
        ]
    )
    facts = normalize_observations(raw)
    total = usage_rollup(Tables(spark, {"fact_observation": facts}), ["model"], ("total_cost",)).first()["total_cost"]
    assert float(total) == 0.0004
