import json
from datetime import datetime, timezone

import pytest

from tokenledger.operators.governance_rows import (
    governance_divergence,
    governance_policies,
    governance_snapshots,
)
from tokenledger.plans.kpis import behaviour, kpi_governance_snapshot
from tokenledger.schemas import DIM_POLICY, FACT_GOVERNANCE, FACT_GOVERNANCE_DIVERGENCE
from tokenledger.sources.governance import accepted, read_governance_documents, skipped
from tokenledger.streaming.jobs import start_governance_sync
from tokenledger.streaming.syncs import sync_governance

AS_OF = datetime(2025, 9, 2, tzinfo=timezone.utc)

EXPORT = {
    "version": 1,
    "project": {"id": "prj", "name": None},
    "exportedAt": "2025-09-01T12:00:00.000Z",
    "metrics": {
        "ttrpMs": 7200000,
        "precision14": {"numerator": 1, "denominator": 1, "ratio": 1.0},
        "proposals": {"total": 3, "pending": 1, "ratified": 2, "rejected": 0, "decayed": 0},
    },
    "policies": [
        {"ruleKey": "b", "kind": "tool-choice", "status": "proposed", "confidence": 0.65,
         "promotedAt": "2025-09-01T12:00:00.000Z", "operator": "reviewer", "evidenceTraces": 6},
        {"ruleKey": "a", "kind": "retry", "confidence": "0.5", "evidenceTraces": 7.9},
    ],
    "divergence": [
        {"model": "gpt-4o-mini", "taskKey": "refund", "divergentTraces": 1, "totalTraces": 7},
        {"model": "gpt-4o", "taskKey": "dispute", "divergentTraces": 0, "totalTraces": 9},
    ],
}


def put(folder, name="export.json", **changes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({**EXPORT, **changes}, indent=2))
    return str(folder)


def counts(store):
    return [store.read(t).count() for t in (FACT_GOVERNANCE, DIM_POLICY, FACT_GOVERNANCE_DIVERGENCE)]


def test_rows(spark, tmp_path):
    documents = accepted(read_governance_documents(spark, put(tmp_path / "in")))
    snapshot = governance_snapshots(documents).first()
    assert snapshot["snapshot_id"] == "prj:2025-09-01T12:00:00+00:00"
    assert (snapshot["ttrp_ms"], snapshot["proposals_ratified"]) == (7200000.0, 2)
    policies = {r["rule_key"]: r for r in governance_policies(documents).collect()}
    assert policies["a"]["status"] == "ratified" and policies["b"]["status"] == "proposed"
    assert (policies["a"]["confidence"], policies["a"]["evidence_traces"]) == (0.5, 7)
    assert governance_divergence(documents).count() == 2


def test_empty_project(spark, tmp_path):
    folder = put(
        tmp_path / "in", project=None, exportedAt=None, policies=[], divergence=None,
        metrics={"ttrpMs": None, "precision14": {"ratio": True}},
    )
    documents = accepted(read_governance_documents(spark, folder))
    row = governance_snapshots(documents, AS_OF).first()
    assert row["project_id"] == "(unknown)"
    assert row["exported_at"] == AS_OF.replace(tzinfo=None)
    assert (row["ttrp_ms"], row["precision14_ratio"], row["proposals_total"]) == (None, None, 0)
    assert governance_policies(documents).count() == 0
    assert governance_divergence(documents).count() == 0


def test_other_versions_are_skipped_and_reported(spark, tmp_path):
    put(tmp_path / "in", "one.json")
    put(tmp_path / "in", "two.json", version=2)
    put(tmp_path / "in", "text.json", version="1")
    (tmp_path / "in" / "notes.txt").write_text("not an export")
    documents = read_governance_documents(spark, str(tmp_path / "in"))
    assert accepted(documents).count() == 1
    assert {r["file"].rsplit("/", 1)[1]: r["version"] for r in skipped(documents).collect()} == {
        "two.json": "2", "text.json": "1",
    }


def test_unreadable_document_fails(spark, tmp_path):
    folder = put(tmp_path / "in")
    (tmp_path / "in" / "broken.json").write_text('{"version": 1, ')
    with pytest.raises(Exception):
        read_governance_documents(spark, folder).collect()


def test_same_export_twice(spark, tmp_path, store):
    folder = put(tmp_path / "in")
    for _ in range(2):
        count, left_out = sync_governance(spark, folder, store)
        assert (count, left_out.count()) == (1, 0)
        assert counts(store) == [1, 2, 2]
    parts = behaviour(store.tables())
    metrics = parts["metrics"].first()
    assert (metrics["ttrp_ms"], metrics["proposals_ratified"]) == (7200000, 2)
    assert [r["rule_key"] for r in parts["policies"].collect()] == ["a", "b"]
    assert parts["divergence"].first()["model"] == "gpt-4o"


def test_overwritten_export_adds_a_snapshot(spark, tmp_path, store):
    folder = put(tmp_path / "in")
    sync_governance(spark, folder, store)
    put(tmp_path / "in", exportedAt="2025-09-02T12:00:00.000Z")
    sync_governance(spark, folder, store)
    assert counts(store) == [2, 2, 2]


def test_rule_key_is_shared_by_projects(spark, tmp_path, store):
    put(tmp_path / "in", "1.json")
    folder = put(tmp_path / "in", "2.json", project={"id": "other"})
    sync_governance(spark, folder, store)
    assert counts(store) == [2, 2, 4]
    assert {r["project_id"] for r in store.read(DIM_POLICY).collect()} == {"other"}


def test_stream_of_exports(spark, tmp_path, store):
    folder = put(tmp_path / "in", "1.json")
    put(tmp_path / "in", "2.json", exportedAt="2025-09-03T00:00:00Z")
    put(tmp_path / "in", "3.json", version=9)
    start_governance_sync(spark, folder, store, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert counts(store) == [2, 2, 2]


def test_empty_state(spark, store):
    parts = behaviour(store.tables())
    row = parts["metrics"].first().asDict()
    assert row.pop("ttrp_ms") is None and row.pop("precision14_ratio") is None
    assert set(row.values()) == {0}
    assert parts["policies"].count() == parts["divergence"].count() == 0
    assert kpi_governance_snapshot(store.tables()).count() == 0
