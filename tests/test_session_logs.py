import json
import os
import random
import string
from datetime import datetime, timezone
from decimal import Decimal

import pytest
import zstandard

from tokenledger.operators.session_calls import project_slug, session_observations
from tokenledger.reference_data import default_model_prices
from tokenledger.sources import session_logs
from tokenledger.sources.session_logs import read_session_events, spool_session_events

AS_OF = datetime(2025, 9, 1, tzinfo=timezone.utc)


def message(tokens_in, tokens_out, counter, model="deepseek-v4-pro", time=1_700_000_000_500, **extra):
    usage = {"inputTokens": tokens_in, "outputTokens": tokens_out, "cacheReadTokens": counter, **extra}
    return {"type": "assistant/message", "time": time, "data": {"usage": usage, "message": {"source": {"model": model}}}}


def write_log(root, project, session, events, name="session.jsonl.zst"):
    folder = root / project / session
    folder.mkdir(parents=True, exist_ok=True)
    lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
    (folder / name).write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))


def calls(spark, root, **options):
    events = read_session_events(spark, str(root), **options)
    rows = session_observations(events, default_model_prices(spark), as_of=AS_OF).drop("_seq")
    return sorted(rows.collect(), key=lambda r: (r["session_id"], int(r["observation_id"].rsplit("-", 1)[1])))


@pytest.mark.parametrize("chunk_lines", [1, 2, 1 << 20])
def test_cache_delta_skips_unusable_messages(spark, tmp_path, chunk_lines):
    events = [message(100, 1, 50), message(0, 0, 999), message(20, 1, 80), message(20, 1, 70)]
    write_log(tmp_path, "p", "s", events)
    rows = calls(spark, tmp_path, chunk_lines=chunk_lines)
    assert [r["cached_input_tokens"] for r in rows] == [0, 20, 0]
    assert [r["observation_id"] for r in rows] == ["log-s-0", "log-s-1", "log-s-2"]


@pytest.mark.parametrize("chunk_lines", [1, 3, 1 << 20])
def test_session_id_carries_forward(spark, tmp_path, chunk_lines):
    write_log(
        tmp_path,
        "-home-alice-work-app",
        "folder",
        [
            message(1, 1, 0),
            {"type": "session", "id": "first"},
            message(2, 1, 0),
            "",
            "not json",
            {"type": "session", "id": "second"},
            message(3, 1, 0),
            {"type": "session"},
            message(4, 1, 0),
        ],
    )
    rows = {r["input_tokens"]: r for r in calls(spark, tmp_path, chunk_lines=chunk_lines)}
    assert [rows[i]["session_id"] for i in (1, 2, 3, 4)] == ["folder", "first", "second", "folder"]
    assert rows[1]["project_id"] == "work-app"
    assert [rows[i]["observation_id"][-1] for i in (1, 2, 3, 4)] == ["0", "1", "2", "3"]


def test_prices_and_fixed_columns(spark, tmp_path):
    write_log(
        tmp_path,
        "p",
        "s",
        [message(1_000_000, 500_000, 0, reasoningTokens=7), message(10, 10, 0, model="unheard-of", time=0)],
    )
    first, second = calls(spark, tmp_path)
    assert (first["input_cost"], first["output_cost"]) == (Decimal("0.660000"), Decimal("0.990000"))
    assert first["total_cost"] == Decimal("1.650000")
    assert first["total_tokens"] == 1_500_007
    assert (first["type"], first["name"], first["environment"]) == ("GENERATION", "assistant", "cli")
    assert (first["user_id"], first["latency_ms"]) == ("local", 0.0)
    assert first["start_time"] == datetime(2023, 11, 14, 22, 13, 20, 500000)
    assert second["total_cost"] == 0 and second["start_time"] == datetime(2025, 9, 1)


def test_fractional_counts_truncate(spark, tmp_path):
    write_log(tmp_path, "p", "s", [message(12.7, 3.9, 0), message(0.5, 0, 0)])
    assert [(r["input_tokens"], r["output_tokens"]) for r in calls(spark, tmp_path)] == [(12, 3)]


def test_only_changed_logs(spark, tmp_path):
    write_log(tmp_path, "p", "old", [message(1, 1, 0)])
    write_log(tmp_path, "p", "new", [message(2, 1, 0)])
    past = datetime(2020, 1, 1, tzinfo=timezone.utc).timestamp()
    os.utime(tmp_path / "p" / "old" / "session.jsonl.zst", (past, past))
    since = datetime(2021, 1, 1, tzinfo=timezone.utc)
    assert [r["session_id"] for r in calls(spark, tmp_path, changed_since=since)] == ["new"]


@pytest.mark.parametrize("at_once", [2, 100])
def test_logs_are_read_some_at_a_time(spark, tmp_path, monkeypatch, at_once):
    """The driver holds the files of a few sessions, and finds the logs that one scan of the root finds."""
    root = tmp_path / "logs"
    for i, (project, session) in enumerate(
        [("p", "a"), ("p", "b [1]"), ("p", "c,d"), ("q", "{x}"), ("q", "e%20f"), ("project=-home-me-r", "session=s"), (".", "."),
         ("p", "."), ("p", "deep/er"), ("_hidden", "h"), ("p", "_temporary"), ("p", ".h"), ("q", "_key=v")]
    ):
        write_log(root, project, session, [message(i + 1, 1, 0), "not json", {"type": "session", "id": f"s{i}"}, message(i + 1, 1, 5)])
    write_log(root, "p", "other", [message(99, 1, 0)], "another.jsonl.zst")
    given = []
    read = session_logs.read_session_events

    def recorded(spark, folders, *rest):
        given.append(len(folders))
        return read(spark, folders, *rest)

    monkeypatch.setattr(session_logs, "read_session_events", recorded)
    got = spool_session_events(spark, str(root), str(tmp_path / "spool"), at_once=at_once)
    assert max(given) <= at_once and sum(given) >= 10

    def rows(events):
        observed = session_observations(events, default_model_prices(spark), as_of=AS_OF).drop("_seq").collect()
        return sorted(map(str, observed)), sorted(r["file"] for r in events.select("file").distinct().collect())

    assert rows(got) == rows(read(spark, str(root)))
    flat = spool_session_events(spark, str(root / "p" / "a"), str(tmp_path / "flat"), at_once=at_once)
    assert flat.count() == 3


def test_slug(spark):
    from pyspark.sql import functions as F

    def slug(folder, prefix=None):
        return spark.range(1).select(project_slug(F.lit(folder), prefix).alias("s")).first()["s"]

    assert slug("-home-alice-work-myproject-") == "work-myproject"
    assert slug("srv-app") == "srv-app"
    assert slug("-srv-app", "srv-") == "app"
    assert slug("-home-alice-x", "srv-") == "home-alice-x"


def test_logs_over_four_megabytes(spark, tmp_path):
    rng = random.Random(5)
    filler = ["".join(rng.choices(string.ascii_letters + string.digits, k=1000)) for _ in range(6500)]
    events = [{**message(100, 1, i), "note": text} for i, text in enumerate(filler)]
    write_log(tmp_path / "a", "p", "s", events)
    write_log(tmp_path / "b", "p", "s", events, "session.jsonl.zstd")
    assert (tmp_path / "a/p/s/session.jsonl.zst").stat().st_size > 4 << 20
    whole = calls(spark, tmp_path / "a")
    assert len(whole) == 6500
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in settings]
    try:
        for k in settings:
            spark.conf.set(k, str(64 << 20))
        assert calls(spark, tmp_path / "b") == whole
    finally:
        for k, v in zip(settings, before):
            spark.conf.set(k, v)


def test_one_log_in_many_chunks_matches_a_loop(spark, tmp_path):
    """One log holds all events; results equal a plain loop over its lines."""
    rng = random.Random(11)
    events = []
    for i in range(3000):
        if rng.random() < 0.02:
            events.append({"type": "session", "id": f"s{i}"})
        elif rng.random() < 0.1:
            events.append(message(0, 0, rng.randrange(500)))
        else:
            events.append(message(rng.randrange(1, 200), 1, rng.randrange(500)))
    write_log(tmp_path, "p", "folder", events)
    expected, session, previous = [], None, None
    for e in events:
        if e["type"] == "session":
            session = e["id"]
            continue
        usage = e["data"]["usage"]
        if not usage["inputTokens"] and not usage["outputTokens"]:
            continue
        counter = usage["cacheReadTokens"]
        cached = 0 if previous is None else min(usage["inputTokens"], max(0, counter - previous))
        previous = counter
        expected.append((f"log-{session or 'folder'}-{len(expected)}", usage["inputTokens"], cached))
    got = calls(spark, tmp_path, chunk_lines=64)
    assert sorted((r["observation_id"], r["input_tokens"], r["cached_input_tokens"]) for r in got) == sorted(expected)
