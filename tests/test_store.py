import json
import time
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import key_index
from tokenledger.operators import store as store_module
from tokenledger.operators.key_index import KeyIndex
from tokenledger.operators.latest import latest_by_key
from tokenledger.operators.versions import Files, Versions, differing
from tokenledger.plans import kpis
from tokenledger.plans.dashboards import dash_model_metric
from tokenledger.plans.marts import (
    mrt_daily_usage,
    mrt_hourly_usage,
    mrt_model_daily,
    mrt_model_efficiency,
    mrt_org_daily,
    mrt_policy_coverage,
    mrt_session,
)
from tokenledger.schemas import (
    DIM_POLICY,
    DIM_USER,
    FACT_OBSERVATION,
    FACT_SCORE,
    MODEL_PRICES,
    SYNC_STATE,
    TARGETS,
    USAGE_DAILY,
    USAGE_HOURLY,
)
from tokenledger.session import FREE_SHUFFLES
from tokenledger.sources.landing import lookback, project_table, read_observations
from tokenledger.sources.seen_files import SeenFiles
from tokenledger.streaming.jobs import start_observation_sync, start_score_sync, start_trace_store_sync
from tokenledger.streaming.syncs import (
    seed_reference_tables,
    sync_landing,
    sync_session_logs,
    sync_trace_store,
)

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)


def observations(spark, rows):
    """Rows of (id, start, cost, user, order of arrival)."""
    df = spark.createDataFrame(rows, "observation_id string, start string, cost string, user_id string, n int")
    given = {
        "observation_id": F.col("observation_id"),
        "trace_id": F.concat(F.lit("t"), "observation_id"),
        "user_id": F.col("user_id"),
        "start_time": F.col("start").cast("timestamp"),
        "total_cost": F.col("cost").cast("decimal(18,6)"),
    }
    columns = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_OBSERVATION.schema.fields
    ]
    return df.select(*columns, F.struct("n").alias("_seq"))


def stored(store):
    return {
        r["observation_id"]: (str(r["day"]), r["total_cost"]) for r in store.read(FACT_OBSERVATION).collect()
    }


def test_later_row_of_a_batch_wins(spark, store):
    rows = observations(
        spark, [("a", "2024-01-01", "1", "u", 2), ("a", "2024-01-01", "9", "u", 1), ("b", "2024-01-01", "2", "u", 3)]
    )
    assert store.upsert_observations(rows, AS_OF) == 3
    assert stored(store) == {"a": ("2024-01-01", Decimal(1)), "b": ("2024-01-01", Decimal(2))}


def test_row_moves_to_another_day_and_leaves_no_copy(spark, store):
    store.upsert_observations(observations(spark, [("a", "2024-01-01", "1", "u", 1), ("b", "2024-01-02", "2", "u", 1)]))
    store.upsert_observations(observations(spark, [("a", "2024-01-03", "5", "u", 1)]))
    assert stored(store) == {"a": ("2024-01-03", Decimal(5)), "b": ("2024-01-02", Decimal(2))}
    store.upsert_observations(observations(spark, [("a", None, "6", "u", 1)]))
    assert stored(store)["a"] == ("None", Decimal(6))
    store.upsert_observations(observations(spark, [("a", "2024-01-02", "7", "u", 1)]))
    assert stored(store) == {"a": ("2024-01-02", Decimal(7)), "b": ("2024-01-02", Decimal(2))}


def test_superseded_copy_of_a_batch_names_the_old_day(spark, store):
    """The stored row sits on a day that only an outdated copy in the batch mentions."""
    store.upsert_observations(observations(spark, [("a", "2024-01-01", "1", "u", 1), ("b", "2024-01-02", "2", "u", 1)]))
    store.upsert_observations(observations(spark, [("a", "2024-01-01", "5", "u", 1), ("a", "2024-01-02", "6", "u", 2)]))
    assert stored(store) == {"a": ("2024-01-02", Decimal(6)), "b": ("2024-01-02", Decimal(2))}
    assert store.read(FACT_OBSERVATION).count() == 2


def test_unchanged_rows_rewrite_nothing(spark, store):
    rows = [(f"k{i}", f"2024-01-0{i % 3 + 1}", str(i), "u", i) for i in range(30)]
    store.upsert_observations(observations(spark, rows))
    table = store.versions(FACT_OBSERVATION)
    first = table.current()
    assert store.upsert_observations(observations(spark, rows), skip_unchanged=True) == 30
    assert table.current() == first
    rows[4] = ("k4", "2024-01-02", "99", "u", 4)
    rows[5] = ("k5", None, "5", "u", 5)
    store.upsert_observations(observations(spark, rows), skip_unchanged=True)
    touched = differing(first.parts, table.current().parts)
    assert touched == ["day=2024-01-02", "day=2024-01-03", "day=__HIVE_DEFAULT_PARTITION__"]
    expected = {key: (str(day), Decimal(cost)) for key, day, cost, _, _ in rows}
    assert stored(store) == expected
    assert store.read(FACT_OBSERVATION).count() == 30


def test_empty_batch_and_null_key(spark, store):
    assert store.upsert_observations(observations(spark, [])) == 0
    with pytest.raises(Exception, match="NULL in key"):
        store.upsert_observations(observations(spark, [(None, "2024-01-01", "1", "u", 1)]))
    assert stored(store) == {}


def lost(*_, **__):
    raise RuntimeError("executor lost")


@pytest.mark.parametrize("where", ["write", "index", "record"])
def test_an_interrupted_upsert_changes_nothing_and_can_be_repeated(spark, store, monkeypatch, where):
    before = {"a": ("2024-01-01", Decimal(1)), "b": ("2024-01-01", Decimal(2))}
    store.upsert_observations(observations(spark, [("a", "2024-01-01", "1", "u", 1), ("b", "2024-01-01", "2", "u", 1)]))
    owner, name = {"write": (Versions, "write"), "index": (KeyIndex, "moved"), "record": (Files, "create")}[where]
    monkeypatch.setattr(owner, name, lost)
    moved = observations(spark, [("a", "2024-01-02", "3", "u", 1)])
    with pytest.raises(RuntimeError, match="executor lost"):
        store.upsert_observations(moved)
    monkeypatch.undo()
    assert stored(store) == before
    if where == "record":
        assert store.recover(FACT_OBSERVATION)
    assert not store.recover(FACT_OBSERVATION) and stored(store) == before
    store.upsert_observations(moved)
    assert stored(store) == {"a": ("2024-01-02", Decimal(3)), "b": ("2024-01-01", Decimal(2))}
    assert store.read(FACT_OBSERVATION).count() == 2


def test_a_record_that_was_cut_off_does_not_count(spark, store):
    store.upsert_observations(observations(spark, [("a", "2024-01-01", "1", "u", 1)]))
    table = store.versions(FACT_OBSERVATION)
    number = table.current().number
    Files(spark).create(f"{table.path}/_records/{number + 1:012d}", '{"number": 2, "par')
    assert table.current().number == number and len(stored(store)) == 1
    store.upsert_observations(observations(spark, [("b", "2024-01-01", "1", "u", 1)]))
    assert table.current().number == number + 2 and len(stored(store)) == 2


def test_a_second_writer_is_refused(spark, store):
    store.append(DIM_USER, spark.createDataFrame([("a",)], "user_id string"))
    table = store.versions(DIM_USER)
    base = table.current()
    store.append(DIM_USER, spark.createDataFrame([("b",)], "user_id string"))
    with pytest.raises(RuntimeError, match="one writer"):
        table.publish(base, {})
    assert store.read(DIM_USER).count() == 2


def test_each_touched_day_is_written_once_and_old_files_go(spark, store):
    rows = [(f"k{i}", f"2024-01-0{i % 4 + 1}", "1", "u", i) for i in range(40)]
    store.upsert_observations(observations(spark, rows))
    table = store.versions(FACT_OBSERVATION)
    folders = lambda: {n for n in Files(spark).names(table.path) if n.startswith("version=")}
    first, one = folders(), table.current()
    store.upsert_observations(observations(spark, [("k0", "2024-01-01", "5", "u", 1)]))
    (new,) = folders() - first
    assert Files(spark).names(f"{table.path}/{new}")[1:] == ["day=2024-01-01"]
    assert differing(one.parts, table.current().parts) == ["day=2024-01-01"]
    store.upsert_observations(observations(spark, [("k0", "2024-01-01", "6", "u", 1)]))
    old = f"{table.path}/version={one.parts['day=2024-01-01'][0]}"
    assert "day=2024-01-01" not in Files(spark).names(old) and "day=2024-01-02" in Files(spark).names(old)
    assert store.read(FACT_OBSERVATION).count() == 40


def test_moved_keys_are_found_in_the_buckets_of_the_batch(spark, store, monkeypatch):
    rows = [(f"k{i}", f"2024-01-0{i % 4 + 1}", "1", "u", i) for i in range(400)]
    store.upsert_observations(observations(spark, rows))
    read = []
    real = Versions.read

    def spy(self, schema, parts):
        found = real(self, schema, parts)
        read.append((self.by, [f.split("/")[-2] for f in found.inputFiles()]))
        return found

    monkeypatch.setattr(Versions, "read", spy)
    store.upsert_observations(observations(spark, [("k7", "2024-01-01", "5", "u", 1)]))
    monkeypatch.undo()
    assert len({f for by, files in read for f in files if by == "bucket"}) == 1
    # k7 was on the fourth day and is on the first now; no other day's files are opened.
    assert {f for by, files in read for f in files if by == "day"} == {"day=2024-01-01", "day=2024-01-04"}
    assert stored(store)["k7"] == ("2024-01-01", Decimal(5)) and store.read(FACT_OBSERVATION).count() == 400


def test_the_key_index_follows_appends_truncates_and_many_moves(spark, store, monkeypatch):
    monkeypatch.setattr(key_index, "GATHER", 3)
    row = lambda day, cost: observations(spark, [("a", day, cost, "u", 1)])
    store.upsert_observations(row("2024-01-01", "1"))
    store.append(FACT_OBSERVATION, row("2024-01-02", "2").drop("_seq"))
    store.append(FACT_OBSERVATION, row("2024-01-03", "2").drop("_seq"))
    store.upsert_observations(row("2024-01-04", "3"))
    assert stored(store) == {"a": ("2024-01-04", Decimal(3))} and store.read(FACT_OBSERVATION).count() == 1
    store.truncate(FACT_OBSERVATION)
    store.append(FACT_OBSERVATION, row("2024-01-05", "4").drop("_seq"))
    for i in range(5):
        store.upsert_observations(row(f"2024-02-{i + 1:02d}", str(i)))
    assert store.read(FACT_OBSERVATION).count() == 1
    keys = store.versions(FACT_OBSERVATION).current().keys
    assert all(len(v) <= 3 for v in keys.values())


@pytest.mark.parametrize("skip_unchanged", [False, True])
def test_an_upsert_in_many_slices_is_the_same(spark, store, monkeypatch, skip_unchanged):
    """Rows that stay, change, move to another day, come twice, or have no time."""
    days = ["2024-01-01", "2024-01-02", "2024-01-03", None]
    first = [(f"o{i}", days[i % 4], str(i), "u", i) for i in range(40)]
    second = [(f"o{i}", days[(i + (i % 3 == 0)) % 4], str(i + (i % 2) * 100), "u", i) for i in range(5, 45)]
    second += [(f"o{i}", days[2], "-1", "u", -i) for i in range(5, 45)]
    store.upsert_observations(observations(spark, first), AS_OF)
    monkeypatch.setattr(store_module, "SLICE", 4000)
    written = []
    write = Versions.write
    monkeypatch.setattr(Versions, "write", lambda self, *a, **b: written.append(self.path) or write(self, *a, **b))
    store.upsert_observations(observations(spark, second), AS_OF, skip_unchanged=skip_unchanged)
    assert written.count(store.path(FACT_OBSERVATION)) > 1
    want = {f"o{i}": (str(days[i % 4]), Decimal(i)) for i in range(5)}
    want |= {f"o{i}": (str(days[(i + (i % 3 == 0)) % 4]), Decimal(i + (i % 2) * 100)) for i in range(5, 45)}
    assert stored(store) == want
    assert store.read(FACT_OBSERVATION).count() == 45


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = [manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_an_upsert_leaves_no_shuffle_files(spark, store):
    """Steps of one job do not keep the shuffle files of all steps before."""
    before = shuffle_files(spark)
    setting = spark.conf.get(FREE_SHUFFLES, "false")
    store.upsert_observations(observations(spark, [(f"o{i}", "2024-01-01", "1", "u", i) for i in range(500)]), AS_OF)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(FREE_SHUFFLES, "false") == setting


def test_scores_move_between_days_too(spark, store):
    score = lambda day: spark.createDataFrame([("s", day)], "score_id string, t string").select(
        *[F.col("score_id") if f.name == "score_id" else F.col("t").cast("timestamp").alias(f.name) if f.name == "timestamp"
          else F.lit(None).cast(f.dataType).alias(f.name) for f in FACT_SCORE.schema.fields]
    )
    for day in ("2024-01-01", "2024-01-05", "2024-01-03"):
        store.upsert_scores(score(day))
    assert [str(r["day"]) for r in store.read(FACT_SCORE).collect()] == ["2024-01-03"]


def test_a_table_without_records_is_taken_over(spark, store):
    rows = observations(spark, [("a", "2024-01-01", "1", "u", 1), ("b", "2024-01-02", "2", "u", 1)]).drop("_seq")
    rows.withColumn("day", F.to_date("start_time")).write.partitionBy("day").parquet(store.path(FACT_OBSERVATION))
    spark.createDataFrame([("u", "team")], "user_id string, team string").write.parquet(store.path(DIM_USER))
    assert len(stored(store)) == 2 and store.read(DIM_USER).count() == 1
    store.upsert_observations(observations(spark, [("a", "2024-01-03", "5", "v", 1)]))
    assert stored(store) == {"a": ("2024-01-03", Decimal(5)), "b": ("2024-01-02", Decimal(2))}
    assert {r["user_id"]: r["team"] for r in store.read(DIM_USER).collect()} == {"u": "team", "v": None}


def test_many_small_appends_leave_few_files(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "GATHER", 4)
    for i in range(13):
        store.append(DIM_USER, spark.createDataFrame([(f"u{i}",)], "user_id string").coalesce(1))
    assert store.read(DIM_USER).count() == 13
    assert len(store.read(DIM_USER).inputFiles()) <= 4
    assert len([n for n in Files(spark).names(store.path(DIM_USER)) if n.startswith("version=")]) <= 2 * 4 + 1


def daily(store, use_rollup=True):
    found = mrt_org_daily(store.tables(use_rollup)).select("day", "observations", "total_cost")
    return sorted(map(tuple, found.collect()), key=str)


def hourly(store, use_rollup=True):
    found = mrt_hourly_usage(store.tables(use_rollup)).select("hour", "project_name", "observations", "total_cost")
    return sorted(map(tuple, found.collect()), key=str)


def test_rollups_follow_every_writer(spark, store):
    store.refresh_usage_daily()
    store.refresh_usage_hourly()

    def same():
        assert USAGE_DAILY.name in store.tables() and USAGE_HOURLY.name in store.tables()
        assert daily(store) == daily(store, False)
        assert hourly(store) == hourly(store, False)
        return len(daily(store))

    rows = observations(spark, [("a", "2024-01-01 10:05:00", "1", "u", 1), ("b", "2024-01-02 11:00:00", "2", None, 1)])
    store.upsert_observations(rows, AS_OF)
    assert same() == 2
    store.upsert_observations(rows, AS_OF)
    assert same() == 2
    store.append(FACT_OBSERVATION, observations(spark, [("c", "2024-01-03 10:00:00", "4", "u", 1)]).drop("_seq"))
    assert same() == 3
    store.upsert(FACT_OBSERVATION, observations(spark, [("c", None, "5", "u", 1)]))
    assert same() == 3
    store.truncate(FACT_OBSERVATION)
    assert same() == 0


def test_an_unfinished_write_is_answered_from_the_facts(spark, store, monkeypatch):
    store.refresh_usage_daily()
    row = observations(spark, [("a", "2024-01-01", "1", "u", 1)])
    monkeypatch.setattr(store, "refresh_usage_daily", lost)
    with pytest.raises(RuntimeError):
        store.append(FACT_OBSERVATION, row.drop("_seq"))
    monkeypatch.undo()
    assert USAGE_DAILY.name not in store.tables()
    assert len(daily(store)) == 1
    store.append(FACT_OBSERVATION, observations(spark, [("b", "2024-01-09", "1", "u", 1)]).drop("_seq"))
    assert USAGE_DAILY.name in store.tables()
    assert daily(store) == daily(store, False) and len(daily(store)) == 2


def test_users_are_registered_once_and_keep_their_team(spark, store):
    store.append(DIM_USER, spark.createDataFrame([("known", "Platform")], "user_id string, team string"))
    rows = observations(
        spark,
        [("a", "2024-01-01", "1", "known", 1), ("b", "2024-01-01", "1", "new", 1), ("c", "2024-01-01", "1", None, 1),
         ("d", "2024-01-01", "1", "", 1)],
    )
    for _ in range(2):
        store.upsert_observations(rows, AS_OF)
    assert {r["user_id"]: r["team"] for r in store.read(DIM_USER).collect()} == {"known": "Platform", "new": None}
    assert store.read(DIM_USER).count() == 2


def test_sync_mark(spark, store):
    store.mark_synced(AS_OF)
    store.mark_synced(AS_OF.replace(hour=1))
    rows = store.read(SYNC_STATE).collect()
    assert [(r["key"], r["value"]) for r in rows] == [("last_sync_at", "2024-01-31T01:00:00+00:00")]


def test_append_truncate_replace(spark, store):
    rows = observations(spark, [("a", "2024-01-01", "1", "u", 1)]).drop("_seq")
    store.append(FACT_OBSERVATION, rows)
    store.append(FACT_OBSERVATION, rows)
    assert store.read(FACT_OBSERVATION).count() == 2
    store.truncate(FACT_OBSERVATION)
    assert store.read(FACT_OBSERVATION).count() == 0
    seed_reference_tables(spark, store)
    seed_reference_tables(spark, store)
    assert (store.read(MODEL_PRICES).count(), store.read(TARGETS).count()) == (3, 5)


def test_rollup_answers_like_the_facts(spark, store):
    rows = observations(
        spark, [("a", "2024-01-01", "1", "u", 1), ("b", "2024-01-01", "2", None, 1), ("c", "2024-01-02", "4", "u", 1)]
    )
    store.refresh_usage_daily()
    store.upsert_observations(rows, AS_OF)
    store.upsert_observations(observations(spark, [("c", "2024-01-05", "8", "v", 1)]), AS_OF)
    assert USAGE_DAILY.name in store.tables()
    for mart in (mrt_daily_usage, mrt_org_daily):
        from_rollup = mart(store.tables())
        from_facts = mart(store.tables(use_rollup=False)).select(*from_rollup.columns)
        assert sorted(map(str, from_rollup.collect())) == sorted(map(str, from_facts.collect()))
    assert {str(r["day"]) for r in store.read(USAGE_DAILY).collect()} == {"2024-01-01", "2024-01-05"}


def calls(spark, rows):
    """Rows of (id, start, session, trace, user, model, latency)."""
    frame = spark.createDataFrame(rows, "id string, start string, session string, trace string, user string, model string, ms double")
    given = {"observation_id": F.col("id"), "trace_id": F.col("trace"), "session_id": F.col("session"), "user_id": F.col("user"),
             "model": F.col("model"), "latency_ms": F.col("ms"), "start_time": F.col("start").cast("timestamp"),
             "input_tokens": F.length("id") * 7, "total_cost": F.lit("0.25").cast("decimal(18,6)")}
    return frame.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_OBSERVATION.schema.fields))


QUESTIONS = {
    "sessions": mrt_session,
    "active": lambda t: kpis.kpi_session_stats(t, 20, AS_OF),
    "top": lambda t: kpis.kpi_sessions_top(t, 20, as_of=AS_OF),
    "exact traces": lambda t: mrt_org_daily(t, exact_traces=True),
    "coverage": mrt_policy_coverage,
    "efficiency": mrt_model_efficiency,
    "model by day": mrt_model_daily,
    "model by day, window": lambda t: kpis.kpi_model_daily(t, 20, as_of=AS_OF),
    "model metric": lambda t: dash_model_metric(t, "cost_per_1k_tokens", date(2024, 1, 10), date(2024, 1, 20)),
    "hours": lambda t: kpis.kpi_hourly(t, 20, as_of=AS_OF),
}


def test_sessions_traces_and_latencies_are_answered_from_rollups(spark, store):
    """A session over days and users, a trace in two sessions, rows without time, trace, session, user, model or latency."""
    first = [
        ("a", "2023-12-01 10:00:00", "s", "t1", "u", "m", 10.0), ("b", "2024-01-15 10:00:00", "s", "t1", "u", "m", 20.0),
        ("c", "2024-01-15 11:00:00", "s", "t2", "v", "m", None), ("d", "2024-01-15 12:00:00", "q", "t2", "u", None, 30.0),
        ("e", None, "s", "t3", "u", "n", 50.0), ("f", "2024-01-16 00:00:00", None, "t4", None, "n", 60.0),
        ("g", "2024-01-17 00:00:00", None, None, "u", "n", None), ("h", "2023-11-01 00:00:00", "old", "t5", "u", "n", 5.0),
        ("i", "2024-01-11 00:00:00", "edge", "t6", "u", "n", 5.0), ("j", "2024-01-10 23:59:59", "early", "t7", "u", "n", 5.0),
    ]
    store.refresh_rollups()

    def same():
        stored, facts = store.tables(), store.tables(use_rollup=False)
        for name, question in QUESTIONS.items():
            answer = question(stored)
            assert not any("fact_observation" in path for path in answer.inputFiles()), name
            assert sorted(map(str, answer.collect())) == sorted(map(str, question(facts).collect())), name

    store.upsert_observations(calls(spark, first), AS_OF)
    same()
    # A call moves to another day and session, another is the last of its session that is left.
    store.upsert_observations(calls(spark, [("b", "2024-01-20 10:00:00", "old", "t5", "u", "m", 21.0)]), AS_OF)
    store.append(FACT_OBSERVATION, calls(spark, [(f"x{i}", "2024-01-20 11:00:00", "old", f"t{i % 3}", "u", "m", float(i)) for i in range(9)]))
    same()
    store.truncate(FACT_OBSERVATION)
    same()


def test_latest_by_key_with_a_hot_key(spark):
    """A third of all rows share one key; its latest row is found, the rest kept whole."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"),
        "id",
    )
    got = {r["key"]: r["id"] for r in latest_by_key(rows, ["key"], ["id"]).collect()}
    expected = {}
    for i in range(30_000):
        expected["hot" if i % 3 == 0 else f"k{i % 5000}"] = i
    assert got == expected


def land(folder, rows, name="rows.json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def raw(i, start="2024-01-10T10:00:00Z", **more):
    return {"id": i, "traceId": "t" + i, "startTime": start, "userId": "u", "totalCost": 1, **more}


def test_sync_from_landing(spark, tmp_path, store):
    land(tmp_path / "observations" / "project=p", [raw("a"), raw("old", "2023-01-01T00:00:00Z")])
    land(tmp_path / "scores", [{"id": "s", "traceId": "ta", "value": 1, "timestamp": "2024-01-10T10:00:00Z"}])
    for _ in range(2):
        assert sync_landing(spark, str(tmp_path), store, as_of=AS_OF) == (1, 1)
    assert set(stored(store)) == {"a"} and store.read(FACT_SCORE).count() == 1


@pytest.mark.parametrize("time", [0, 1672531200, 4102444800])
def test_a_false_time_of_writing_loses_no_row(spark, tmp_path, store, time):
    import os

    land(tmp_path / "observations", [raw("a"), raw("old", "2023-01-01T00:00:00Z")], "one.json")
    land(tmp_path / "observations", [raw("b", "2024-01-30T23:00:00Z"), raw("c", None), raw("d", "2024-02-01T00:00:00Z")], "two.json")
    for name in ("one.json", "two.json"):
        os.utime(tmp_path / "observations" / name, (time, time))
    land(tmp_path / "scores", [])
    assert sync_landing(spark, str(tmp_path), store, as_of=AS_OF) == (2, 0)
    assert set(stored(store)) == {"a", "b"}
    assert read_observations(spark, str(tmp_path / "observations"), lookback(AS_OF)).count() == 2


def test_unchanged_files_outside_the_window_are_not_opened_again(spark, tmp_path, store, monkeypatch):
    folder = tmp_path / "observations" / "project=a b"
    land(folder, [raw("a")], "in.json")
    land(folder, [raw("b", "2023-01-01T00:00:00Z")], "out.json")
    land(folder, [], "empty.json")
    seen = SeenFiles(store)

    def opened(rows):
        return sorted({f.rsplit("/", 1)[1] for f in rows.inputFiles()})

    noted = []
    real = seen._note
    monkeypatch.setattr(seen, "_note", lambda files, *rest: (noted.append(files.count()), real(files, *rest)))
    scan = lambda: read_observations(spark, str(tmp_path / "observations"), lookback(AS_OF), seen)
    assert opened(scan()) == ["in.json"] and [(r["id"], r["project"]) for r in scan().collect()] == [("a", "a b")]
    land(folder, [raw("b", "2023-01-01T00:00:00Z"), raw("late", "2024-01-29T00:00:00Z")], "out.json")
    assert opened(scan()) == ["in.json", "out.json"] and {r["id"] for r in scan().collect()} == {"a", "late"}
    assert noted == [2, 0, 1, 0]  # an empty file is not even listed
    assert read_observations(spark, str(tmp_path / "observations"), lookback(AS_OF.replace(year=2020)), seen).count() == 0


def test_sync_from_trace_store(spark, tmp_path, store):
    land(tmp_path / "observations", [{"id": "a", "trace_id": "t", "start_time": "2024-01-10 10:00:00"}])
    land(tmp_path / "scores", [{"id": "s", "trace_id": "t", "value": 1, "timestamp": "2024-01-10 10:00:00"}])
    land(tmp_path / "traces", [{"id": "t", "user_id": "u", "timestamp": "2023-12-20 10:00:00"}])
    sync_trace_store(spark, str(tmp_path), store, AS_OF)
    assert store.read(FACT_OBSERVATION).first()["user_id"] is None
    sync_trace_store(spark, str(tmp_path), store, AS_OF, trace_days=60)
    assert store.read(FACT_OBSERVATION).first()["user_id"] == "u"


def test_session_log_that_grows_in_place(spark, tmp_path, store):
    from tests.test_session_logs import message, write_log

    seed_reference_tables(spark, store)
    events = [message(100, 10, 0)]
    write_log(tmp_path, "p", "s", events)
    assert sync_session_logs(spark, str(tmp_path), store) == 1
    write_log(tmp_path, "p", "s", events + [message(50, 5, 20)])
    assert sync_session_logs(spark, str(tmp_path), store) == 2
    assert sorted(stored(store)) == ["log-s-0", "log-s-1"]


def test_session_sync_follows_the_rollup_and_finds_prices(spark, tmp_path, store):
    from tests.test_session_logs import message, write_log

    store.refresh_usage_daily()
    write_log(tmp_path, "p", "s", [message(100, 10, 0)])
    assert sync_session_logs(spark, str(tmp_path), store) == 1
    assert store.read(MODEL_PRICES).count() == 3
    assert daily(store) == daily(store, False) and len(daily(store)) == 1


def test_stream_names_projects(spark, tmp_path, store):
    land(tmp_path / "in" / "project=p", [raw("a")])
    projects = project_table(spark, [{"id": "p", "name": "Project P"}])
    sync = start_observation_sync(spark, str(tmp_path / "in"), store, str(tmp_path / "c"), True, projects)
    sync.awaitTermination()
    assert [r["project_name"] for r in store.read(FACT_OBSERVATION).collect()] == ["Project P"]


def test_trace_store_stream_takes_context_from_traces(spark, tmp_path, store):
    land(tmp_path / "observations", [{"id": "a", "trace_id": "t", "start_time": "2024-01-10 10:00:00"}])
    land(tmp_path / "traces", [{"id": "t", "user_id": "u", "timestamp": "2023-12-20 10:00:00"}])
    start_trace_store_sync(spark, str(tmp_path), store, str(tmp_path / "check"), True).awaitTermination()
    assert store.read(FACT_OBSERVATION).first()["user_id"] == "u"


def test_stream_replays_and_late_rows(spark, tmp_path, store):
    landing = tmp_path / "landing"
    store.refresh_usage_daily()

    def run(checkpoint):
        start_observation_sync(
            spark, str(landing), store, str(tmp_path / checkpoint), available_now=True
        ).awaitTermination()

    land(landing, [raw("a"), raw("b")], "1.json")
    run("one")
    run("two")
    assert len(stored(store)) == 2
    land(landing, [raw("a", "2024-01-08T10:00:00Z", totalCost=5)], "2.json")
    run("one")
    assert stored(store)["a"] == ("2024-01-08", Decimal(5))
    daily = {str(r["day"]): r["total_cost"] for r in mrt_org_daily(store.tables()).collect()}
    assert daily == {"2024-01-08": Decimal(5), "2024-01-10": Decimal(1)}


def test_score_stream(spark, tmp_path, store):
    landing = tmp_path / "landing"
    land(landing, [{"id": "s", "traceId": "t", "value": 0.5}, {"id": "s", "traceId": "t", "value": 0.75}])
    start_score_sync(spark, str(landing), store, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert [r["value"] for r in store.read(FACT_SCORE).collect()] == [0.75]


def test_rows_sent_again_are_not_counted_again(spark, tmp_path, store):
    store.refresh_usage_hourly()
    landing = tmp_path / "landing"
    for name in ("1.json", "2.json"):
        land(landing, [raw(f"k{i}", f"2024-01-10T{i % 5 + 10}:00:00Z") for i in range(50)] + [raw("none", None)], name)
        start_observation_sync(spark, str(landing), store, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert sum(r[2] for r in hourly(store)) == 51
    assert hourly(store) == hourly(store, False)


def test_policies_upsert_by_rule_key(spark, store):
    rows = spark.createDataFrame([("r", "p1"), ("r", "p2")], "rule_key string, project_id string")
    from tokenledger.operators.store import schema_with_nulls

    wide = schema_with_nulls(rows, DIM_POLICY.schema).coalesce(1)
    assert store.upsert_policies(wide) == 2
    assert store.read(DIM_POLICY).count() == 1
