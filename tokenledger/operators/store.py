"""Idempotent upserts over Parquet tables, without a table format.

Fact tables are partitioned by ``day``. An upsert writes the days it touches once, as a new version, and takes them live
with one small record (see ``versions``): a run that dies before it has changed nothing, and readers never see half a
write. Which days hold older rows of the batch's keys is read from a key index (see ``key_index``), in the buckets of
the batch alone. One writer per table; a second one is refused.

Stored roll-ups of the observations follow every write to them. A roll-up notes which record of the facts it was computed
from; while that is not the newest one, questions are answered from the facts, and the next write brings the roll-up up to
date in just the days that differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions.scalars import day_bucket, utc
from tokenledger.operators.key_index import KeyIndex
from tokenledger.operators.latest import latest_by_key
from tokenledger.operators.versions import GATHER, Files, Record, Versions, differing
from tokenledger.schemas import (
    DIM_POLICY,
    DIM_USER,
    FACT_GOVERNANCE,
    FACT_GOVERNANCE_DIVERGENCE,
    FACT_OBSERVATION,
    FACT_SCORE,
    ROLLUPS,
    SYNC_STATE,
    TABLES,
    USAGE_DAILY,
    USAGE_HOURLY,
    USAGE_MODELS,
    USAGE_TRACES,
    TableSpec,
)
from tokenledger.session import pin_utc, scratch_dir, shuffles_freed
from tokenledger.tables import Tables

KEY_BUCKETS = 64

#: Bytes of stored files that one step of an upsert shuffles at a time, so that its shuffle files do not grow with the table.
SLICE = 1 << 30
#: For batches on disk: written once, read a few times, deleted.
SPOOLED = {"compression": "zstd"}


#: Folder of the day of rows without an event time.
NO_DAY = "day=__HIVE_DEFAULT_PARTITION__"


def _folder(day: date | None) -> str:
    return NO_DAY if day is None else f"day={day.isoformat()}"


def _folder_of(day: Column) -> Column:
    return F.when(day.isNull(), NO_DAY).otherwise(F.concat(F.lit("day="), day.cast("string")))


def _without_equals(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have no stored row equal in every column, matched by the key alone."""
    rest = [c for c in rows.columns if c not in keys]
    other = stored.select(*keys, F.struct(*rest).alias("_stored"))
    changed = F.col("_stored").isNull()
    for c in rest:
        changed = changed | ~F.col(c).eqNullSafe(F.col("_stored")[c])
    return rows.join(other, list(keys), "left").where(changed).select(*rows.columns)


@dataclass
class Batch:
    """A batch on disk: read several times, computed once."""

    rows: DataFrame
    count: int
    path: str


class Store:
    """Tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int = KEY_BUCKETS):
        """``key_buckets`` is fixed for the life of the tables; choose it so that a bucket of all keys is some 128 MB."""
        self.spark = pin_utc(spark)
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets
        self._files = Files(self.spark)

    # -- paths ----------------------------------------------------------------

    def path(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.name}"

    def versions(self, spec: TableSpec) -> Versions:
        return Versions(self.spark, self.path(spec), "day" if "day" in spec.stored_schema.fieldNames() else None)

    def _index(self, spec: TableSpec) -> KeyIndex:
        return KeyIndex(self.spark, f"{self.root}/_keys/{spec.name}", spec, self.key_buckets)

    # -- reading ----------------------------------------------------------------

    def read(self, spec: TableSpec, days: Sequence[str] | None = None) -> DataFrame:
        """The table with its fixed schema, or some of its day folders; columns newer than a file are NULL in it."""
        return self._read(spec, self.versions(spec).current(), days)

    def _read(self, spec: TableSpec, record: Record, days: Sequence[str] | None = None) -> DataFrame:
        parts = record.parts if days is None else {d: record.parts.get(d, []) for d in days}
        return self.versions(spec).read(spec.stored_schema, parts)

    def of_keys(self, spec: TableSpec, wanted: DataFrame) -> DataFrame:
        """The stored rows of some keys. Where there is a key index, only days that may hold them are read."""
        return self.days_of_keys(spec, wanted).join(wanted.select(*spec.keys).distinct(), list(spec.keys), "left_semi")

    def days_of_keys(self, spec: TableSpec, wanted: DataFrame) -> DataFrame:
        """All stored rows of the days that ``of_keys`` reads."""
        base = self.versions(spec).current()
        return self._read(spec, base, None if base.keys is None else self._index(spec).holding(base.keys, wanted))

    def _rollups(self) -> list[TableSpec]:
        """Those that have been made; a record says so, also where they have no rows."""
        return [r for r in ROLLUPS if self.versions(r).current().of is not None]

    def tables(self, use_rollup: bool = True) -> Tables:
        """All tables, with the stored roll-ups that are up to date with the observations."""
        specs = dict(TABLES)
        if use_rollup and (rollups := self._rollups()):
            number = self.versions(FACT_OBSERVATION).current().number
            specs |= {r.name: r for r in rollups if self.versions(r).current().of == number}
        return Tables(self.spark, {n: lambda spec=spec: self.read(spec) for n, spec in specs.items()})

    def delete(self, path: str) -> None:
        """Delete a scratch folder."""
        self._files.delete(path)

    # -- plain writes -------------------------------------------------------------

    def _with_day(self, spec: TableSpec, rows: DataFrame) -> DataFrame:
        if spec.event_time is None:
            return rows
        return rows.withColumn("day", day_bucket(F.col(spec.event_time)))

    def append(self, spec: TableSpec, rows: DataFrame) -> None:
        """Bulk append without looking at keys; missing columns become NULL.

        A day, or an undivided table, that has come to GATHER versions is gathered in one, so that many small appends
        leave few files.
        """
        table = self.versions(spec)
        base = table.current()
        shaped = self._with_day(spec, schema_with_nulls(rows, spec.schema)).select(*spec.stored_schema.fieldNames())
        version, filled = table.write(shaped, base.number + 1, spec.cluster)
        changed = {p: [*base.parts.get(p, []), version] for p in filled}
        if many := {p: v for p, v in changed.items() if len(v) > GATHER}:
            gathered = table.read(spec.stored_schema, many)
            gathered = gathered if table.by else gathered.hint("rebalance")
            version, filled = table.write(gathered, base.number + 1, spec.cluster)
            changed |= {p: [version] for p in filled}
        keys = base.keys
        if keys is not None:
            new = table.read(spec.stored_schema, {p: [version_] for p, (*_, version_) in changed.items()})
            keys = self._index(spec).added(keys, new.select(*spec.keys, _folder_of(F.col("day")).alias("part")), base.number + 1)
        table.publish(base, changed, self._index(spec).files, keys=keys)
        self._follow(spec)

    def truncate(self, spec: TableSpec) -> None:
        """Empty the table."""
        table = self.versions(spec)
        base = table.current()
        table.publish(base, {p: [] for p in base.parts}, self._index(spec).files, keys=None)
        self._follow(spec)

    def replace(self, spec: TableSpec, rows: DataFrame) -> None:
        """Load a small reference table whole."""
        table = self.versions(spec)
        base = table.current()
        version, filled = table.write(rows.select(*spec.columns), base.number + 1)
        table.publish(base, {p: [] for p in base.parts} | {p: [version] for p in filled})

    # -- upsert -------------------------------------------------------------------

    def _spool(self, spec: TableSpec, rows: DataFrame) -> Batch:
        """Write the batch once, so that its source is not read again per use."""
        checked = [
            F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{spec.name}: NULL in key column {c}")))
            .otherwise(F.col(c))
            .alias(c)
            if c in spec.keys
            else F.col(c)
            for c in spec.columns
        ]
        order = F.col("_seq") if "_seq" in rows.columns else F.struct(F.monotonically_increasing_id())
        path = scratch_dir(self.spark, f"batch-{spec.name}")
        shaped = rows.select(*checked, order.alias("_seq"))
        self._with_day(spec, shaped).write.parquet(path, **SPOOLED)
        spooled = self.spark.read.parquet(path)
        return Batch(spooled, spooled.count(), path)

    def _days(self, rows: DataFrame) -> list[str]:
        """Day folders of some rows: one small value per partition, whatever the row count."""
        return [_folder(r["day"]) for r in rows.select("day").distinct().collect()]

    def upsert(
        self,
        spec: TableSpec,
        rows: DataFrame,
        key_may_move: bool = True,
        skip_unchanged: bool = False,
    ) -> int:
        """Replace rows by key; of equal keys the last to arrive wins.

        ``rows`` may carry ``_seq``, the order of arrival; without it the order
        is that of the plan. Returns the number of rows given.

        A row whose event time moved to another day leaves its old partition, which the key index knows.
        ``key_may_move=False`` spares reading the index; pass it only when the source guarantees that a key keeps
        its day.

        ``skip_unchanged`` first leaves out rows that are stored as they are. A
        sync that re-reads weeks of data then rewrites only the days in which
        something changed.
        """
        with shuffles_freed(self.spark, rows.sparkSession):
            batch = self._spool(spec, rows)
            if batch.count:
                self._merge(spec, batch, key_may_move, skip_unchanged)
            self._files.delete(batch.path)
        return batch.count

    def _merge(self, spec: TableSpec, batch: Batch, key_may_move: bool, skip_unchanged: bool) -> None:
        base, size = self.versions(spec).current(), self._files.size(batch.path)
        if skip_unchanged:
            days = list(base.parts) if spec.event_time is None else self._days(batch.rows)
            stored = self._read(spec, base, days)
            size += self.versions(spec).size({d: base.parts.get(d, []) for d in days})
        # Written once: the index and the days read it several times, and each would group the batch again.
        path = scratch_dir(self.spark, f"changed-{spec.name}")
        slices = -(-size // SLICE) or 1
        for i in range(slices):

            def part(rows: DataFrame, i: int = i) -> DataFrame:
                return rows if slices == 1 else rows.where(F.pmod(F.xxhash64(*spec.keys), F.lit(slices)) == i)

            latest = latest_by_key(part(batch.rows), spec.keys, ["_seq"]).select(*spec.stored_schema.fieldNames())
            if skip_unchanged:
                latest = _without_equals(latest, part(stored), spec.keys)
            latest.write.mode("append").parquet(path, **SPOOLED)
        changed = self.spark.read.schema(spec.stored_schema).parquet(path)
        if not changed.isEmpty():
            self._rewrite(spec, base, changed, key_may_move, self._files.size(path))
        self._files.delete(path)

    def _slices(self, spec: TableSpec, base: Record, touched: Sequence[str], size: int) -> list[list[str]]:
        """Parts to be written together; `size` is that of the rows that go into all of them."""
        slices, room = [[]], SLICE
        for part in touched:
            room -= self.versions(spec).size({part: base.parts.get(part, [])}) + size // len(touched)
            slices[-1].append(part)
            if room <= 0:
                slices, room = [*slices, []], SLICE
        return [s for s in slices if s] or [[]]

    def _rewrite(self, spec: TableSpec, base: Record, latest: DataFrame, key_may_move: bool, size: int = 0) -> None:
        """Replace the stored rows of the keys of `latest`, which has one row a key and `size` bytes."""
        table, keys, on = self.versions(spec), base.keys, list(spec.keys)
        if spec.event_time is None:
            touched = list(base.parts)
        else:
            touched, number, index = self._days(latest), base.number + 1, self._index(spec)
            parts = latest.select(*on, _folder_of(F.col("day")).alias("part"))
            if keys is None and key_may_move:
                # The first upsert: once, the keys of all days.
                stored = self._read(spec, base).select(*on, _folder_of(F.col("day")).alias("part"))
                keys = index.added({}, stored, base.number) if base.parts else {}
            if key_may_move:
                keys, left = index.moved(keys, parts, number)
                touched = sorted({*touched, *left})
            elif keys is not None:
                keys = index.added(keys, parts, number, reset=True)
        changed, slices = {p: [] for p in touched}, self._slices(spec, base, touched, size)
        for some in slices:
            merged = latest if len(slices) == 1 else latest.where(_folder_of(F.col("day")).isin(some))
            if base.parts:
                stored = self._read(spec, base, some)
                merged = stored.join(latest.select(*on), on, "left_anti").unionByName(merged)
            version, filled = table.write(merged, base.number + 1, spec.cluster)
            changed |= {p: [version] for p in filled}
        table.publish(base, changed, self._index(spec).files, keys=keys)
        self._follow(spec)

    def recover(self, spec: TableSpec) -> bool:
        """Delete what runs that died have left behind; true if there was anything. Answers never depend on it."""
        table = self.versions(spec)
        records = table.records()
        left = table.vacuum([r.parts for r in records])
        return left + self._index(spec).files.vacuum([r.keys or {} for r in records]) > 0

    # -- the tables -----------------------------------------------------------------

    def upsert_observations(
        self,
        rows: DataFrame,
        as_of: datetime | None = None,
        key_may_move: bool = True,
        skip_unchanged: bool = False,
    ) -> int:
        """Upsert observations, register their users and note the time of the sync."""
        spec = FACT_OBSERVATION
        with shuffles_freed(self.spark, rows.sparkSession):
            batch = self._spool(spec, rows)
            if batch.count:
                self._merge(spec, batch, key_may_move, skip_unchanged)
                self.register_users(batch.rows)
                self.mark_synced(as_of)
            self._files.delete(batch.path)
        return batch.count

    def upsert_scores(self, rows: DataFrame, skip_unchanged: bool = False) -> int:
        return self.upsert(FACT_SCORE, rows, skip_unchanged=skip_unchanged)

    def upsert_policies(self, rows: DataFrame) -> int:
        """Upsert by rule key alone: the same key in two projects is one policy."""
        return self.upsert(DIM_POLICY, rows)

    def upsert_governance(self, rows: DataFrame) -> int:
        return self.upsert(FACT_GOVERNANCE, rows)

    def upsert_governance_divergence(self, rows: DataFrame) -> int:
        return self.upsert(FACT_GOVERNANCE_DIVERGENCE, rows)

    def register_users(self, rows: DataFrame) -> None:
        """Add users not seen before; known users keep their team."""
        ids = rows.where(F.col("user_id") != "").select("user_id").distinct()
        unseen = ids.join(self.read(DIM_USER).select("user_id"), "user_id", "left_anti")
        # Mostly nobody is new; then no file is added.
        if not unseen.isEmpty():
            self.append(DIM_USER, unseen)

    def mark_synced(self, as_of: datetime | None = None) -> None:
        """Note the time of the last sync, the only row this table has."""
        at = utc(as_of)
        row = self.spark.range(1, numPartitions=1).select(
            F.lit("last_sync_at").alias("key"),
            F.lit(at.isoformat()).alias("value"),
            F.lit(at).alias("updated_at"),
        )
        self.replace(SYNC_STATE, row)

    # -- stored roll-ups ----------------------------------------------------------------

    def _follow(self, spec: TableSpec) -> None:
        """Bring the roll-ups that there are up to date with the newest record of the observations."""
        if spec.name != FACT_OBSERVATION.name:
            return
        facts = self.versions(spec)
        now = facts.current()
        for rollup in self._rollups():
            then = facts.record(self.versions(rollup).current().of)
            days = None if then is None else differing(then.parts, now.parts)
            getattr(self, f"refresh_{rollup.name}")(days)

    def refresh_usage_daily(self, days: Sequence[str] | None = None) -> None:
        """Recompute the daily roll-up for some day folders, or for all. From the first time on it is kept current."""
        from tokenledger.plans.marts import usage_daily

        self._refresh(USAGE_DAILY, usage_daily, [*USAGE_DAILY.columns[1:], "day"], days)

    def refresh_usage_hourly(self, days: Sequence[str] | None = None) -> None:
        """The same for usage by hour and project; rows without a start time are an hour of their own."""
        from tokenledger.plans.marts import hourly_usage_of

        def with_day(facts: DataFrame) -> DataFrame:
            return hourly_usage_of(facts).withColumn("day", day_bucket(F.col("hour")))

        self._refresh(USAGE_HOURLY, with_day, [*USAGE_HOURLY.columns, "day"], days)

    def refresh_usage_traces(self, days: Sequence[str] | None = None) -> None:
        """The same for usage by session, user, project and trace of a day."""
        from tokenledger.plans.marts import usage_traces

        self._refresh(USAGE_TRACES, usage_traces, [*USAGE_TRACES.columns[1:], "day"], days)

    def refresh_usage_models(self, days: Sequence[str] | None = None) -> None:
        """The same for tokens, cost and latency by model and day."""
        from tokenledger.plans.marts import usage_models

        self._refresh(USAGE_MODELS, usage_models, [*USAGE_MODELS.columns[1:], "day"], days)

    def refresh_rollups(self) -> None:
        """Make all roll-ups, or make them anew."""
        for rollup in ROLLUPS:
            getattr(self, f"refresh_{rollup.name}")()

    def _refresh(self, spec: TableSpec, usage, columns: Sequence[str], days: Sequence[str] | None) -> None:
        facts = self.versions(FACT_OBSERVATION).current()
        table = self.versions(spec)
        base = table.current()
        dropped = {p: [] for p in (base.parts if days is None else days)}
        filled = {}
        if facts.parts and (days is None or days):
            rows = usage(self._read(FACT_OBSERVATION, facts, days)).select(*columns)
            version, parts = table.write(rows, base.number + 1, gather=False)
            filled = {p: [version] for p in parts}
        table.publish(base, dropped | filled, of=facts.number)


def schema_with_nulls(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows widened to a newer schema: columns they lack are NULL."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return empty.unionByName(rows, allowMissingColumns=True).select(*schema.fieldNames())
