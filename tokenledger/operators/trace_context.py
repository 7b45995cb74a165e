"""Context of observations from traces that arrive before, with or after them.

Traces are kept in a table of their own, the newest row of each. Beside it a list by trace, in buckets of a hash of the trace
id, says which observations named the trace and what context they brought themselves. A batch of observations reads only
the days of the trace table that hold its traces (by the key index). A batch of traces reads only the buckets of its traces and
the days of the facts that hold their observations. In the end the facts hold what one enrichment of all rows gives, whatever
the order of arrival: a trace that changes replaces what an earlier row of it filled in.

The list knows the observations that came through here. Rows that another sync wrote since keep the trace they name, but
their own context counts as the list has it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions.scalars import days_before, iso_timestamp, utc
from tokenledger.operators.enrich import CONTEXT, enrich_from_traces
from tokenledger.operators.latest import latest_by_key
from tokenledger.operators.normalize import normalize_observations
from tokenledger.operators.store import SPOOLED, Store
from tokenledger.operators.versions import GATHER, Parts, Versions
from tokenledger.schemas import FACT_OBSERVATION, STORED_TRACE, struct_of
from tokenledger.session import scratch_dir, shuffles_freed

BUCKET = "bucket"
CALL = T.StructType(
    [
        *struct_of(traceId="text", id="text", **dict.fromkeys(CONTEXT, "text"), at="ts", number="bigint").fields,
        T.StructField(BUCKET, T.IntegerType()),
    ]
)
# Columns of the facts by the context field that they hold.
FACT_CONTEXT = dict(zip(CONTEXT, ("user_id", "session_id", "environment", "tags"), strict=True))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


class TraceContext:
    """The traces of a store and the list of observations by trace."""

    def __init__(self, store: Store, keep_days: int | None = None, as_of: datetime | None = None):
        """``keep_days`` bounds the list: an observation that began longer before ``as_of`` (default: now) is no longer filled
        by traces that arrive then. Without it nothing is left out."""
        self.store = store
        self.as_of = as_of
        self.since = None if keep_days is None else days_before(utc(as_of), keep_days)
        self.calls = Versions(store.spark, f"{store.root}/_calls_by_trace", BUCKET)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("traceId"), F.lit(self.store.key_buckets)).cast("int")

    def _entries(self, parts: Parts) -> DataFrame:
        """What the newest arrival of each observation brought, by the trace that it named."""
        found = self.calls.read(CALL, parts)
        if self.since is not None:
            found = found.where(F.col("at").isNull() | (F.col("at") >= F.lit(self.since)))
        return latest_by_key(found, ["traceId", "id"], ["number"])

    def take_traces(self, traces: DataFrame) -> int:
        """Store raw traces and fill the observations that named them before; the number of traces given."""
        named = traces.where(_given("id")).withColumn("at", iso_timestamp(F.col("timestamp")))
        count = self.store.upsert(STORED_TRACE, named, skip_unchanged=True)
        if count:
            with shuffles_freed(self.store.spark, traces.sparkSession):
                self._refill(named.select(F.col("id").alias("traceId")).distinct())
        return count

    def _refill(self, traces: DataFrame) -> None:
        live = self.calls.current().parts
        buckets = {f"{BUCKET}={r[0]}" for r in traces.select(self._bucket()).distinct().collect()}
        touched = {b: v for b, v in live.items() if b in buckets}
        if not touched:
            return
        calls = self._entries(touched).join(traces, "traceId", "left_semi")
        absent = {c: F.lit(None).cast("string") for c in ("startTime", "usageDetails")}
        # Written once: finding the days, reading them and the upsert would each work it out again.
        path = scratch_dir(self.store.spark, "filled")
        self._enriched(calls.withColumns(absent), traces).select(
            F.col("id").alias("observation_id"),
            F.col("traceId").alias("_trace"),
            *(F.col(c).alias(f"_{f}") for c, f in FACT_CONTEXT.items()),
        ).write.parquet(path, **SPOOLED)
        filled = self.store.spark.read.parquet(path)
        # One join, by the key of the facts alone; an observation may have named several traces.
        facts = self.store.days_of_keys(FACT_OBSERVATION, filled)
        rows = facts.join(filled, "observation_id").where(F.col("trace_id") == F.col("_trace")).withColumns(
            {f: F.col(f"_{f}") for f in FACT_CONTEXT.values()}
        )
        self.store.upsert_observations(rows, self.as_of, key_may_move=False, skip_unchanged=True)
        self.store.delete(path)

    def _enriched(self, observations: DataFrame, traces: DataFrame) -> DataFrame:
        stored = self.store.of_keys(STORED_TRACE, traces.select(F.col("traceId").alias("id")))
        return enrich_from_traces(observations, stored.withColumn("_seq", F.lit(0)))

    def take_observations(self, observations: DataFrame) -> int:
        """Upsert raw observations with the context of the traces stored so far; the number given."""
        with shuffles_freed(self.store.spark, observations.sparkSession):
            traces = observations.where(_given("traceId")).select("traceId").distinct()
            rows = normalize_observations(self._enriched(observations, traces))
            count = self.store.upsert_observations(rows, self.as_of)
            if count:
                self._note(observations)
        return count

    def _note(self, observations: DataFrame) -> None:
        """Add observations to the list. Buckets that have come to GATHER versions are gathered, without what is too old."""
        base = self.calls.current()
        number = base.number + 1
        newest = latest_by_key(observations.select("id", "traceId", *CONTEXT, "startTime", "_seq"), ["id"], ["_seq"])
        rows = newest.where(_given("traceId")).select(
            "traceId",
            "id",
            *CONTEXT,
            iso_timestamp(F.col("startTime")).alias("at"),
            F.lit(number).cast("bigint").alias("number"),
            self._bucket().alias(BUCKET),
        )
        many = {b: v for b, v in base.parts.items() if len(v) >= GATHER}
        if many:
            rows = rows.unionByName(self._entries(many))
        version, filled = self.calls.write(rows, number, ("traceId",))
        changed = {b: [] for b in many} | {b: [*([] if b in many else base.parts.get(b, [])), version] for b in filled}
        self.calls.publish(base, changed)
