"""The set of tables a question is asked over."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.scalars import day_bucket
from tokenledger.schemas import ROLLUPS, TABLES


Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """Tables by name; one that was never written is empty, not an error.

    A table may be given as a function that opens it, which is called on first
    use only. ``usage_daily``, ``usage_hourly``, ``usage_traces`` and ``usage_models``
    are special: when present they are stored roll-ups, and what adds up by day,
    hour, trace or model is answered from them instead of from the fact table.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source]):
        self.spark = spark
        self._sources = dict(sources)

    def __getitem__(self, name: str) -> DataFrame:
        source = self._sources.get(name)
        if source is None:
            spec = {r.name: r for r in ROLLUPS}.get(name) or TABLES[name]
            return self.spark.createDataFrame([], spec.stored_schema)
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def with_frames(self, **sources: Source) -> Tables:
        return Tables(self.spark, {**self._sources, **sources})

    def observations(self, since: datetime | None = None) -> DataFrame:
        """Observation facts with their ``day``, optionally from an instant on.

        Windows have no upper bound. On the stored table ``day`` is the
        partition column, so a lower bound is given on both columns: one prunes
        folders, the other row groups.
        """
        facts = self["fact_observation"]
        stored_day = "day" in facts.columns
        if since is not None:
            facts = facts.where(F.col("start_time") >= F.lit(since))
            if stored_day:
                facts = facts.where(F.col("day") >= F.lit(since.date()))
        return facts if stored_day else facts.withColumn("day", day_bucket(F.col("start_time")))
