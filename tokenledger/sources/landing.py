"""Scans of landed telemetry: observations, scores and traces as JSON lines.

Files may lie in ``project=<id>`` folders, one per source project. Every scan
keeps the raw field names, adds ``project`` (NULL without such folders) and
``_seq``, the order of arrival that upserts use to let the later row win.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions.scalars import blank_to_null, days_before, iso_timestamp, utc
from tokenledger.schemas import (
    RAW_OBSERVATION,
    RAW_SCORE,
    RAW_STORE_OBSERVATION,
    RAW_STORE_SCORE,
    RAW_STORE_TRACE,
    RAW_TRACE,
)
from tokenledger.session import pin_utc
from tokenledger.sources.seen_files import SeenFiles

# Fixed value: the window that syncs re-read by default.
LOOKBACK_DAYS = 30
ARRIVAL = "struct<position:struct<file_time:timestamp,file:string,block:bigint>,line:bigint>"


def file_position() -> Column:
    """Where a row comes from: file time, file, block. Streams can carry it too."""
    return F.struct(
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def arrival_order(position: Column) -> Column:
    """Order of arrival: the file position, then the row's place in it."""
    return F.struct(position.alias("position"), F.monotonically_increasing_id().alias("line"))


def with_project_folder(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("project", T.StringType())])


Window = tuple[datetime, datetime]


def _scan(
    spark: SparkSession, path: str, schema: T.StructType, time: str, window: Window | None, seen: SeenFiles | None
) -> DataFrame:
    """Rows of landed files, of the window if there is one.

    With a ledger of seen files, those that hold no event of the window are not opened; without one all files are.
    """
    reader = pin_utc(spark).read.schema(with_project_folder(schema))
    if window is None or seen is None:
        rows = reader.json(path)
    else:
        paths = seen.to_open(path, schema[time], iso_timestamp, window)
        if not paths:
            empty = T.StructType([*with_project_folder(schema).fields, T.StructField("_seq", T._parse_datatype_string(ARRIVAL))])
            return spark.createDataFrame([], empty)
        rows = reader.option("basePath", path).json(paths)
    rows = rows.select("*", arrival_order(file_position()).alias("_seq"))
    return in_window(rows, iso_timestamp(F.col(time)), window)


def lookback(as_of: datetime | None = None, days: int = LOOKBACK_DAYS) -> tuple[datetime, datetime]:
    """The half-open window a sync re-reads."""
    until = utc(as_of)
    return days_before(until, days), until


def in_window(
    rows: DataFrame, at: Column, window: tuple[datetime, datetime] | None
) -> DataFrame:
    """Rows from the window's start on and before its end."""
    if window is None:
        return rows
    return rows.where((at >= F.lit(window[0])) & (at < F.lit(window[1])))


def read_observations(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Landed observations. There is no row limit and no paging."""
    return _scan(spark, path, RAW_OBSERVATION, "startTime", window, seen)


def read_scores(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Landed scores, flat or with a nested subject."""
    return _scan(spark, path, RAW_SCORE, "timestamp", window, seen)


def read_traces(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Landed traces. The window is on the trace's own time, so give it a wider
    one than observations get: an older trace cannot enrich a newer observation
    it was not read with."""
    return _scan(spark, path, RAW_TRACE, "timestamp", window, seen)


def _renamed(rows: DataFrame, schema: T.StructType, columns: Mapping[str, Column]) -> DataFrame:
    out = [columns.get(f, F.lit(None).cast("string")).alias(f) for f in schema.fieldNames()]
    return rows.select(*out, "project", "_seq")


def read_store_observations(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Observation rows exported from a trace store, in the raw observation shape.

    User, session and tags live on the trace there and come from enrichment.
    """
    return store_observations(_scan(spark, path, RAW_STORE_OBSERVATION, "start_time", window, seen))


def store_observations(rows: DataFrame) -> DataFrame:
    """Exported rows in the raw observation shape, from a scan or a stream."""
    model = F.coalesce(
        blank_to_null(F.col("provided_model_name")), F.col("internal_model_id"), F.lit("")
    )
    return _renamed(
        rows,
        RAW_OBSERVATION,
        {
            "id": F.col("id"),
            "traceId": F.col("trace_id"),
            "projectId": F.col("project_id"),
            "type": F.col("type"),
            "name": F.col("name"),
            "model": model,
            "startTime": F.col("start_time"),
            "endTime": F.col("end_time"),
            "usageDetails": F.col("usage_details"),
            "costDetails": F.col("cost_details"),
            "totalCost": F.col("total_cost"),
            "level": F.col("level"),
            "statusMessage": F.col("status_message"),
            "environment": F.col("environment"),
        },
    )


def read_store_scores(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Score rows exported from a trace store, in the raw score shape."""
    rows = _scan(spark, path, RAW_STORE_SCORE, "timestamp", window, seen)
    columns = {
        "id": F.col("id"),
        "traceId": F.col("trace_id"),
        "observationId": F.col("observation_id"),
        "projectId": F.col("project_id"),
        "subject": F.lit(None).cast(RAW_SCORE["subject"].dataType),
        **{c: F.col(c) for c in ("name", "value", "source", "timestamp")},
    }
    return _renamed(rows, RAW_SCORE, columns)


def read_store_traces(
    spark: SparkSession, path: str, window: Window | None = None, seen: SeenFiles | None = None
) -> DataFrame:
    """Trace rows exported from a trace store, in the raw trace shape."""
    return store_traces(_scan(spark, path, RAW_STORE_TRACE, "timestamp", window, seen))


def store_traces(rows: DataFrame) -> DataFrame:
    """Exported traces in the raw trace shape, from a scan or a stream."""
    columns = {
        "userId": F.col("user_id"),
        "sessionId": F.col("session_id"),
        **{c: F.col(c) for c in ("id", "environment", "tags", "timestamp")},
    }
    return _renamed(rows, RAW_TRACE, columns)


def named(rows: DataFrame, projects: DataFrame | None) -> DataFrame:
    """Source project names by folder; the list of projects is configuration-sized."""
    return rows if projects is None else rows.join(projects, "project", "left")


def project_table(spark: SparkSession, projects: Iterable[Mapping[str, str]]) -> DataFrame:
    """Configured projects as (project, project_name).

    A project without an id goes by its name, else by its key; one without a
    name goes by its id.
    """
    rows = []
    for p in projects:
        project = p.get("id") or p.get("name") or p.get("key")
        rows.append((project, p.get("name") or project))
    return spark.createDataFrame(rows, "project string, project_name string")
