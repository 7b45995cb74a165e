"""Spark session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

# Spark's setting that an action takes its shuffle files with it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "tokenledger", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with UTC day buckets and adaptive execution.

    ``shuffle_partitions`` is the starting number only; adaptive execution
    coalesces it, so give a cluster a high one.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Day and hour buckets are UTC whatever the session was started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def setting(key: str, value: str, default: str, *sessions: SparkSession) -> Iterator[None]:
    """A setting of some sessions inside, and as it was afterwards."""
    before = [(s, s.conf.get(key, default)) for s in sessions]
    for s in sessions:
        s.conf.set(key, value)
    try:
        yield
    finally:
        for s, old in reversed(before):
            s.conf.set(key, old)


def shuffles_freed(*sessions: SparkSession) -> AbstractContextManager[None]:
    """Actions inside delete their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage, and a job of many steps keeps those of all its steps.
    """
    return setting(FREE_SHUFFLES, "true", "false", *sessions)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, in the cluster's shared folder.

    The shared folder is the one named by ``spark.checkpoint.dir``. In local
    mode, where one machine is the cluster, a temporary folder may stand in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tokenledger-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
