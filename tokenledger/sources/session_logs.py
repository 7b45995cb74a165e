"""Scan of per-session event logs: ``<root>/<project>/<session>/<log file>``.

One JSON event per line. Logs are found by file name below the root, listed in
parallel; the two folders above a file name its project and session. Compressed logs should be landed as ``.zst``: the same
bytes named ``.zstd`` are planned as splittable, which fails on files above the
split size unless ``spark.sql.files.maxPartitionBytes`` and
``spark.sql.files.openCostInBytes`` exceed the largest file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.scalars import utc
from tokenledger.schemas import SESSION_EVENT
from tokenledger.session import pin_utc, setting

LOG_NAME = "session.jsonl.zst*"

# Lines of one log that a single window task orders; longer logs take several.
CHUNK_LINES = 1 << 20

# Folders of logs whose files and read tasks the driver holds at a time.
LOGS_AT_ONCE = 10_000
# Read tasks of so many logs; of more, up to 32 are run as one.
READ_TASKS = 100
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Spark keeps what it has listed, up to this size, though these folders are listed once.
LISTED_CACHE = "spark.sql.hive.filesourcePartitionFileCacheSize"


def read_session_events(
    spark: SparkSession,
    root: str | Sequence[str],
    name: str = LOG_NAME,
    changed_since: datetime | None = None,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Parsed events with their file, position and the folder names above them, below a root or some folders.

    ``line`` rises within a file and ``chunk`` cuts a file into runs of lines;
    blank lines and lines that are not JSON are left out. ``changed_since`` reads
    only logs written to after that time: a log depends on no other log, so the
    ones left out would yield the same rows again.
    """
    reader = pin_utc(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if changed_since is not None:
        reader = reader.option("modifiedAfter", utc(changed_since).strftime("%Y-%m-%dT%H:%M:%S"))
    if not isinstance(root, str):
        # Folders as they are named: one may have a bracket in its name.
        root, reader = list(root), reader.option("__globPaths__", "false")
    # The JSON scan parses a line once and skips blank ones; a line that is not an
    # event has no type.
    path = F.col("_metadata.file_path")
    events = reader.schema(SESSION_EVENT).json(root).select(
        path.alias("file"),
        _folder(path, 3).alias("project_folder"),
        _folder(path, 2).alias("session_folder"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
        ).alias("line"),
        "type",
        "id",
        "time",
        F.col("data.usage").alias("usage"),
        F.col("data.message.source.model").alias("model"),
    )
    run = F.floor(F.col("line.position") / chunk_lines)
    return events.where(F.col("type").isNotNull()).withColumn(
        "chunk", F.struct(F.col("line.block").alias("block"), run.alias("run"))
    )


def spool_session_events(
    spark: SparkSession,
    root: str,
    path: str,
    name: str = LOG_NAME,
    changed_since: datetime | None = None,
    at_once: int = LOGS_AT_ONCE,
) -> DataFrame:
    """The same events, written to ``path`` for some folders of sessions at a time.

    There is a file for each session, and a scan keeps them all in the driver, with a task for every few. This way the driver holds
    those of ``at_once`` folders, whatever their number, and a log is parsed once.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    with setting(LISTING_TASKS, str(tasks), "10000", spark), setting(LISTED_CACHE, "0", str(250 << 20), spark):
        for folders in batched(_session_folders(spark, root), at_once):
            events = read_session_events(spark, root if folders == (root,) else folders, name, changed_since)
            planned = events.rdd.getNumPartitions()
            events = events.coalesce(max(READ_TASKS, tasks, planned // 32))
            events.write.mode("append").parquet(path, compression="zstd")
    return spark.read.parquet(path)


def _session_folders(spark: SparkSession, root: str) -> Iterator[str]:
    """What lies in the project folders of a root, one of these after the other, and files in the root itself.

    The root where there are no project folders.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*")) or []
    entries = [(s.getPath(), s.isDirectory()) for s in found if _seen(s.getPath().getName())]
    if not any(is_folder for _, is_folder in entries):
        yield root
        return
    for entry, is_folder in entries:
        if not is_folder:
            yield entry.toString()
            continue
        # One string for all of them: a call for each would take minutes where there are many.
        paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(entry))
        listed = jvm.scala.runtime.ScalaRunTime.genericWrapArray(paths).mkString("\0")
        yield from (p for p in listed.split("\0") if p and _seen(p.rpartition("/")[2]))


def _seen(name: str) -> bool:
    """Whether Spark's own listing would look at it."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def _folder(path: Column, from_end: int) -> Column:
    """A folder of a path counted from its end, without a ``key=`` in front."""
    name = F.substring_index(F.substring_index(path, "/", -from_end), "/", 1)
    return F.regexp_replace(F.url_decode(name), "^[A-Za-z_]+=", "")
