"""A ledger of landed files: what has been seen, and between which event times the rows of each file lie.

A sync lists the landing, which opens nothing, and compares the list with the ledger. Files that are new, or whose length or
time of writing changed, are looked through once for their least and greatest event time. Then only files that hold events
of the window are read. When a file was written never decides this by itself, so unpacked archives, connectors that report
no time and events stamped ahead lose no row. A file whose content is replaced by one of the same length and time of
writing is taken for the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.operators.store import Store
from tokenledger.schemas import LANDED_FILE
from tokenledger.session import scratch_dir


def listing(store: Store, folder: str) -> DataFrame:
    """file (as rows name it), path, length and modified of all files below a folder."""
    return (
        store.spark.read.format("binaryFile")
        .load(folder)
        .select(
            F.col("_metadata.file_path").alias("file"), "path", "length", F.col("modificationTime").alias("modified")
        )
    )


class SeenFiles:
    """The ledger of a store."""

    def __init__(self, store: Store):
        self.store = store

    def _note(self, files: DataFrame, field: T.StructField, at: Callable[[Column], Column]) -> None:
        """Look through files for their event times and add them to the ledger."""
        paths = [r["path"] for r in files.select("path").collect()]
        if not paths:
            return
        times = self.store.spark.read.schema(T.StructType([field])).json(paths)
        times = times.select(F.col("_metadata.file_path").alias("file"), at(F.col(field.name)).alias("at"))
        found = times.groupBy("file").agg(F.min("at").alias("least"), F.max("at").alias("greatest"), F.count("*").alias("rows"))
        noted = files.join(found, "file", "left").select(*LANDED_FILE.columns)
        self.store.append(LANDED_FILE, noted.withColumn("rows", F.coalesce("rows", F.lit(0))))

    def to_open(
        self, folder: str, field: T.StructField, at: Callable[[Column], Column], window: tuple[datetime, datetime]
    ) -> list[str]:
        """Paths of the files below `folder` that hold rows of the window. `at` reads an event time from `field`."""
        path = scratch_dir(self.store.spark, "listing")
        listing(self.store, folder).write.parquet(path)
        files = self.store.spark.read.parquet(path)
        same = ["file", "length", "modified"]
        known = lambda: self.store.read(LANDED_FILE)
        self._note(files.join(known(), same, "left_anti"), field, at)
        inside = (F.col("greatest") >= F.lit(window[0])) & (F.col("least") < F.lit(window[1]))
        wanted = files.join(known().where(inside).select(*same).distinct(), same, "left_semi")
        return sorted(r["path"] for r in wanted.select("path").collect())
