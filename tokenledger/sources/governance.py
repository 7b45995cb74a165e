"""Scan of governance export documents: one JSON document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.schemas import GOVERNANCE_DOCUMENT
from tokenledger.session import pin_utc

# Fixed value: the export version understood.
EXPORT_VERSION = 1


def read_governance_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents under a folder with their file. Unreadable JSON fails the read."""
    return (
        pin_utc(spark)
        .read.schema(GOVERNANCE_DOCUMENT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )


def _understood():
    version = F.col("version")
    as_text = F.schema_of_variant(version) == "STRING"
    return F.coalesce(
        ~as_text & (F.try_variant_get(version, "$", "double") == EXPORT_VERSION), F.lit(False)
    )


def accepted(documents: DataFrame) -> DataFrame:
    return documents.where(_understood())


def skipped(documents: DataFrame) -> DataFrame:
    """Documents of another version: file and the version found."""
    return documents.where(~_understood()).select(
        "file", F.try_variant_get("version", "$", "string").alias("version")
    )
