"""Small reference tables kept as files: users, budgets, targets, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenledger.schemas import TableSpec


def read_reference_table(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """A reference table from CSV (with header), JSON lines or Parquet, by file suffix."""
    reader = spark.read.schema(spec.schema)
    if path.endswith(".csv"):
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.option("mode", "FAILFAST").json(path)
    return reader.parquet(path)
