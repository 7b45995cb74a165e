"""Seed rows for the small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenledger.schemas import MODEL_PRICES, TARGETS

# USD per million tokens (model, cached input, other input, output).
DEFAULT_MODEL_PRICES = [
    ("deepseek-v4-flash", 0.007, 0.22, 0.66),
    ("deepseek-v4-pro", 0.022, 0.66, 1.98),
    ("deepseek-v4-flash-vision-exp", 0.007, 0.22, 0.66),
]

# Governance targets (metric, comparison, threshold, label).
DEFAULT_TARGETS = [
    ("cache_hit_rate", "gte", 0.30, "Cache hit rate"),
    ("output_input_ratio", "gte", 0.30, "Output:input ratio"),
    ("reasoning_share", "lte", 0.25, "Reasoning token share"),
    ("cost_per_1k_tokens", "lte", 0.02, "Blended cost per 1k tokens"),
    ("burn_rate", "lte", 0.80, "Monthly budget burn"),
]


def default_model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_MODEL_PRICES, MODEL_PRICES.schema)


def default_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_TARGETS, TARGETS.schema)
