"""Governance documents to snapshot, policy and divergence rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import (
    UNKNOWN,
    blank_to_null,
    iso_timestamp,
    label_or,
    utc,
    variant_int,
    variant_number,
)

# Fixed value: status of a policy that states none.
DEFAULT_STATUS = "ratified"


def _project_id() -> Column:
    return label_or(UNKNOWN, blank_to_null(F.col("project.id")))


def _iso(ts: Column) -> Column:
    """UTC ISO text, with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00"))


def governance_snapshots(documents: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One ``fact_governance`` row per document."""
    exported_at = F.coalesce(iso_timestamp(F.col("exportedAt")), F.lit(utc(as_of)))
    ratio, proposals = "metrics.precision14", "metrics.proposals"
    return documents.select(
        F.concat(_project_id(), F.lit(":"), _iso(exported_at)).alias("snapshot_id"),
        _project_id().alias("project_id"),
        exported_at.alias("exported_at"),
        variant_number(F.col("metrics.ttrpMs")).alias("ttrp_ms"),
        variant_int(F.col(f"{ratio}.numerator")).alias("precision14_numerator"),
        variant_int(F.col(f"{ratio}.denominator")).alias("precision14_denominator"),
        variant_number(F.col(f"{ratio}.ratio")).alias("precision14_ratio"),
        *(
            variant_int(F.col(f"{proposals}.{n}")).alias(f"proposals_{n}")
            for n in ("total", "pending", "ratified", "rejected", "decayed")
        ),
        F.struct("file").alias("_seq"),
    )


def governance_policies(documents: DataFrame) -> DataFrame:
    """One ``dim_policy`` row per policy of a document."""
    items = documents.select(
        _project_id().alias("project_id"), "file", F.posexplode("policies").alias("pos", "p")
    )
    return items.select(
        F.col("p.ruleKey").alias("rule_key"),
        "project_id",
        F.col("p.kind").alias("kind"),
        label_or(DEFAULT_STATUS, blank_to_null(F.col("p.status"))).alias("status"),
        variant_number(F.col("p.confidence")).alias("confidence"),
        iso_timestamp(F.col("p.promotedAt")).alias("promoted_at"),
        F.col("p.operator").alias("operator"),
        variant_int(F.col("p.evidenceTraces")).alias("evidence_traces"),
        F.struct("file", "pos").alias("_seq"),
    )


def governance_divergence(documents: DataFrame) -> DataFrame:
    """One ``fact_governance_divergence`` row per model and task of a document."""
    items = documents.select(
        _project_id().alias("project_id"), "file", F.posexplode("divergence").alias("pos", "d")
    )
    return items.select(
        "project_id",
        F.col("d.model").alias("model"),
        F.col("d.taskKey").alias("task_key"),
        variant_int(F.col("d.divergentTraces")).alias("divergent_traces"),
        variant_int(F.col("d.totalTraces")).alias("total_traces"),
        F.struct("file", "pos").alias("_seq"),
    )
