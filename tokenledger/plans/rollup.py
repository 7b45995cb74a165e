"""Additive usage measures at any grain, from the cheapest source at hand.

Every spend question is a sum over some subset of the daily mart's dimensions.
Going through the six-column mart for, say, cost per project and day would
shuffle every (user, model) combination and then aggregate once more, so the
roll-up groups by the asked columns directly: one partial aggregate, one
exchange. The team is a property of the user; it is joined after the user grain
has been aggregated, when the input is as small as it gets and a hot user is
down to a handful of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.scalars import (
    UNASSIGNED,
    UNATTRIBUTED,
    UNKNOWN,
    blank_to_null,
    label_or,
    midnight,
)
from tokenledger.tables import Tables

TOKEN_MEASURES = (
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "cached_input_tokens",
    "reasoning_tokens",
)
COST_MEASURES = ("input_cost", "output_cost", "total_cost")
MEASURES = ("observations", *TOKEN_MEASURES, *COST_MEASURES)


def project_label() -> Column:
    return label_or(UNKNOWN, F.col("project_name"), F.col("project_id"))


def user_label() -> Column:
    return label_or(UNATTRIBUTED, F.col("user_id"))


def model_label() -> Column:
    return label_or(UNKNOWN, F.col("model"))


def labelled(observations: DataFrame) -> DataFrame:
    """Observations with the mart's dimension labels in place of raw values."""
    return observations.withColumns(
        {
            "project_name": project_label(),
            "project_id": label_or(UNKNOWN, F.col("project_id")),
            "user_id": user_label(),
            "model": model_label(),
        }
    )


def measure_sums(measures: Sequence[str], counted: bool) -> list[Column]:
    """Aggregates for the measures; ``counted`` when input rows are observations."""
    return [
        (F.count(F.lit(1)) if m == "observations" and counted else F.sum(m)).alias(m)
        for m in measures
    ]


def with_team(usage: DataFrame, users: DataFrame) -> DataFrame:
    """Usage at user grain plus the user's team.

    No broadcast hint: the user table grows with adoption, so the size check of
    the planner (and of adaptive execution at run time) chooses between a
    broadcast and a sort-merge join. The unattributed label is reserved and
    never has a team.
    """
    teams = users.where(F.col("user_id") != UNATTRIBUTED).select(
        "user_id", blank_to_null(F.col("team")).alias("team")
    )
    return usage.join(teams, "user_id", "left").withColumn(
        "team", label_or(UNASSIGNED, F.col("team"))
    )


def usage_rollup(
    tables: Tables,
    by: Sequence[str],
    measures: Sequence[str] = MEASURES,
    since: date | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Measures summed by a subset of day, project, user, team and model.

    ``derived`` names further grouping columns computed from those, for example
    the week of the day; they are grouped by directly, not in a second step.
    """
    if "usage_daily" in tables:
        source, counted = tables["usage_daily"], False
        if since is not None:
            source = source.where(F.col("day") >= F.lit(since))
    else:
        start = midnight(since) if since is not None else None
        source, counted = labelled(tables.observations(start)), True
    source = source.withColumns(dict(derived or {}))

    if "team" not in by:
        return source.groupBy(*by).agg(*measure_sums(measures, counted))

    user_grain = [c for c in by if c not in ("team", "user_id")] + ["user_id"]
    per_user = source.groupBy(*user_grain).agg(*measure_sums(measures, counted))
    teamed = with_team(per_user, tables["dim_user"])
    if "user_id" in by:
        return teamed.select(*by, *measures)
    return teamed.groupBy(*by).agg(*measure_sums(measures, counted=False))
