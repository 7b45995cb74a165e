"""Scalar building blocks shared by every mart and KPI."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels shown in place of missing ones.
UNKNOWN = "(unknown)"
UNATTRIBUTED = "(unattributed)"
UNASSIGNED = "Unassigned"

# Fixed value: accepted characters of a free-text name argument.
NAME_PATTERN = re.compile(r"[A-Za-z0-9 .:_+\-]+")


def check_name(value: str | None) -> str | None:
    if value is not None and not NAME_PATTERN.fullmatch(value):
        raise ValueError(f"name has characters outside {NAME_PATTERN.pattern}: {value!r}")
    return value


def check_range(name: str, value, low, high):
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, got {value!r}")
    return value


# -- time ------------------------------------------------------------------


def utc(as_of: datetime | None) -> datetime:
    """The instant a question is asked for; now when none is given."""
    if as_of is None:
        return datetime.now(timezone.utc)
    if as_of.tzinfo is None:
        return as_of.replace(tzinfo=timezone.utc)
    return as_of.astimezone(timezone.utc)


def month_start(as_of: datetime) -> datetime:
    return as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def days_before(as_of: datetime, days: int) -> datetime:
    return as_of - timedelta(days=days)


def date_before(as_of: datetime, days: int) -> date:
    """First calendar day of a window of ``days`` full days plus today."""
    return as_of.date() - timedelta(days=days)


def midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc)


def next_full_hour(instant: datetime) -> datetime:
    floor = instant.replace(minute=0, second=0, microsecond=0)
    return floor if floor == instant else floor + timedelta(hours=1)


def day_bucket(ts: Column) -> Column:
    # A cast is unwrapped by Catalyst and reaches the Parquet filter; date_trunc is not.
    return ts.cast("date")


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts)


def iso_week(day: Column) -> Column:
    """ISO (year, week) as a comparable struct."""
    return F.struct(
        F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("year"),
        F.weekofyear(day).alias("week"),
    )


def iso_week_label(week: Column) -> Column:
    return F.concat(
        week.getField("year").cast("string"),
        F.lit("-W"),
        F.lpad(week.getField("week").cast("string"), 2, "0"),
    )


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


# -- arithmetic ------------------------------------------------------------


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Rounded quotient; NULL when the denominator is zero or missing."""
    return F.round(divide(numerator, denominator), digits)


def divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def usd(amount: Column) -> Column:
    """Money as a double; amounts stay decimal until they leave a KPI."""
    return amount.cast("double")


def sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def label_or(label: str, *candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(label))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# -- defensive casts of landed values -----------------------------------------


def safe_int(text: Column) -> Column:
    """Whole-number text, else 0."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def number_or_null(text: Column) -> Column:
    """A number as double; NULL for anything else, true/false included."""
    return text.try_cast("double")


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text (``Z`` and offsets accepted) as a timestamp, else NULL.

    The date prefix is required: a bare time of day would otherwise be read as
    that time today.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed.try_cast("timestamp"))


def document(text: Column) -> Column:
    """JSON text as a variant; NULL when blank or malformed."""
    return F.try_parse_json(text)


def document_int(doc: Column, key: str) -> Column:
    """Integer under a key: numbers truncate, text must be whole, else 0."""
    return F.coalesce(F.try_variant_get(doc, f"$.{key}", "bigint"), F.lit(0).cast("bigint"))


def document_float(doc: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$.{key}", "double"), F.lit(0.0))


def document_text(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "string")


def variant_int(value: Column) -> Column:
    """A landed JSON value as integer: numbers truncate, text must be whole, else 0."""
    return F.coalesce(F.try_variant_get(value, "$", "bigint"), F.lit(0).cast("bigint"))


def variant_number(value: Column) -> Column:
    """A landed JSON value as double; NULL for true/false and non-numbers."""
    is_flag = F.schema_of_variant(value) == "BOOLEAN"
    return F.when(~is_flag, F.try_variant_get(value, "$", "double"))


# -- output edge -------------------------------------------------------------


def edge(df: DataFrame) -> DataFrame:
    """Types a JSON consumer gets: money as double, dates and times as ISO text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)
