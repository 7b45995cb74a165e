from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import scalars as s


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [('"12.7"', 0), ("12.7", 12), ('" 12 "', 12), ('"abc"', 0), ("null", 0), ("-3", -3)],
)
def test_integer_under_a_key(spark, text, expected):
    doc = s.document(F.lit('{"v": %s}' % text))
    assert one(spark, s.document_int(doc, "v")) == expected


@pytest.mark.parametrize("text, expected", [("0.5", 0.5), ("abc", 0.0), (None, 0.0), ("1e-3", 0.001)])
def test_safe_float(spark, text, expected):
    assert one(spark, s.safe_float(F.col("t")), t=("string", text)) == expected


@pytest.mark.parametrize("text, expected", [(" 7 ", 7), ("7.9", 0), ("x", 0), (None, 0)])
def test_safe_int(spark, text, expected):
    assert one(spark, s.safe_int(F.col("t")), t=("string", text)) == expected


@pytest.mark.parametrize("text, expected", [("0.25", 0.25), ("true", None), ('"0.5"', 0.5), ('"x"', None), ("null", None)])
def test_nullable_number(spark, text, expected):
    assert one(spark, s.variant_number(F.try_parse_json(F.lit(text)))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"),
        ("2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00"),
        ("2024-01-01", "2024-01-01 00:00:00"),
        ("12:30", None),
        ("2024", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_iso_timestamp(spark, text, expected):
    got = one(spark, F.date_format(s.iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=("string", text))
    assert got == expected


@pytest.mark.parametrize("a, b, expected", [(1.0, 0.0, None), (None, 2.0, None), (1.0, 3.0, 0.3333), (2.0, None, None)])
def test_ratio(spark, a, b, expected):
    assert one(spark, s.ratio(F.col("a"), F.col("b"), 4), a=("double", a), b=("double", b)) == expected


def test_rounding_is_half_up(spark):
    assert one(spark, F.round(F.lit(2.675), 2)) == 2.68


@pytest.mark.parametrize("day, label", [("2021-01-01", "2020-W53"), ("2021-01-04", "2021-W01"), ("1998-12-31", "1998-W53")])
def test_iso_week(spark, day, label):
    assert one(spark, s.iso_week_label(s.iso_week(F.lit(day).cast("date")))) == label


def test_windows():
    at = datetime(2024, 1, 28, 12, 30, tzinfo=timezone.utc)
    assert s.month_start(at) == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert str(s.date_before(at, 30)) == "2023-12-29"
    assert s.next_full_hour(at).hour == 13
    assert s.next_full_hour(at.replace(minute=0)).hour == 12
    assert s.utc(datetime(2024, 1, 1)).tzinfo == timezone.utc


def test_name_and_range_checks():
    assert s.check_name("gpt-4.1-mini") == "gpt-4.1-mini"
    assert s.check_name(None) is None
    for bad in ("x'; --", "", "a\n"):
        with pytest.raises(ValueError):
            s.check_name(bad)
    with pytest.raises(ValueError):
        s.check_range("days", 0, 1, 365)
