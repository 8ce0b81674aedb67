import datetime

import pytest
from pyspark.sql import functions as F

from tierflow import functions as fn


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def values(spark, row, schema, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_parts_of_a_timestamp(spark, ansi):
    found = values(
        spark,
        ("2024-03-09 07:45:59",),
        "t string",
        fn.to_day("t"),
        fn.unix_seconds("t"),
        fn.minute_text("t"),
        fn.hour_of("t"),
        fn.minute_of("t"),
        fn.time_slot("t"),
    )
    day = datetime.date(2024, 3, 9)
    seconds = int(
        datetime.datetime(2024, 3, 9, 7, 45, 59, tzinfo=datetime.timezone.utc).timestamp()
    )
    assert found == (day, seconds, "2024-03-09 07:45:00", 7, 45, 4)


@pytest.mark.parametrize("text", ["soon", "2024-13-40 99:00:00", "", None])
def test_text_that_does_not_parse_is_null(spark, ansi, text):
    found = values(
        spark,
        (text,),
        "t string",
        fn.to_day("t"),
        fn.unix_seconds("t"),
        fn.minute_text("t"),
        fn.hour_of("t"),
        fn.minute_of("t"),
        fn.time_slot("t"),
    )
    assert found == (None,) * 6


def test_duration_and_speed(spark, ansi):
    rows = [
        ("2024-01-01 00:00:00", "2024-01-01 00:30:00", 5.0),
        ("2024-01-01 00:30:00", "2024-01-01 00:00:00", 5.0),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 5.0),
    ]
    df = spark.createDataFrame(rows, "a string, b string, d double")
    seconds = fn.duration_seconds("a", "b")
    found = df.select(seconds, fn.speed_per_hour("d", seconds)).collect()
    assert [tuple(r) for r in found] == [(1800, 10.0), (-1800, -10.0), (0, None)]


def test_division_by_zero_is_null(spark, ansi):
    assert values(spark, (1.0, 0.0), "a double, b double", fn.safe_divide("a", "b")) == (
        None,
    )


def test_speed_rounds_half_up(spark):
    df = spark.createDataFrame([(1.005, 3600)], "d double, s bigint")
    assert df.select(fn.speed_per_hour("d", "s")).first()[0] == 1.01


def test_types(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(
        fn.to_day("t").alias("day"),
        fn.duration_seconds("t", "t").alias("seconds"),
        fn.hour_of("t").alias("hour"),
        fn.time_slot("t").alias("slot"),
        F.lit(1).alias("n"),
    )
    assert [t for _, t in df.dtypes][:4] == ["date", "bigint", "int", "bigint"]
