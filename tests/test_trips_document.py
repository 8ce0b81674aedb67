"""The trips steps as a SQL document in keyed form, against the operators."""

import pytest
from pyspark.sql import functions as F

from tierflow import Pipeline, operators as ops
from workloads.tables import declared, raw_trips

RAW = declared(
    trip_distance="double",
    total_amount="double",
    tpep_pickup_datetime="string",
    tpep_dropoff_datetime="string",
    PULocationID="integer",
)
# Columns, text formats, shares and limits of the trips document.
STD_1 = """
WITH timed AS (
  SELECT *, to_unix_timestamp(tpep_pickup_datetime, 'yyyy-MM-dd HH:mm:ss') AS began,
         to_unix_timestamp(tpep_dropoff_datetime, 'yyyy-MM-dd HH:mm:ss') AS ended
  FROM trips_raw WHERE trip_distance > 0)
SELECT trip_distance, total_amount,
       to_date(tpep_pickup_datetime, 'yyyy-MM-dd HH:mm:ss') AS pickup_date,
       ended - began AS trip_duration,
       round(trip_distance / (ended - began) * 3600, 2) AS speed,
       from_unixtime(began, 'yyyy-MM-dd HH:mm:00') AS pickup_date_time,
       hour(tpep_pickup_datetime) AS pickup_hour,
       minute(tpep_pickup_datetime) AS pickup_minute,
       floor(minute(tpep_pickup_datetime) / 10) AS pickup_timeslot,
       PULocationID AS pickup_loc
FROM timed"""
STD_2 = """
WITH edges AS (
  SELECT percentile_approx(trip_distance, array(0.001, 0.999), 1000000) AS d,
         percentile_approx(speed, array(0.001, 0.999), 1000000) AS s,
         percentile_approx(total_amount, array(0.001, 0.999), 1000000) AS a
  FROM trips_1)
SELECT trips_1.* FROM trips_1, edges
WHERE trip_duration > 0 AND trip_duration < 72 * 3600 AND speed > 0 AND total_amount > 0
  AND trip_distance BETWEEN d[0] AND d[1]
  AND speed BETWEEN s[0] AND s[1]
  AND total_amount BETWEEN a[0] AND a[1]"""
STD_3 = """
SELECT pickup_date, pickup_loc, pickup_hour, pickup_minute, pickup_timeslot,
       pickup_date_time, trip_distance > 15 AS long_distance, count(*) AS pickup_count,
       sum(trip_duration) AS sum_trip_duration, sum(trip_distance) AS sum_trip_distance,
       sum(total_amount) AS sum_trip_fare_amount
FROM trips_2
GROUP BY pickup_date, pickup_loc, pickup_hour, pickup_minute, pickup_timeslot,
         pickup_date_time, long_distance"""
CURATED = """
SELECT pickup_date, pickup_loc, long_distance, sum(pickup_count) AS pickup_count,
       sum(sum_trip_duration) AS sum_trip_duration,
       sum(sum_trip_distance) AS sum_trip_distance,
       sum(sum_trip_fare_amount) AS sum_trip_fare_amount
FROM trips_3 GROUP BY pickup_date, pickup_loc, long_distance"""


def task(target: str, text: str, sink: str) -> dict:
    return {"sql": text.splitlines(), "target": target, "type": "batch", "output": [sink]}


@pytest.fixture
def flow(spark, sf_dir, tmp_path, work):
    landing = str(tmp_path / "landing")
    raw_trips(spark, sf_dir).write.option("header", "true").csv(landing)
    document = {
        "name": "trips_document",
        # Zero durations give NULL speeds, as plain division does without ANSI mode.
        "conf": {"spark.sql.ansi.enabled": False},
        "staging": {
            "trips": {
                "format": "csv",
                "location": landing,
                "target": "trips_raw",
                "type": "batch",
                "output": ["table"],
                "schema": RAW,
            }
        },
        "standard": {
            "one": task("trips_1", STD_1, "table"),
            "two": task("trips_2", STD_2, "table"),
            "three": task("trips_3", STD_3, "table"),
        },
        "serving": {"curate": task("trips_curated", CURATED, "file")},
    }
    return Pipeline(spark, document, work)


def rows(df):
    columns = ["pickup_date", "pickup_loc", "long_distance", "pickup_count"]
    rounded = [F.round(c, 4) for c in ("sum_trip_distance", "sum_trip_fare_amount")]
    picked = df.select(*columns, "sum_trip_duration", *rounded)
    return sorted(map(tuple, picked.collect()), key=str)


def test_document_equals_operators(spark, sf_dir, flow):
    flow.run()
    trips = ops.derive_trips(raw_trips(spark, sf_dir))
    first = flow.output("standard", "one")
    assert first.dtypes == trips.dtypes
    assert first.exceptAll(trips).count() == trips.exceptAll(first).count() == 0
    # The document asks for more accuracy than it has rows, so its bounds are exact.
    trimmed = ops.trim_trips(trips)
    second = flow.output("standard", "two")
    assert second.count() == trimmed.count() > 0
    expected = ops.curate_trips(ops.summarize_trips(trimmed))
    assert rows(flow.output("serving", "curate")) == rows(expected)
