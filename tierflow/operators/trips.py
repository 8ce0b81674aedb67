"""Taxi trips: derive, trim, summarize, curate.

Four steps of one pipeline.  Store the result of :func:`derive_trips` before
trimming it, since the bounds read it as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    duration_seconds,
    hour_of,
    minute_of,
    minute_text,
    speed_per_hour,
    time_slot,
    to_day,
)
from .aggregates import roll_up, summarize
from .percentiles import exact_percentile_bounds, trim_outliers

# What a plausible trip is.
TRIMMED_COLUMNS = ("trip_distance", "speed", "total_amount")
MAX_TRIP_SECONDS = 72 * 60 * 60
LONG_DISTANCE = 15


def derive_trips(raw: DataFrame) -> DataFrame:
    """Trips of positive distance with their day, minute, slot and speed."""
    pickup, dropoff = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    duration = duration_seconds(pickup, dropoff)
    return raw.where(F.col("trip_distance") > 0).select(
        "trip_distance",
        "total_amount",
        to_day(pickup).alias("pickup_date"),
        duration.alias("trip_duration"),
        speed_per_hour("trip_distance", duration).alias("speed"),
        minute_text(pickup).alias("pickup_date_time"),
        hour_of(pickup).alias("pickup_hour"),
        minute_of(pickup).alias("pickup_minute"),
        time_slot(pickup).alias("pickup_timeslot"),
        F.col("PULocationID").alias("pickup_loc"),
    )


def trim_trips(trips: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Plausible trips within the percentile bounds of the columns trimmed."""
    if bounds is None:
        bounds = exact_percentile_bounds(trips, TRIMMED_COLUMNS)
    plausible = trips.where(
        (F.col("trip_duration") > 0)
        & (F.col("trip_duration") < MAX_TRIP_SECONDS)
        & (F.col("speed") > 0)
        & (F.col("total_amount") > 0)
    )
    return trim_outliers(plausible, bounds, TRIMMED_COLUMNS)


def summarize_trips(trips: DataFrame) -> DataFrame:
    """Counts, sums and ranges per pickup minute, place and long-distance flag."""
    flagged = trips.withColumn("long_distance", F.col("trip_distance") > LONG_DISTANCE)
    keys = [
        "pickup_date",
        "pickup_loc",
        "pickup_hour",
        "pickup_minute",
        "pickup_timeslot",
        "pickup_date_time",
        "long_distance",
    ]
    measures = {}
    for column, label in (
        ("trip_duration", "trip_duration"),
        ("trip_distance", "trip_distance"),
        ("total_amount", "trip_fare_amount"),
    ):
        measures[f"sum_{label}"] = F.sum(column)
        measures[f"min_{label}"] = F.min(column)
        measures[f"max_{label}"] = F.max(column)
    measures["min_speed"] = F.min("speed")
    measures["max_speed"] = F.max("speed")
    measures["avg_speed"] = F.avg("speed")
    return summarize(flagged, keys, measures, rows="pickup_count")


def curate_trips(summary: DataFrame) -> DataFrame:
    """Totals per day, place and long-distance flag, from the finer summary."""
    return roll_up(
        summary,
        ["pickup_date", "pickup_loc", "long_distance"],
        [
            "pickup_count",
            "sum_trip_duration",
            "sum_trip_distance",
            "sum_trip_fare_amount",
        ],
    )
