"""Joining rows to the nearest row of the other side in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .joins import NESTED, SLICE_ROWS, _spread_hot_keys, _ticks, hot_keys
from .slots import SLOT_ROWS, crowded_keys, key_of, with_slots

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    at: tuple[str, str],
    order: Sequence[str] = (),
    direction: str = "backward",
    tolerance: str | float | None = None,
    equal: bool = True,
    slot_points: int = SLOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Left join of each row to the nearest row of ``right`` with its key.

    ``on`` names key columns that both sides have, ``at`` the times of the left
    and the right side.  ``backward`` takes the last right row that is not later,
    ``forward`` the first that is not earlier, ``nearest`` the closer of the two,
    the earlier one where they are as close.  Without ``equal`` a row of the same
    time does not count.  Of right rows with one key and time the last by
    ``order`` counts, then by a hash of the row.  ``tolerance`` is the most the
    times may be apart: an interval such as ``"1 hour"``, or a number where times
    are numbers.  Rows without a key, a time or a match are kept with NULLs.

    The result has the left columns, then those of ``right`` but its keys.  Tables
    that name the same column apart from keys are refused.

    No range condition is planned.  First every key and time becomes one point,
    however many rows it has on either side, combined before the shuffle.  Then a
    window over the points of a key in order finds the match of each.  A key with
    more than ``slot_points`` points is cut at quantiles of its time into slots, which
    are windows of their own; the last match of each slot is handed on to the slots
    after it by a window over the slots, at most ``CUTS`` of a key.  At last the left
    rows find their point by an equality join, in which a point with ``slice_rows``
    left rows or more is spread over several tasks.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}, expected one of {DIRECTIONS}")
    keys = [on] if isinstance(on, str) else list(on)
    left_at, right_at = at
    taken = [name for name in right.columns if name not in keys]
    both = {name.lower() for name in left.columns} & {name.lower() for name in taken}
    if both:
        raise ValueError(f"both sides have columns {sorted(both)}; rename them on one side")
    ticks = _ticks(dict(left.dtypes)[left_at], dict(right.dtypes)[right_at])
    points = _points(left, right, keys, at, taken, order)
    points = with_slots(points, crowded_keys([left, right], keys, slot_points), "__at", ticks)
    match = _nearest(points, direction, equal, ticks)
    match = _within(match, right_at, tolerance)
    asked = match.where("__asked AND __match IS NOT NULL").select("__key", "__at", "__match")
    return _looked_up(left, asked, keys, left_at, taken, slice_rows)


def _known(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows that can match: with a key and a time."""
    known = F.col(at).isNotNull()
    for name in keys:
        known &= F.col(name).isNotNull()
    return df.where(known)


def _points(left, right, keys, at, taken, order) -> DataFrame:
    """One row a key and time: whether left rows ask there, the right row there."""
    left_at, right_at = at
    hashed = [name for name, kind in right.dtypes if not kind.startswith(NESTED)]
    rank = F.struct(*[F.col(name) for name in order], F.xxhash64(*hashed))
    there = _known(right, keys, right_at).select(
        key_of(keys).alias("__key"),
        F.col(right_at).alias("__at"),
        F.lit(False).alias("__asked"),
        F.struct(*[F.col(name) for name in taken]).alias("__row"),
        rank.alias("__rank"),
    )
    asks = _known(left, keys, left_at).select(
        key_of(keys).cast(there.schema["__key"].dataType).alias("__key"),
        F.col(left_at).alias("__at"),
        F.lit(True).alias("__asked"),
        F.lit(None).cast(there.schema["__row"].dataType).alias("__row"),
        F.lit(None).cast(there.schema["__rank"].dataType).alias("__rank"),
    )
    return (
        asks.unionAll(there)
        .groupBy("__key", "__at")
        .agg(F.max("__asked").alias("__asked"), F.max_by("__row", "__rank").alias("__row"))
    )


def _nearest(points: DataFrame, direction: str, equal: bool, ticks) -> DataFrame:
    """Points with ``__match``: time and row of the nearest right row."""
    found = F.when(F.col("__row").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__row").alias("row")))
    points = points.withColumn("__own", found)
    sides = {}
    if direction != "forward":
        sides["__before"] = _handed_on(points, equal, forward=False)
    if direction != "backward":
        sides["__after"] = _handed_on(points, equal, forward=True)
    cut = points.withColumns({name: inside for name, (inside, _, _) in sides.items()})
    keyed = points.where("__own IS NOT NULL").groupBy("__key", "__slot")
    ends = keyed.agg(*[end.alias(f"{name}_end") for name, (_, end, _) in sides.items()])
    # slots without right rows are handed the match, too
    every = points.groupBy("__key", "__slot").agg(F.lit(1).alias("__some"))
    carried = every.join(ends, ["__key", "__slot"], "left").select(
        "__key", "__slot", *[carry(f"{name}_end").alias(f"{name}_carried") for name, (_, _, carry) in sides.items()]
    )
    met = cut.join(carried, ["__key", "__slot"])
    for name in sides:
        met = met.withColumn(name, F.coalesce(name, f"{name}_carried"))
    if direction != "nearest":
        return met.withColumnRenamed(next(iter(sides)), "__match")
    apart = lambda a, b: ticks(a) - ticks(b)
    later = F.col("__before").isNull() | (apart("__after.at", "__at") < apart("__at", "__before.at"))
    return met.withColumn("__match", F.when(F.col("__after").isNotNull() & later, F.col("__after")).otherwise(F.col("__before")))


def _handed_on(points: DataFrame, equal: bool, forward: bool):
    """For one direction: the match within a slot, a slot's last one, and how it is handed on."""
    side = F.desc if forward else F.asc
    upto = Window.currentRow if equal else -1
    inside = Window.partitionBy("__key", "__slot").orderBy(side("__at"))
    inside = inside.rowsBetween(Window.unboundedPreceding, upto)
    match = F.last("__own", ignorenulls=True).over(inside)
    end = F.min_by("__own", "__at") if forward else F.max_by("__own", "__at")
    slots = Window.partitionBy("__key").orderBy(side("__slot"))
    slots = slots.rowsBetween(Window.unboundedPreceding, -1)
    return match, end, lambda name: F.last(name, ignorenulls=True).over(slots)


def _within(match: DataFrame, right_at: str, tolerance) -> DataFrame:
    if tolerance is None:
        return match
    if isinstance(tolerance, str):
        room = F.expr(f"INTERVAL {tolerance}")
    else:
        room = F.lit(tolerance)
    low, high = F.least("__at", "__match.at"), F.greatest("__at", "__match.at")
    return match.withColumn("__match", F.when(high <= low + room, F.col("__match")))


def _looked_up(left, asked, keys, left_at, taken, slice_rows) -> DataFrame:
    """Left rows with the match of their point; crowded points are spread."""
    complete = F.col(left_at).isNotNull()
    for name in keys:
        complete &= F.col(name).isNotNull()
    kind = StructType([asked.schema["__key"], asked.schema["__at"]])
    point = F.when(complete, F.struct(key_of(keys), F.col(left_at)).cast(kind))
    rows = left.withColumn("__point", point)
    found = asked.select(F.struct("__key", "__at").cast(kind).alias("__point"), "__match")
    slices = hot_keys(rows, "__point", slice_rows)
    rows, found = _spread_hot_keys(rows, found, "__point", "__point", slices)
    joined = rows.alias("l").join(
        found.alias("r"),
        (F.col("l.__point") == F.col("r.__point")) & (F.col("l.__slice") == F.col("r.__slice")),
        "left",
    )
    return joined.select(
        *[F.col(f"l.`{name}`") for name in left.columns],
        *[F.col(f"r.__match.row.`{name}`").alias(name) for name in taken],
    )
