"""Sessions: rows of a key that follow each other within a gap."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from .folds import Measures, check_measures, folded, measured
from .slots import SLOT_ROWS, crowded_keys, key_of, with_slots


def sessions(
    df: DataFrame,
    keys: Sequence[str] | str,
    at: str,
    gap: timedelta,
    measures: Measures,
    delay: timedelta | None = None,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """One row a session: keys, ``session_start``, ``session_end`` and measures.

    A row at most ``gap`` after the one before it of its key is in the same
    session; a session ends ``gap`` after its last row.  ``measures`` names results: a
    fold (sum, min or max) and the column or expression folded.  A null key is a key,
    rows without a time are in no session.

    A batch folds rows of one key and time first, before the shuffle.  A key with more
    than ``slot_rows`` rows has its time cut at quantiles into slots, and each slot's
    sessions are found in a window of their own.  Only the first and the last session
    of a slot can go on in another: these, at most two a slot, are joined in a small
    second pass.

    A stream keeps open sessions in state, merged as rows come, and gives each one when
    the watermark, ``delay`` behind the latest time, has passed its end.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    check_measures(measures)
    # a cast would take the column's watermark away
    time = F.col(at) if dict(df.dtypes)[at] == "timestamp" else F.col(at).cast("timestamp")
    rows = measured(df.withColumn("__at", time), [*keys, "__at"], measures)
    if df.isStreaming:
        return _of_stream(rows, keys, gap, measures, delay)
    return _of_batch(rows.where(F.col("__at").isNotNull()), keys, gap, measures, slot_rows)


def _of_stream(rows, keys, gap, measures, delay) -> DataFrame:
    marked = rows if delay is None else rows.withWatermark("__at", f"{_micros(delay)} microseconds")
    window = F.session_window("__at", f"{_micros(gap)} microseconds")
    grouped = marked.groupBy(*keys, window.alias("__session")).agg(*folded(measures))
    return grouped.select(
        *keys, F.col("__session.start").alias("session_start"), F.col("__session.end").alias("session_end"), *measures
    )


def _of_batch(rows, keys, gap, measures, slot_rows) -> DataFrame:
    crowded = crowded_keys([rows], keys, slot_rows)
    points = rows.groupBy(key_of(keys).alias("__key"), "__at").agg(*folded(measures))
    cut = with_slots(points, crowded, "__at", lambda c: F.unix_micros(F.col(c)).cast("double"))
    spans = cut.withColumns({"__from": F.col("__at"), "__to": F.col("__at")})
    parts = _joined(spans, ["__key", "__slot"], gap, measures)
    # the first and the last of each slot may go on, the others have their gap on both sides
    slot = Window.partitionBy("__key", "__slot")
    first, last = F.min("__from").over(slot) == F.col("__from"), F.max("__from").over(slot) == F.col("__from")
    edged = parts.withColumn("__edge", first | last)
    whole = edged.where("NOT __edge").drop("__edge", "__slot")
    stitched = _joined(edged.where("__edge").drop("__edge", "__slot"), ["__key"], gap, measures)
    length = F.expr(f"INTERVAL {_micros(gap)} MICROSECONDS")
    return whole.unionByName(stitched).select(
        *[F.col("__key")[name].alias(name) for name in keys],
        F.col("__from").alias("session_start"),
        (F.col("__to") + length).alias("session_end"),
        *measures,
    )


def _joined(spans: DataFrame, group: list[str], gap: timedelta, measures) -> DataFrame:
    """Spans of each group put together where at most ``gap`` is between them."""
    ordered = Window.partitionBy(*group).orderBy("__from")
    apart = F.unix_micros("__from") - F.unix_micros(F.lag("__to").over(ordered))
    begins = F.when(apart <= _micros(gap), 0).otherwise(1)
    numbered = spans.withColumn("__begins", begins).withColumn("__number", F.sum("__begins").over(ordered))
    bounds = [F.min("__from").alias("__from"), F.max("__to").alias("__to")]
    return numbered.groupBy(*group, "__number").agg(*bounds, *folded(measures)).drop("__number")


def _micros(length: timedelta) -> int:
    return length // timedelta(microseconds=1)
