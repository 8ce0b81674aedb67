"""Joining two streams, or two tables, on a key and times not far apart."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .versions import WATERMARK


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    at: tuple[str, str],
    within: tuple[timedelta, timedelta],
    how: str = "inner",
) -> DataFrame:
    """Rows of both sides with equal keys and times ``within`` so far of each other.

    ``on`` names key columns that both sides have, ``at`` the times of the left and
    the right side, ``within`` the least and the most a right time may be after
    the left one, both included; negative where it comes before.  ``how`` is
    ``inner`` or ``left``.  The result has the left columns, then those of ``right``
    but its keys.  Rows without a key or a time match nothing.

    Both streams need a watermark on their time: with it and the bounds of the
    condition Spark knows when no partner can come any more, so both states stay
    bounded, and an unmatched left row is released once the watermark has passed
    all it could have met.

    Times are cut into slots as long as the bounds are apart: a left row is in
    one, a right row in the two or three where its partners may be.  The slot is
    part of the join key, so a hot key and its state are spread over its slots, and
    a row is compared only with rows near it in time, in streams and in batches.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join type {how!r}, expected 'inner' or 'left'")
    low, high = within
    if low > high:
        raise ValueError(f"the bounds {low} and {high} are the wrong way round")
    keys = [on] if isinstance(on, str) else list(on)
    left_at, right_at = at
    taken = [name for name in right.columns if name not in keys]
    both = {name.lower() for name in left.columns} & {name.lower() for name in taken}
    if both:
        raise ValueError(f"both sides have columns {sorted(both)}; rename them on one side")
    if left.isStreaming and right.isStreaming:
        for side, name in ((left, left_at), (right, right_at)):
            if WATERMARK not in side.schema[name].metadata:
                raise ValueError(f"the stream's time {name!r} needs a watermark, or its state grows for ever")
    width = max(high - low, timedelta(milliseconds=1))
    slotted = left.withColumn("__slot", _slot(F.col(left_at), width))
    first, last = (_slot(F.col(right_at) - F.lit(bound), width) for bound in (high, low))
    met = right.where(F.col(right_at).isNotNull()).withColumn("__slot", F.explode(F.sequence(first, last)))
    l, r = slotted.alias("l"), met.alias("r")
    condition = F.col("l.__slot") == F.col("r.__slot")
    for name in keys:
        condition &= F.col(f"l.`{name}`") == F.col(f"r.`{name}`")
    own, other = F.col(f"l.`{left_at}`"), F.col(f"r.`{right_at}`")
    condition &= (other >= own + F.lit(low)) & (other <= own + F.lit(high))
    joined = l.join(r, condition, how)
    return joined.select(
        *[F.col(f"l.`{name}`") for name in left.columns], *[F.col(f"r.`{name}`") for name in taken]
    )


def _slot(time: Column, width: timedelta) -> Column:
    micros = F.unix_micros(time.cast("timestamp"))
    return F.floor(micros / F.lit(width // timedelta(microseconds=1))).cast("bigint")
