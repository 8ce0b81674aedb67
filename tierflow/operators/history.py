"""Latest rows, versions from dated changes, and columns that tell when rows came."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

# When a version without a successor ends, names of load columns.
OPEN_END = "9999-12-31 00:00:00"
LOAD_COLUMNS = {"time": "load_time", "id": "load_id"}


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; ties go by a hash of the row.

    An aggregate that combines before its shuffle, so a key with most of the
    rows costs one row per input task.  Nulls in ``order`` come first, a null
    key is a key.  Columns of map type cannot be hashed and do not break ties.
    """
    hashed = [name for name, kind in df.dtypes if not kind.startswith("map")]
    rank = F.struct(*order, F.xxhash64(*hashed))
    row = F.max_by(F.struct(*df.columns), rank).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def latest_stream(df: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """The first row of each key in a stream; repeats within ``delay`` are dropped.

    State is kept for the watermark's delay only.
    """
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def versions_from_changes(
    changes: DataFrame,
    key: str,
    at: str,
    valid: tuple[str, str] = ("start_ts", "end_ts"),
    order: Sequence[str] = (),
    slot: str = "day",
    open_end: str = OPEN_END,
) -> DataFrame:
    """Versions ``[start, end)`` of a key from its dated changes.

    A version begins at its change and ends at the next one of its key.  Of
    changes at one instant the last by ``order`` counts.  Changes without a key
    or a time are left out.  A key's time is cut into slots: each is a window
    of its own, and only the first change of every slot meets in a window of
    the key, so a key with most of the changes is spread over many tasks.
    """
    start, end = valid
    known = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    ordered = latest(known, [key, at], list(order))
    cut = ordered.withColumn("__slot", F.date_trunc(slot, F.col(at)))
    firsts = cut.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__in")).agg(
        F.min(at).alias("__first")
    )
    following = F.lead("__first").over(Window.partitionBy("__key").orderBy("__in"))
    firsts = firsts.withColumn("__following", following).drop("__first")
    inside = F.lead(at).over(Window.partitionBy(key, "__slot").orderBy(at))
    joined = cut.withColumn("__next", inside).join(
        firsts, (F.col(key) == F.col("__key")) & (F.col("__slot") == F.col("__in"))
    )
    last = F.lit(open_end).cast(dict(changes.dtypes)[at])
    return joined.select(
        *[c for c in changes.columns if c != at],
        F.col(at).alias(start),
        F.coalesce("__next", "__following", last).alias(end),
    )


def with_load_columns(df: DataFrame, names: Mapping[str, str] = LOAD_COLUMNS) -> DataFrame:
    """``df`` with the time it is loaded at and an id of this load."""
    names = {**LOAD_COLUMNS, **names}
    return df.withColumns(
        {names["time"]: F.current_timestamp(), names["id"]: F.lit(uuid.uuid4().hex)}
    )
