"""Joining facts to the version of a dimension row valid at their time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A dimension measured below this many bytes is sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Facts of one key a task may get; a key with more is hot and cut into slices.
# There are at most facts / slice rows of them: a million for 10^12 facts.
SLICE_ROWS = 1_000_000
# Versions of one key a fact may be compared with one by one.
FEW_VERSIONS = 64
# Keys with more versions are listed; a list up to this long is broadcast.
LISTED_KEYS = 1_000_000
# Types left out of a row's hash, which cannot take all of them.
NESTED = ("array", "map", "struct", "variant")


def temporal_left_join(
    facts: DataFrame,
    versions: DataFrame,
    on: tuple[str, str],
    at: str,
    valid: tuple[str, str],
    broadcast_bytes: int = BROADCAST_BYTES,
    slice_rows: int = SLICE_ROWS,
    few_versions: int = FEW_VERSIONS,
    listed_keys: int = LISTED_KEYS,
    hot: Mapping[Any, int] | None = None,
) -> DataFrame:
    """Left join of each fact to the dimension rows valid at its time.

    ``on`` names the key of the facts and of the versions, ``at`` the time of a
    fact, ``valid`` the start (included) and end (excluded) of a version.
    Facts without a valid version are kept with NULLs.  Select from the result
    with the aliases ``fact`` and ``version``.

    A dimension measured to be small is broadcast and the facts do not move.
    A larger one is joined by a shuffle on the key, where the rows of every hot
    key are spread over as many tasks as their number calls for.  Streaming facts
    cannot be counted ahead: ``hot`` names their hot keys and the tasks for each.
    Every key with more than ``few_versions`` versions has its time cut into
    slots, so that a fact meets the few versions of its slot.  Times that have
    no order as numbers, such as text, cannot be cut and are refused there.
    """
    fact_key, version_key = on
    start, end = valid
    matches = (
        (F.col(f"fact.{fact_key}") == F.col(f"version.{version_key}"))
        & (F.col(f"fact.{at}") >= F.col(f"version.{start}"))
        & (F.col(f"fact.{at}") < F.col(f"version.{end}"))
    )
    added = []
    small, crowded = _measure(versions, version_key, broadcast_bytes, few_versions)
    if crowded:
        times = [dict(facts.dtypes)[at], *[dict(versions.dtypes)[c] for c in valid]]
        ticks = _ticks(*times)
        listed = F.broadcast if crowded <= listed_keys else _as_it_is
        slots = _slots_of_crowded_keys(
            versions, version_key, valid, ticks, few_versions, listed
        )
        facts = _with_slot(facts, fact_key, at, listed(slots), ticks)
        versions = _with_slots(versions, version_key, valid, listed(slots), ticks)
        added.append("__slot")
        # What is sent are the versions as often as the cut repeats them.
        small = small and broadcast_fits(versions, broadcast_bytes)
    if small:
        versions = F.broadcast(versions)
    elif hot or not facts.isStreaming:
        if hot:
            kind = dict(facts.dtypes)[fact_key]
            slices = _named_keys(facts.sparkSession, hot, kind)
        else:
            slices = hot_keys(facts, fact_key, slice_rows)
        facts, versions = _spread_hot_keys(
            facts, versions, fact_key, version_key, slices
        )
        added.append("__slice")
    for column in added:
        matches &= F.col(f"fact.{column}") == F.col(f"version.{column}")
    joined = facts.alias("fact").join(versions.alias("version"), matches, "left")
    for column in added:
        joined = joined.drop(F.col(f"fact.{column}"), F.col(f"version.{column}"))
    return joined


def broadcast_fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows measure at most ``max_bytes`` in memory."""
    size = df.agg(F.sum(_width(df)).alias("bytes")).first()["bytes"]
    return (size or 0) <= max_bytes


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def _width(df: DataFrame) -> Column:
    """Bytes of a row in a hash table: a word per column and for the row, the
    key and the table's entry, and what text or nesting adds."""
    width = F.lit(8 * (len(df.columns) + 4)).cast("bigint")
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind.startswith(NESTED):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
        elif kind.startswith(("string", "char", "varchar", "binary")):
            width += F.coalesce(F.octet_length(value), F.lit(0))
    return width


def _measure(
    versions: DataFrame, key: str, max_bytes: int, few: int
) -> tuple[bool, int]:
    """Whether a dimension fits in so many bytes, and its keys with over ``few`` rows."""
    keys = versions.groupBy(key).agg(
        F.sum(_width(versions)).alias("bytes"), F.count("*").alias("rows")
    )
    size = keys.agg(F.sum("bytes"), F.count_if(F.col("rows") > few)).first()
    return (size[0] or 0) <= max_bytes, size[1]


# --- hot keys ----------------------------------------------------------------


def hot_keys(df: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Keys with at least ``slice_rows`` rows, and the slices to cut them in."""
    counts = df.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__rows"))
    slices = F.ceil(F.col("__rows") / slice_rows).cast("int").alias("__slices")
    return counts.where(F.col("__rows") >= slice_rows).select("__hot", slices)


def _named_keys(spark: SparkSession, hot: Mapping[Any, int], kind: str) -> DataFrame:
    rows = [(str(key), int(slices)) for key, slices in hot.items()]
    named = spark.createDataFrame(rows, "__hot string, __slices int")
    return named.withColumn("__hot", F.col("__hot").cast(kind))


def _spread_hot_keys(
    facts: DataFrame,
    versions: DataFrame,
    fact_key: str,
    version_key: str,
    slices: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Number the slices of both sides: a fact has one, a version all of its key's.

    Equal rows in different input partitions get different slices, and a task
    run again gives a row the slice it had before.
    """
    # A row for so many facts, see SLICE_ROWS; both sides share one broadcast.
    hot = F.broadcast(slices)
    hashed = [c for c, kind in facts.dtypes if not kind.startswith(NESTED)]
    row = F.xxhash64(F.spark_partition_id(), *hashed)
    facts = _with_slices(facts, fact_key, hot)
    facts = facts.withColumn("__slice", F.pmod(row, F.col("__slices")).cast("int"))
    # A version without a key matches nothing.
    versions = versions.where(F.col(version_key).isNotNull())
    versions = _with_slices(versions, version_key, hot)
    numbers = F.sequence(F.lit(0), F.col("__slices") - F.lit(1))
    versions = versions.withColumn("__slice", F.explode(numbers))
    return facts.drop("__slices"), versions.drop("__slices")


def _with_slices(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    # Null-safe, so that facts without a key, which match nothing, are spread too.
    sliced = df.join(hot, F.col(key).eqNullSafe(F.col("__hot")), "left").drop("__hot")
    return sliced.withColumn("__slices", F.coalesce("__slices", F.lit(1)))


# --- crowded keys --------------------------------------------------------------

Ticks = Callable[[str], Column]


def _ticks(*types: str) -> Ticks:
    """Times as numbers that never fall where the times rise."""
    instants, wall_clock = {"timestamp"}, {"timestamp_ntz", "date"}
    if set(types) <= instants | wall_clock and instants & set(types):
        return lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if set(types) <= wall_clock:
        return _wall_clock_seconds
    numbers = ("tinyint", "smallint", "int", "bigint", "double", "float", "decimal")
    if all(kind.startswith(numbers) for kind in types):
        return lambda c: F.col(c).cast("double")
    raise ValueError(
        f"a key has many versions and times of types {', '.join(types)} cannot be cut "
        "into slots; cast them to timestamps or numbers"
    )


def _wall_clock_seconds(name: str) -> Column:
    time = F.col(name).cast("timestamp_ntz")
    days = F.unix_date(time.cast("date")).cast("double")
    minutes = (days * 24 + F.hour(time)) * 60 + F.minute(time)
    return minutes * 60 + F.date_part(F.lit("SECOND"), time).cast("double")


def _slots_of_crowded_keys(
    versions: DataFrame,
    key: str,
    valid: tuple[str, str],
    ticks: Ticks,
    few: int,
    listed: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """First and last start of each crowded key, and the slots between them.

    A key has as many slots as versions, fewer where versions overlap: cutting
    a key's versions at its slots no more than about doubles their number.
    """
    start, end = (ticks(c) for c in valid)
    keyed = versions.select(
        F.col(key).alias("__crowded"), start.alias("start"), end.alias("end")
    ).where("start < end")
    spans = keyed.groupBy("__crowded").agg(
        F.min("start").alias("__first"),
        F.max("start").alias("__last"),
        F.count("*").alias("rows"),
    )
    spans = spans.where((F.col("rows") > few) & (F.col("__first") < F.col("__last")))
    covered = F.least("end", "__last") - F.col("start")
    depth = F.sum(covered / (F.col("__last") - F.col("__first")))
    slots = F.floor(F.col("rows") / F.greatest(depth, F.lit(1.0))).cast("int")
    return (
        keyed.join(listed(spans), "__crowded")
        .groupBy("__crowded", "__first", "__last", "rows")
        .agg(F.greatest(slots, F.lit(1)).alias("__slots"))
        .drop("rows")
    )


def _slot_at(time: Column) -> Column:
    """Number of the slot a time falls in, 0 where the key is not crowded."""
    slot = F.width_bucket(time, F.col("__first"), F.col("__last"), F.col("__slots"))
    return F.coalesce(slot, F.lit(0).cast("bigint"))


def _with_slot(
    facts: DataFrame, key: str, at: str, slots: DataFrame, ticks: Ticks
) -> DataFrame:
    slotted = facts.join(slots, F.col(key) == F.col("__crowded"), "left")
    slotted = slotted.withColumn("__slot", _slot_at(ticks(at)))
    return slotted.drop(*slots.columns)


def _with_slots(
    versions: DataFrame, key: str, valid: tuple[str, str], slots: DataFrame, ticks: Ticks
) -> DataFrame:
    """A version once for every slot it is valid in; empty ones match nothing."""
    start, end = valid
    some = versions.where(F.col(start) < F.col(end))
    slotted = some.join(slots, F.col(key) == F.col("__crowded"), "left")
    numbers = F.sequence(_slot_at(ticks(start)), _slot_at(ticks(end)))
    return slotted.withColumn("__slot", F.explode(numbers)).drop(*slots.columns)
