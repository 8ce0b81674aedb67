"""Cutting the time of keys with very many rows, so that each piece is work of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key a task may sort; a key with more has its time cut into slots.
SLOT_ROWS = 1_000_000
# Cuts of a key's time: quantiles, so slots hold about alike many points.
CUTS = 1_024
# Keys with cuts, of 8 bytes each, that are sent to every executor; more are joined by a shuffle.
LISTED_KEYS = 8_192


def key_of(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(name) for name in keys])


def crowded_keys(sides: Sequence[DataFrame], keys: Sequence[str], most: int) -> DataFrame:
    """Keys (``__crowded``) with more rows on all sides than ``most``, combined before any shuffle."""
    rows = sides[0].select(key_of(keys).alias("__key"))
    for side in sides[1:]:
        rows = rows.unionAll(side.select(key_of(keys).alias("__key")))
    counts = rows.groupBy("__key").agg(F.count("*").alias("__rows"))
    return counts.where(F.col("__rows") > most).select(F.col("__key").alias("__crowded"))


def with_slots(points: DataFrame, crowded: DataFrame, at: str, ticks: Callable[[str], Column]) -> DataFrame:
    """Points with ``__slot``, the number of cuts of their ``__key`` up to their time.

    It is 0 for all points of a key that is not crowded.  Slots of a key follow
    each other in time.
    """
    listed = crowded.count()
    if not listed:
        return points.withColumn("__slot", F.lit(0))
    cuts = F.percentile_approx(ticks(at), [n / CUTS for n in range(1, CUTS)], F.lit(100 * CUTS))
    some = points.join(crowded, F.col("__key") == F.col("__crowded"), "left_semi")
    slots = some.groupBy(F.col("__key").alias("__crowded")).agg(cuts.alias("__cuts"))
    if listed <= LISTED_KEYS:
        slots = F.broadcast(slots)
    # cuts up to a time, by halving
    halves = [CUTS >> n for n in range(1, CUTS.bit_length())]
    count = F.reduce(
        F.array(*[F.lit(n) for n in halves]),
        F.lit(0),
        lambda found, half: F.when(
            F.get(F.col("__cuts"), found + half - 1) <= ticks(at), found + half
        ).otherwise(found),
    )
    joined = points.join(slots, F.col("__key") == F.col("__crowded"), "left")
    slot = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(count)
    return joined.withColumn("__slot", slot).drop("__crowded", "__cuts")
