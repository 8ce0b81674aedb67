"""Running totals over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import scratch_dir
from .joins import SLICE_ROWS, _spread_hot_keys, hot_keys
from .slots import key_of


def running_total(
    df: DataFrame,
    order: Sequence[str] | str,
    totals: dict[str, str],
    keys: Sequence[str] = (),
    ranges: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` with the sum of columns over all rows up to each, in ``order``.

    ``totals`` names new columns and what they sum; with ``keys`` every key has totals of
    its own.  As in SQL, rows of one place in the order count together: each has the
    total with all of them.  Nulls come first.  The sum of nothing but nulls is null.

    Rows of one place are summed before the shuffle.  The places are dealt by ranges of
    their order, and written, so that both passes over them see the same ranges.  A
    first pass sums each range; what comes before a range is added up from these sums:
    on the driver, which gets one row a range, or by a window over the ranges of a key.
    Then running sums are taken within each range, and rows find their place by an
    equality join in which a place with ``slice_rows`` rows or more is spread.
    ``ranges`` defaults to the session's shuffle partitions.
    """
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else list(order)
    taken = {name.lower() for name in df.columns} & {name.lower() for name in totals}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already")
    place = [*keys, *order]
    places = df.groupBy(*place).agg(*[F.sum(column).alias(name) for name, column in totals.items()])
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartitionByRange(count, *place).withColumn("__range", F.spark_partition_id())
    path = scratch_dir(spark, "running-total")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sums = dealt.groupBy(*keys, "__range").agg(*[F.sum(name).alias(name) for name in totals])
    local = Window.partitionBy(*keys, "__range").orderBy(*order)
    within = dealt.withColumns({name: F.sum(name).over(local) for name in totals})
    if keys:
        ranged = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        # only keys in several ranges have anything before one
        before = sums.select(
            key_of(list(keys)).alias("__key"),
            F.col("__range").alias("__in"),
            *[F.sum(name).over(ranged).alias(f"__{name}") for name in totals],
        )
        before = before.where(F.coalesce(*[f"__{name}" for name in totals]).isNotNull())
        met = within.join(
            before, key_of(list(keys)).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__in")), "left"
        )
    else:
        met = within.join(F.broadcast(_scanned(sums, list(totals))), "__range", "left")
    added = {name: _plus(F.col(name), F.col(f"__{name}")) for name in totals}
    found = met.withColumns(added).select(key_of(place).alias("__place"), *totals)
    rows = df.withColumn("__place", key_of(place))
    rows, found = _spread_hot_keys(rows, found, "__place", "__place", hot_keys(rows, "__place", slice_rows))
    on = F.col("l.__place").eqNullSafe(F.col("r.__place")) & (F.col("l.__slice") == F.col("r.__slice"))
    joined = rows.alias("l").join(found.alias("r"), on)
    return joined.select(*[F.col(f"l.`{name}`") for name in df.columns], *[F.col(f"r.`{name}`") for name in totals])


def _plus(a, b):
    """The sum of what is there of two."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _scanned(sums: DataFrame, totals: list[str]) -> DataFrame:
    """What comes before each range: one row a range passes through the driver."""
    before, rows = [None] * len(totals), []
    for row in sorted(sums.collect(), key=lambda row: row["__range"]):
        rows.append((row["__range"], *before))
        before = [b if row[n] is None else row[n] if b is None else b + row[n] for b, n in zip(before, totals)]
    kinds = ", ".join(f"`__{name}` {sums.schema[name].dataType.simpleString()}" for name in totals)
    return sums.sparkSession.createDataFrame(rows, f"__range int, {kinds}")
