"""Distinct counts that can be rolled up: exact ones from values, others from sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# 2^LOG_SIZE registers: a relative standard error of 1.04 / 2^(LOG_SIZE / 2), 1.6 %.
LOG_SIZE = 12


def distinct_counts(df: DataFrame, by: Sequence[str], value: str, out: str = "distinct") -> DataFrame:
    """Different values of each group, exactly; nulls are not values.

    Values are made distinct first, dealt by group and value, so a group with most of the
    rows is spread; only then are they counted, combined before that shuffle.
    """
    values = df.groupBy(*by, F.col(value).alias("__value")).agg(F.lit(1).alias("__one"))
    return values.groupBy(*by).agg(F.count("__value").alias(out))


def distinct_sketches(
    df: DataFrame, by: Sequence[str], value: str, out: str = "sketch", log_size: int = LOG_SIZE
) -> DataFrame:
    """A mergeable sketch of the different values of each group, for storing.

    Sketches of parts of a group, of its rows or its micro-batches, are united by
    ``rolled_up`` or by a sink that merges with the fold ``union``.  A sketch takes
    some 2^log_size bytes at most.
    """
    known = F.when(F.col(value).isNotNull(), F.col(value))
    return df.groupBy(*by).agg(F.hll_sketch_agg(known, log_size).alias(out))


def rolled_up(sketches: DataFrame, by: Sequence[str], sketch: str = "sketch") -> DataFrame:
    """Sketches of coarser groups, united from those of finer ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg(sketch).alias(sketch))


def estimated(sketches: DataFrame, sketch: str = "sketch", out: str = "distinct") -> DataFrame:
    """Sketches replaced by the counts they promise."""
    return sketches.withColumn(out, F.hll_sketch_estimate(sketch)).drop(sketch)
