"""Summaries: Spark aggregates each partition before it shuffles, so a hot
group costs one row per input task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def revenue_by(
    df: DataFrame, keys: Sequence[str], amount: str, price: str, total: str = "total"
) -> DataFrame:
    """Sum of amount times price per key, greatest first."""
    revenue = F.sum(F.col(amount) * F.col(price))
    return df.groupBy(*keys).agg(revenue.alias(total)).orderBy(F.desc(total))


def summarize(
    df: DataFrame,
    keys: Sequence[str | Column],
    measures: Mapping[str, Column],
    rows: str | None = None,
) -> DataFrame:
    """Named measures per key; ``rows`` names a row count."""
    counted = [] if rows is None else [F.count("*").alias(rows)]
    named = [measure.alias(name) for name, measure in measures.items()]
    return df.groupBy(*keys).agg(*counted, *named)


def roll_up(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Aggregate a finer summary again: its counts and sums are added up."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def first_rows(df: DataFrame, count: int, *order: str | Column) -> DataFrame:
    """The first ``count`` rows; with an order, which rows is well defined."""
    return (df.orderBy(*order) if order else df).limit(count)
