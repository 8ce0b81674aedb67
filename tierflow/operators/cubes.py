"""Cubes and rollups built level by level from the finest groups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..workspace import scratch_dir
from .folds import Measures, check_measures, folded, measured

# Levels double with every column of a cube.
MOST_COLUMNS = 12


def cube(df: DataFrame, by: Sequence[str], measures: Measures) -> DataFrame:
    """Groups by every subset of the columns ``by``, as SQL's ``GROUP BY CUBE``."""
    if len(by) > MOST_COLUMNS:
        raise ValueError(f"a cube of {len(by)} columns has {2 ** len(by)} levels; take at most {MOST_COLUMNS}")
    levels = [kept for size in range(len(by), -1, -1) for kept in combinations(by, size)]
    return lattice(df, by, levels, measures)


def rollup(df: DataFrame, by: Sequence[str], measures: Measures) -> DataFrame:
    """Groups by every beginning of the columns ``by``, as SQL's ``GROUP BY ROLLUP``."""
    return lattice(df, by, [tuple(by[:size]) for size in range(len(by), -1, -1)], measures)


def lattice(
    df: DataFrame, by: Sequence[str], levels: Sequence[Sequence[str]], measures: Measures
) -> DataFrame:
    """Groups by each of ``levels``, sets of the columns ``by``: columns, measures, ``level``.

    ``measures`` names results: a fold (sum, min, max, or union of sketches) and the
    column or expression folded.  Columns that a level does not group by are NULL; bit
    i of ``level``, counted from the last column, is set where column i is not grouped
    by, as SQL's ``GROUPING``.

    Rows are read and grouped once, by all columns.  Every level is then folded from
    the smallest level stored that has its columns, so rows are never multiplied
    by the number of levels.  Levels are stored below the session's shared folder.
    A level of no columns over an empty table has no rows.
    """
    check_measures(measures)
    spark, by = df.sparkSession, list(by)
    if any(set(level) - set(by) for level in levels):
        raise ValueError(f"levels {levels} are not made of {by}")
    root, held = scratch_dir(spark, "lattice"), {}

    def store(rows: DataFrame, kept: frozenset) -> None:
        path = f"{root}/{sum(1 << n for n, name in enumerate(by) if name in kept)}"
        rows.write.parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        held[kept] = stored, stored.count()

    finest = measured(df, by, measures).groupBy(*by).agg(*folded(measures))
    store(finest, frozenset(by))
    wanted = [frozenset(level) for level in levels]
    for kept in sorted(set(wanted) - set(held), key=len, reverse=True):
        parents = [(count, rows) for columns, (rows, count) in held.items() if kept < columns]
        count, rows = min(parents, key=lambda parent: parent[0])
        names = [name for name in by if name in kept]
        store(rows.groupBy(*names).agg(*folded(measures)) if count else rows.select(*names, *measures), kept)
    out = None
    for kept in wanted:
        level = sum(1 << (len(by) - 1 - n) for n, name in enumerate(by) if name not in kept)
        columns = [F.col(n) if n in kept else F.lit(None).cast(df.schema[n].dataType).alias(n) for n in by]
        rows = held[kept][0].select(*columns, *measures, F.lit(level).alias("level"))
        out = rows if out is None else out.unionAll(rows)
    return out
