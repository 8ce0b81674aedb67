"""Aggregates that can be applied to their own results again."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

Measures = Mapping[str, tuple[str, "Column | str"]]

# A sketch of distinct values is folded by union.
FOLDS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "union": F.hll_union_agg,
}


def check_measures(measures: Measures) -> None:
    """``measures`` names results: a fold and the column or expression folded."""
    unknown = sorted({fold for fold, _ in measures.values()} - set(FOLDS))
    if unknown:
        raise ValueError(f"unknown folds {unknown}, expected some of {sorted(FOLDS)}")


def measured(df: DataFrame, names: list[str], measures: Measures) -> DataFrame:
    """The columns ``names`` and each measure's value in a row."""
    values = {name: F.expr(v) if isinstance(v, str) else v for name, (_, v) in measures.items()}
    return df.select(*names, *[v.alias(name) for name, v in values.items()])


def folded(measures: Measures) -> list[Column]:
    return [FOLDS[fold](name).alias(name) for name, (fold, _) in measures.items()]
