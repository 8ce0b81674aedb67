"""Percentile bounds of numeric columns, and trimming rows outside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import ROUND_CEILING, Decimal
from functools import reduce
from math import ceil, isnan, nan

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Share trimmed at either end, and Spark's default accuracy.
LOWER = 0.001
UPPER = 0.999
ACCURACY = 10_000

# Size of a mergeable quantile sketch; it holds a few times as many values.
SKETCH_SIZE = 8192
LARGEST_SKETCH = 65_535
# Sketches of input partitions are merged in this many groups, then together.
SKETCH_GROUPS = 256
# Values sorted by one task while picking an exact percentile.
WINDOW_ROWS = 1_000_000
# Passes over the rows; each but an unlucky one leaves a hundredth of an interval.
MOST_PASSES = 40


def percentile_bounds(
    df: DataFrame,
    columns: Sequence[str],
    lower: float = LOWER,
    upper: float = UPPER,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row with ``<column>_lower_bound`` and ``<column>_upper_bound``.

    Approximate: the rank of a bound is off by about ``rows / accuracy`` at
    most, in 99 runs of 100.  One pass; sketches of the input partitions are
    merged in groups and then together, so no task merges them all.  The
    largest sketch answers for an accuracy of some 10,000.  NaN takes no part.
    """
    # The published error of such a sketch is 2.296 / size ^ 0.9021.
    size = min(LARGEST_SKETCH, max(8, ceil((2.296 * accuracy) ** (1 / 0.9021))))
    sketches = {f"s{i}": _sketch(_number(c), size) for i, c in enumerate(columns)}
    kinds = dict(df.dtypes)
    return _merged(df, sketches, size).select(
        *[
            F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(float(share)))
            .cast(kinds[c])
            .alias(f"{c}_{side}_bound")
            for i, c in enumerate(columns)
            for side, share in (("lower", lower), ("upper", upper))
        ]
    )


def _number(column: str) -> Column:
    """A column as double, NULL instead of NaN."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _sketch(value: Column, size: int) -> Column:
    return F.kll_sketch_agg_double(value, F.lit(size))


def _merged(
    df: DataFrame, sketches: dict[str, Column], size: int, **counts: Column
) -> DataFrame:
    """One row of sketches and of counts, merged in two steps."""
    first = [made.alias(name) for name, made in (sketches | counts).items()]
    merge = [F.kll_merge_agg_double(F.col(n), F.lit(size)).alias(n) for n in sketches]
    total = [F.sum(name).alias(name) for name in counts]
    part = (F.spark_partition_id() % SKETCH_GROUPS).alias("part")
    return df.groupBy(part).agg(*first).agg(*merge, *total)


def trim_outliers(
    df: DataFrame, bounds: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows whose columns all lie within the one row of ``bounds``, ends included.

    The bounds are scalar subqueries, computed once and used as literals of the
    filter; no join is planned.
    """
    within = F.lit(True)
    for c in columns:
        low = bounds.select(f"{c}_lower_bound").scalar()
        high = bounds.select(f"{c}_upper_bound").scalar()
        within &= F.col(c).between(low, high)
    return df.where(within)


@dataclass(frozen=True)
class _Mark:
    """One percentile sought, and the open interval of values it lies in.

    ``below`` rows lie under the interval, ``inside`` rows in it.  ``at`` is the
    value once it is known; ``tries`` are values to split the interval at next.
    """

    name: str
    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    at: float | None = None
    tries: tuple[float, float] | None = None

    def between(self, low: float | None, high: float | None) -> Column:
        """Rows with a number between two values, without them."""
        value = _number(self.column)
        chosen = value.isNotNull()
        chosen = chosen if low is None else chosen & (value > low)
        return chosen if high is None else chosen & (value < high)

    def rows(self) -> Column:
        if self.at is None:
            return self.between(self.low, self.high)
        return _number(self.column) == self.at


def exact_percentile_bounds(
    df: DataFrame,
    columns: Sequence[str],
    lower: float = LOWER,
    upper: float = UPPER,
    sketch_size: int = SKETCH_SIZE,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """The bounds of :func:`percentile_bounds`, exact and the same on every run.

    A bound is the smallest value with at least its share of the non-NULL rows
    at or below it; NaN is above all numbers.  The first pass counts and
    sketches the columns.  Each further pass counts how an interval around a
    bound splits at two values of the sketch, so the part that holds the bound
    is known for certain, and sketches the middle part at once.  When few
    values are left their running counts give the bound: four passes for a
    hundred billion rows.  The rows are counted before, without any column, and
    as few as are left at the end are not sketched at all.  The driver sees only
    ends of intervals, counts and merged sketches.  ``df`` is read a few times: store it first if it is
    costly to compute.
    """
    few = df.count() <= window_rows
    marks = _first_pass(df, columns, (lower, upper), 0 if few else sketch_size)
    for _ in range(MOST_PASSES):
        wide = [m for m in marks if m.at is None and m.inside > window_rows]
        if not wide:
            return _pick(df, marks)
        split = {m.name: m for m in _split(df, wide, sketch_size)}
        marks = [split.get(m.name, m) for m in marks]
    raise RuntimeError(f"after {MOST_PASSES} passes over {window_rows} values are left")


def _first_pass(
    df: DataFrame, columns: Sequence[str], shares: tuple[float, float], sketch_size: int
) -> list[_Mark]:
    """Marks over the whole columns; ranks among NaN are settled.

    Without a ``sketch_size`` the columns are counted only.
    """
    counts, sketches = {}, {}
    for i, c in enumerate(columns):
        counts |= {f"rows{i}": F.count(c), f"numbers{i}": F.count(_number(c))}
        if sketch_size:
            sketches[f"s{i}"] = _sketch(_number(c), sketch_size)
    if sketch_size:
        found = _merged(df, sketches, sketch_size, **counts).first()
    else:
        found = df.agg(*[count.alias(name) for name, count in counts.items()]).first()
    marks, held = [], []
    for i, c in enumerate(columns):
        rows, numbers = found[f"rows{i}"] or 0, found[f"numbers{i}"] or 0
        for side, share in zip(("lower", "upper"), shares):
            rank = (Decimal(str(share)) * rows).to_integral_value(ROUND_CEILING)
            mark = _Mark(f"{c}_{side}_bound", c, max(1, int(rank)), numbers)
            marks.append(replace(mark, at=nan) if rows and mark.rank > numbers else mark)
            held.append(found[f"s{i}"] if sketch_size else None)
    return _with_tries(df, marks, held, sketch_size)


def _split(df: DataFrame, marks: list[_Mark], sketch_size: int) -> list[_Mark]:
    """Each mark in the part of its interval that holds its rank."""
    counts, sketches = {}, {}
    for i, m in enumerate(marks):
        value = _number(m.column)
        low, high = m.tries or (m.low, m.high)
        middle = m.between(low, high)
        sketches[f"s{i}"] = _sketch(F.when(middle, value), sketch_size)
        if m.tries:
            counts |= {
                f"under{i}": F.count_if(m.between(m.low, low)),
                f"low{i}": F.count_if(value == low),
                f"middle{i}": F.count_if(middle),
                f"high{i}": F.count_if((value == high) & (value != low)),
            }
    rows = df.where(reduce(Column.__or__, [m.rows() for m in marks]))
    found = _merged(rows, sketches, sketch_size, **counts).first()
    result, held = [], []
    for i, m in enumerate(marks):
        part = m if m.tries is None else _part(m, *(found[f"{k}{i}"] for k in _PARTS))
        whole = part is m or (part.low, part.high) == m.tries and part.at is None
        result.append(part)
        held.append(found[f"s{i}"] if whole else None)
    return _with_tries(df, result, held, sketch_size)


_PARTS = ("under", "low", "middle", "high")


def _part(mark: _Mark, under: int, at_low: int, middle: int, at_high: int) -> _Mark:
    """Where the rank lies, by the rows of the parts in order."""
    low, high = mark.tries
    mark = replace(mark, tries=None)
    if mark.rank <= mark.below + under:
        return replace(mark, high=low, inside=under)
    below = mark.below + under
    if mark.rank <= below + at_low:
        return replace(mark, at=low, below=below)
    below += at_low
    if mark.rank <= below + middle:
        return replace(mark, low=low, high=high, below=below, inside=middle)
    below += middle
    if mark.rank <= below + at_high:
        return replace(mark, at=high, below=below)
    below += at_high
    return replace(mark, low=high, below=below, inside=mark.inside - (below - mark.below))


def _with_tries(
    df: DataFrame, marks: list[_Mark], sketches: list, sketch_size: int
) -> list[_Mark]:
    """Marks with values some way below and above their rank, where sketched."""
    known = [i for i, s in enumerate(sketches) if s is not None and marks[i].inside]
    if not known:
        return marks
    # Over three times the rank error published for sketches of this size.
    slack = 10 / sketch_size
    ends = []
    for i in known:
        share = min(1.0, (marks[i].rank - marks[i].below) / marks[i].inside)
        for end, at in (("low", max(0.0, share - slack)), ("high", min(1.0, share + slack))):
            quantile = F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(at))
            ends.append(quantile.alias(f"{end}{i}"))
    schema = ", ".join(f"s{i} binary" for i in known)
    held = [tuple(sketches[i] for i in known)]
    found = df.sparkSession.createDataFrame(held, schema).select(*ends).first()
    return [
        replace(m, tries=(found[f"low{i}"], found[f"high{i}"])) if i in known else m
        for i, m in enumerate(marks)
    ]


def _pick(df: DataFrame, marks: list[_Mark]) -> DataFrame:
    """Running counts of the distinct values in each interval reach its rank."""
    kinds = dict(df.dtypes)
    picks = {m.name: F.lit(nan).cast(kinds[m.column]).alias(m.name) for m in marks}
    groups: dict[tuple, list[_Mark]] = {}
    for m in marks:
        if m.at is None or not isnan(m.at):
            groups.setdefault((m.column, m.low, m.high, m.at), []).append(m)
    if not groups:
        return df.sparkSession.range(1).select(*[picks[m.name] for m in marks])
    firsts = [group[0] for group in groups.values()]
    reached = _reached(df, [(m.rows(), m.column) for m in firsts])
    for i, group in enumerate(groups.values()):
        for m in group:
            hit = (F.col("group") == i) & (F.col("reached") >= m.rank - m.below)
            picks[m.name] = F.min(F.when(hit, F.col(f"v{i}"))).alias(m.name)
    return reached.agg(*[picks[m.name] for m in marks])


def _reached(df: DataFrame, chosen: list[tuple[Column, str]]) -> DataFrame:
    """Distinct values of each choice of rows and column, with running counts.

    Choice ``i`` has its values in ``v<i>``, of the column's own type; choices
    of one type share a column while they are counted.
    """
    kinds = dict(df.dtypes)
    types = sorted({kinds[c] for _, c in chosen})
    entries = []
    for i, (rows, c) in enumerate(chosen):
        fields = [
            (F.col(c) if kinds[c] == kind else F.lit(None).cast(kind)).alias(f"of{t}")
            for t, kind in enumerate(types)
        ]
        entries.append(F.when(rows, F.struct(F.lit(i).alias("group"), *fields)))
    values = df.where(reduce(Column.__or__, [rows for rows, _ in chosen]))
    values = values.select(F.explode(F.array(*entries)).alias("entry"))
    values = values.where(F.col("entry").isNotNull()).select("entry.*")
    names = [f"of{t}" for t in range(len(types))]
    counts = values.groupBy("group", *names).agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("group").orderBy(*names)
    reached = counts.withColumn("reached", F.sum("rows").over(upto))
    return reached.withColumns(
        {f"v{i}": F.col(f"of{types.index(kinds[c])}") for i, (_, c) in enumerate(chosen)}
    )
