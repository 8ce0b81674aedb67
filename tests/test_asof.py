"""The as-of join against brute force: directions, ties, hot keys, hot instants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tierflow.operators import asof_join

LEFT, RIGHT = "k int, g string, t bigint, a int", "k int, g string, s bigint, b int"


def rows_of(seed, keys, n, span):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randint(1, keys)
        time = rng.choice([5, rng.randint(0, span), rng.randint(0, span) * 1_000])
        out.append((rng.choice([key, key, key, None]), rng.choice("xy"), rng.choice([time] * 9 + [None]), i))
    return out


def by_brute(left, right, direction, tolerance, equal):
    out = []
    for k, g, t, a in left:
        best = None
        for rk, rg, s, b in right:
            if None in (k, t, s) or (rk, rg) != (k, g) or (s == t and not equal):
                continue
            if (direction == "backward" and s > t) or (direction == "forward" and s < t):
                continue
            if tolerance is not None and abs(s - t) > tolerance:
                continue
            rank = (-abs(s - t), -s, b)
            if best is None or rank > best[0]:
                best = rank, s, b
        out.append((k, g, t, a, *(best[1:] if best else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("options", [{}, {"equal": False, "tolerance": 40}, {"slot_points": 20, "slice_rows": 15}])
def test_equals_brute_force(spark, direction, options):
    left, right = rows_of(1, 9, 400, 60), rows_of(2, 9, 250, 60)
    got = asof_join(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "g"], ("t", "s"),
        order=["b"], direction=direction, **options,
    )
    assert got.columns == ["k", "g", "t", "a", "s", "b"]
    expected = by_brute(left, right, direction, options.get("tolerance"), options.get("equal", True))
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_a_hot_key_is_spread_over_slots(spark, monkeypatch):
    """A key with all rows: no window has more than a few of its points, whatever the times."""
    from tierflow.operators import asof

    seen = []
    handed = asof._nearest
    monkeypatch.setattr(asof, "_nearest", lambda points, *rest: seen.append(points) or handed(points, *rest))
    # most times lie in one hundredth of the whole span
    left = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * F.when(F.col("id") < 39_000, 1).otherwise(99)).alias("t"))
    right = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * 2 + 1).alias("s"))
    got = asof_join(left, right, "k", ("t", "s"), slot_points=1_000)
    wrong = got.where(~F.col("s").eqNullSafe(F.when(F.col("t") > 0, F.least(F.col("t") - F.when(F.col("t") % 2 == 0, 1).otherwise(0), F.lit(79_999)))))
    assert wrong.count() == 0 and got.count() == 40_000
    sizes = [r["count"] for r in seen[0].groupBy("__slot").count().collect()]
    assert len(sizes) > 500 and max(sizes) < 5 * sum(sizes) / len(sizes)


def test_no_range_condition_is_planned(spark):
    left, right = spark.createDataFrame([(1, "x", 5, 0)], LEFT), spark.createDataFrame([(1, "x", 3, 9)], RIGHT)
    got = asof_join(left, right, ["k", "g"], ("t", "s"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.replace("<=>", "=") for line in plan.splitlines() if "Join" in line]
    assert joins and not any(sign in line for line in joins for sign in ("<", ">", "Cross"))
    assert "Python" not in plan


def test_times_and_intervals(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    left = spark.createDataFrame([(1, day(2)), (1, day(5)), (2, day(2))], "k int, t timestamp")
    right = spark.createDataFrame([(1, day(1, 12), "a"), (1, day(3), "b")], "k int, s timestamp, b string")
    got = asof_join(left, right, "k", ("t", "s"), direction="nearest", tolerance="12 hours")
    assert sorted((r.k, r.t, r.b) for r in got.collect()) == [(1, day(2), "a"), (1, day(5), None), (2, day(2), None)]


def test_empty_sides_and_refusals(spark):
    left, right = spark.createDataFrame([(1, "x", 5, 0)], LEFT), spark.createDataFrame([], RIGHT)
    assert asof_join(left, right, ["k", "g"], ("t", "s")).collect() == [(1, "x", 5, 0, None, None)]
    assert asof_join(left.limit(0), right, ["k", "g"], ("t", "s")).count() == 0
    with pytest.raises(ValueError, match="direction"):
        asof_join(left, right, ["k", "g"], ("t", "s"), direction="sideways")
    with pytest.raises(ValueError, match="rename"):
        asof_join(left, right.withColumnRenamed("b", "A"), ["k", "g"], ("t", "s"))
