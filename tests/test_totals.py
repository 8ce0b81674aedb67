"""Running totals, cubes and distinct counts against brute force and under skew."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from tierflow.operators import cube, distinct_counts, distinct_sketches, estimated, rolled_up, rollup, running_total
from tierflow.sinks.keyed import KeyedFiles

ROWS = "k string, at int, v bigint, w double"


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot"] * 5 + ["a", None]), rng.choice([7, rng.randint(0, 200), None]), rng.choice([None, *range(9)]), float(i))
        for i in range(n)
    ]


def first(at):
    return (at is not None, at or 0)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("slice_rows", [1_000_000, 10])
def test_running_totals_equal_brute_force(spark, keys, slice_rows):
    rows = rows_of(1)
    got = running_total(spark.createDataFrame(rows, ROWS), "at", {"sum_v": "v", "sum_w": "w"}, keys, ranges=7, slice_rows=slice_rows)
    assert got.columns == ["k", "at", "v", "w", "sum_v", "sum_w"]
    expected = []
    for k, at, v, w in rows:
        upto = [r for r in rows if first(r[1]) <= first(at) and (not keys or r[0] == k)]
        some = [r[2] for r in upto if r[2] is not None]
        expected.append((k, at, v, w, sum(some) if some else None, sum(r[3] for r in upto)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_no_task_sees_the_whole_table(spark):
    df = spark.range(5_000).withColumn("v", F.lit(1).cast("bigint"))
    got = running_total(df, "id", {"sofar": "v"})
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("sofar <> id + 1").count() == 0
    assert running_total(df.limit(0), "id", {"sofar": "v"}).count() == 0
    with pytest.raises(ValueError, match="already"):
        running_total(df, "id", {"V": "v"})


def by_brute(rows, levels, by):
    out = {}
    for kept in levels:
        level = sum(1 << (len(by) - 1 - n) for n, name in enumerate(by) if name not in kept)
        for row in rows:
            key = (*[row[n] if name in kept else None for n, name in enumerate(by)], level)
            n, total, low = out.get(key, (0, None, None))
            v = row[2]
            out[key] = (n + 1, total if v is None else v + (total or 0), v if low is None else low if v is None else min(low, v))
    return out


def test_cubes_and_rollups_equal_brute_force(spark):
    rows, by = [(k, at and at % 3, v) for k, at, v, _ in rows_of(2)], ["k", "at"]
    df = spark.createDataFrame(rows, "k string, at int, v bigint")
    measures = {"n": ("sum", "1L"), "total": ("sum", "v"), "low": ("min", "v")}
    for make, levels in ((cube, [c for n in range(3) for c in combinations(by, n)]), (rollup, [("k", "at"), ("k",), ()])):
        got = make(df, by, measures)
        assert got.columns == ["k", "at", "n", "total", "low", "level"]
        assert {(r.k, r["at"], r.level): (r.n, r.total, r.low) for r in got.collect()} == by_brute(rows, levels, by)
    assert cube(df.limit(0), by, measures).count() == 0
    with pytest.raises(ValueError, match="folds"):
        cube(df, by, {"n": ("avg", "v")})
    with pytest.raises(ValueError, match="levels"):
        cube(df, list("abcdefghijklm"), measures)


def test_levels_are_built_from_stored_ones(spark, monkeypatch):
    """Rows are read once: the plan that is written first has no Expand, the others read files."""
    from tierflow.operators import cubes

    seen = []
    monkeypatch.setattr(cubes, "folded", lambda m: seen.append(m) or [F.sum("n").alias("n")])
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    got = cube(df, ["a", "b", "c"], {"n": ("sum", "1L")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "LogicalRDD" not in plan and len(seen) == 8


def test_distinct_counts_and_sketches(spark):
    rows = [("hot", n % 5_000) for n in range(20_000)] + [("a", 1), ("a", None), ("b", None), (None, 3)]
    df = spark.createDataFrame(rows, "k string, v int")
    exact = {r.k: r["distinct"] for r in distinct_counts(df, ["k"], "v").collect()}
    assert exact == {"hot": 5_000, "a": 1, "b": 0, None: 1}
    fine = distinct_sketches(df.withColumn("part", F.col("v") % 7), ["k", "part"], "v")
    coarse = {r.k: r["distinct"] for r in estimated(rolled_up(fine, ["k"])).collect()}
    assert all(abs(coarse[k] - n) <= 0.05 * n for k, n in exact.items())


def test_sketches_are_folded_over_batches(spark, work):
    keyed = KeyedFiles(spark, work, ["k"], buckets=2)
    for batch in range(3):
        rows = spark.range(batch * 500, batch * 500 + 1_000).selectExpr("id % 2 AS k", "id AS v")
        keyed.fold(distinct_sketches(rows, ["k"], "v"), {"sketch": "union"}, writer="s", batch=batch)
    counts = {r.k: r["distinct"] for r in estimated(keyed.read()).collect()}
    assert all(abs(n - 1_000) <= 50 for n in counts.values()) and set(counts) == {0, 1}
