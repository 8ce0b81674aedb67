"""The interval join of two streams: outer rows, bounded state, refusals; and of two tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tierflow import Pipeline
from tierflow.spec import SpecError
from tierflow.streaming import interval_join

START = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, a int, t timestamp", "k string, b int, s timestamp"
HOUR = timedelta(hours=1)


def rows_of(seed, n, hours):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["x", "y", None]
    return [(rng.choice(keys), i, rng.choice([START + timedelta(minutes=10 * rng.randint(0, 6 * hours)), None] + [START + timedelta(seconds=rng.randint(0, hours * 3600))] * 8)) for i in range(n)]


def by_brute(left, right, low, high, how):
    out = []
    for k, a, t in left:
        found = [(b, s) for rk, b, s in right if None not in (k, t, s) and rk == k and t + low <= s <= t + high]
        out += [(k, a, t, b, s) for b, s in found]
        if not found and how == "left":
            out.append((k, a, t, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("low,high", [(-2 * HOUR, HOUR), (timedelta(0), timedelta(0)), (HOUR, 90 * HOUR)])
def test_tables_equal_brute_force(spark, how, low, high):
    left, right = rows_of(1, 150, 48), rows_of(2, 150, 48)
    got = interval_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", ("t", "s"), (low, high), how)
    assert sorted(map(tuple, got.collect()), key=str) == by_brute(left, right, low, high, how)


def source(spark, folder, rows, schema, at, delay="1 hour"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder).withWatermark(at, delay)


def test_state_shrinks_as_the_watermark_moves(spark, work):
    folders = [f"{work}/{name}" for name in ("l", "r")]
    first = [("hot", n, START + timedelta(minutes=n)) for n in range(600)]
    later = [("none", 9_000, START + timedelta(days=9))]

    def drained(rows):
        left = source(spark, folders[0], rows, LEFT, "t")
        right = source(spark, folders[1], rows, RIGHT, "s")
        joined = interval_join(left, right, "k", ("t", "s"), (-HOUR, HOUR), "left")
        query = joined.writeStream.option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start(f"{work}/out", format="parquet")
        query.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return max(held), held[-1]

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        most, after = drained(first)
        assert most >= 1_200 and after < most
        drained(later)
        # the run after the heartbeat drops what the watermark has passed
        assert drained([("none", 9_001, START + timedelta(days=10))])[1] < 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.read.parquet(f"{work}/out").where("b IS NOT NULL AND k <> 'none'").count() == sum(
        abs(a - b) <= 60 for a in range(600) for b in range(max(0, a - 60), min(600, a + 61))
    )


def test_streams_need_watermarks(spark, work):
    spark.createDataFrame([("a", 1, START)], LEFT).write.parquet(f"{work}/l")
    plain = spark.readStream.schema(LEFT).parquet(f"{work}/l")
    other = plain.select("k", F.col("a").alias("b"), F.col("t").alias("s")).withWatermark("s", "1 hour")
    with pytest.raises(ValueError, match="watermark"):
        interval_join(plain, other, "k", ("t", "s"), (-HOUR, HOUR))


def test_refusals(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    with pytest.raises(ValueError, match="join type"):
        interval_join(left, right, "k", ("t", "s"), (-HOUR, HOUR), "full")
    with pytest.raises(ValueError, match="wrong way"):
        interval_join(left, right, "k", ("t", "s"), (HOUR, -HOUR))
    with pytest.raises(ValueError, match="rename"):
        interval_join(left, right.withColumnRenamed("b", "a"), "k", ("t", "s"), (-HOUR, HOUR))


def test_a_document_declares_a_watermark(spark, work):
    spark.createDataFrame([("a", 1, START)], LEFT).write.parquet(f"{work}/in")
    task = {
        "name": "in",
        "input": {"type": "filestore", "format": "parquet", "path": f"{work}/in", "read-type": "streaming", "watermark": {"column": "t", "delay": "1 hour"}},
        "schema": spark.createDataFrame([], LEFT).schema.jsonValue(),
        "output": {"target": "stg_marked", "type": ["view"]},
    }
    flow = Pipeline(spark, {"name": "marked", "staging": [task]}, working_dir=work)
    view = flow.resolve("standard")["stg_marked"]
    assert view.isStreaming and view.schema["t"].metadata["spark.watermarkDelayMs"] == 3_600_000
    task["input"]["watermark"] = "t"
    with pytest.raises(SpecError, match="watermark"):
        Pipeline(spark, {"name": "marked", "staging": [task]}, working_dir=work).resolve("standard")
