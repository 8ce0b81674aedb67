"""Sessions against brute force: gaps, slots of hot keys, streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tierflow.operators import sessions, slots

SCHEMA, START, GAP = "k string, j int, at timestamp, v int", datetime(2024, 1, 1), timedelta(minutes=10)
MEASURES = {"n": ("sum", "1L"), "low": ("min", "v"), "total": ("sum", "CAST(v AS bigint)")}


def rows_of(seed, n=800):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = rng.choice(["hot"] * 4 + ["a", "b", None])
        time = START + timedelta(minutes=rng.choice([rng.randint(0, 3000), rng.randint(0, 60), 30]))
        out.append((key, rng.choice([1, 2]), rng.choice([time] * 20 + [None]), rng.randint(0, 99)))
    return out


def by_brute(rows):
    out = {}
    for key in {(k, j) for k, j, *_ in rows}:
        mine = sorted((at, v) for k, j, at, v in rows if (k, j) == key and at is not None)
        open_ = []
        for at, v in [*mine, (datetime(9999, 1, 1), 0)]:
            if open_ and at - open_[-1][0] > GAP:
                values = [v for _, v in open_]
                out[(*key, open_[0][0], open_[-1][0] + GAP)] = (len(open_), min(values), sum(values))
                open_ = []
            open_.append((at, v))
    return out


def result(df):
    got = [((r.k, r.j, r.session_start, r.session_end), (r.n, r.low, r.total)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("slot_rows", [10_000, 50, 1])
def test_equals_brute_force(spark, slot_rows):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(sessions(df, ["k", "j"], "at", GAP, MEASURES, slot_rows=slot_rows)) == by_brute(rows)


def test_a_session_over_many_slots_is_one(spark):
    """Rows of one key a minute apart: every slot's session goes on in the next."""
    df = spark.range(5_000).selectExpr("'k' AS k", "1 AS j", f"timestamp'{START}' + id * INTERVAL 1 MINUTE AS at", "CAST(id AS int) AS v")
    got = result(sessions(df, ["k", "j"], "at", GAP, MEASURES, slot_rows=100))
    end = START + timedelta(minutes=4_999) + GAP
    assert got == {("k", 1, START, end): (5_000, 0, sum(range(5_000)))}


def test_a_hot_key_is_spread(spark, monkeypatch):
    from tierflow.operators import sessions as module  # noqa: F401
    import sys

    module = sys.modules["tierflow.operators.sessions"]
    seen = []
    monkeypatch.setattr(module, "with_slots", lambda *args: seen.append(slots.with_slots(*args)) or seen[-1])
    df = spark.range(20_000).selectExpr("'k' AS k", f"timestamp'{START}' + id * INTERVAL 1 HOUR AS at", "1 AS v")
    assert sessions(df, "k", "at", GAP, MEASURES, slot_rows=500).count() == 20_000
    sizes = [r["count"] for r in seen[0].groupBy("__slot").count().collect()]
    assert len(sizes) > 900 and max(sizes) < 60


def test_stream_equals_batch(spark, work):
    rows = [row for row in rows_of(2, 300) if row[2] is not None]
    rows.sort(key=lambda row: row[2])
    heart = [[("none", 1, START + timedelta(days=days), 0)] for days in (90, 91)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (rows[:150], rows[150:], *heart):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{work}/in")
            found = sessions(stream, ["k", "j"], "at", GAP, MEASURES, delay=timedelta(minutes=5))
            query = found.writeStream.option("checkpointLocation", f"{work}/c").trigger(availableNow=True)
            query.start(f"{work}/out", format="parquet").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.parquet(f"{work}/out").where(~F.col("k").eqNullSafe("none"))
    assert result(got) == by_brute(rows)


def test_empty_and_refused(spark):
    df = spark.createDataFrame([("a", 1, None, 2)], SCHEMA)
    assert sessions(df, ["k"], "at", GAP, MEASURES).count() == 0
    assert sessions(df.limit(0), ["k"], "at", GAP, MEASURES).count() == 0
    with pytest.raises(ValueError, match="folds"):
        sessions(df, ["k"], "at", GAP, {"n": ("avg", "v")})
