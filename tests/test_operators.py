import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierflow import operators as ops
from tierflow.operators import joins, percentiles
from tierflow.operators.joins import hot_keys

DAY = datetime(2024, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


# --- temporal join -----------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """Facts of which a third have one key and some have none, and their versions."""
    rng = random.Random(7)
    facts, versions = [], []
    for n in range(3000):
        key = 1 if n % 3 == 0 else None if n % 11 == 0 else rng.randrange(2, 60)
        facts.append((n % 1000, key, DAY + timedelta(hours=rng.randrange(24 * 40))))
    for key in range(1, 50):
        start = DAY
        for _ in range(rng.randrange(1, 5)):
            end = start + timedelta(days=rng.randrange(1, 15))
            versions.append((key, f"v{len(versions)}", start, end))
            start = end
    versions.append((1, "overlap", DAY, DAY + timedelta(days=3)))
    return facts, versions


def brute_force(facts, versions):
    expected = []
    for n, key, at in facts:
        valid = [v for k, v, s, e in versions if k == key and s <= at < e]
        expected += [(n, key, v) for v in valid] or [(n, key, None)]
    return sorted(expected, key=str)


def frames(spark, skewed):
    facts, versions = skewed
    return (
        spark.createDataFrame(facts, "n int, key int, at timestamp").repartition(5),
        spark.createDataFrame(
            versions, "id int, name string, start timestamp, until timestamp"
        ),
    )


def joined(left, right, **options):
    df = ops.temporal_left_join(
        left, right, on=("key", "id"), at="at", valid=("start", "until"), **options
    )
    return df.select("fact.n", "fact.key", "version.name")


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"few_versions": 1},
        {"broadcast_bytes": 10, "slice_rows": 150},
        {"broadcast_bytes": 10, "slice_rows": 150, "few_versions": 1},
    ],
)
def test_temporal_join_equals_brute_force(spark, skewed, options):
    found = joined(*frames(spark, skewed), **options).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(*skewed)


def test_small_dimension_is_broadcast(spark, skewed):
    plan = plan_of(joined(*frames(spark, skewed)))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_large_dimension_is_shuffled_with_slices(spark, skewed):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joined(*frames(spark, skewed), broadcast_bytes=10, slice_rows=150)
        plan = plan_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    physical = plan[plan.index("== Physical Plan") :]
    assert "SortMergeJoin [key" in physical
    assert "__slice" in physical
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_hot_keys_are_cut_by_their_rows(spark, skewed):
    facts, _ = frames(spark, skewed)
    found = {r["__hot"]: r["__slices"] for r in hot_keys(facts, "key", 150).collect()}
    assert set(found) == {1, None}
    assert found[1] == math.ceil(1000 / 150)
    assert hot_keys(facts, "key", 1).count() > 50


def test_broadcast_is_decided_by_measured_size(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert ops.broadcast_fits(df, 200_000)
    assert not ops.broadcast_fits(df, 100_000)
    assert ops.broadcast_fits(df.where("s = ''"), 0)
    nested = df.select(F.array("s", "s").alias("a"), F.lit(None).cast("string").alias("n"))
    assert not ops.broadcast_fits(nested, 200_000)
    assert ops.broadcast_fits(nested, 300_000)


def crowd(overlapping: bool):
    """Versions of which a third belong to one key, and facts all over their time."""
    rng = random.Random(11)
    versions = []
    for key, count in ((1, 300), (2, 200), (3, 3), (None, 100)):
        start = DAY
        for _ in range(count):
            end = start + timedelta(minutes=rng.randrange(1, 400))
            until = datetime(2099, 12, 31) if overlapping and rng.random() < 0.2 else end
            versions.append((key, f"v{len(versions)}", start, until))
            start = end + timedelta(minutes=rng.randrange(0, 3))
    versions += [(1, "empty", DAY, DAY), (1, "swapped", DAY + timedelta(days=9), DAY)]
    versions += [(1, "no end", DAY, None), (1, "no start", None, DAY)]
    keys = [1, 1, 1, 2, 3, 4, None]
    facts = [
        (n, rng.choice(keys), DAY + timedelta(minutes=rng.randrange(-99, 99999)))
        for n in range(400)
    ]
    facts += [(1000 + n, k, s) for n, (k, _, s, _) in enumerate(versions) if s]
    facts += [(3000 + n, k, e) for n, (k, _, _, e) in enumerate(versions) if e]
    facts.append((5000, 1, None))
    return facts, versions


def crowd_brute_force(facts, versions):
    expected = []
    for n, key, at in facts:
        valid = [
            v
            for k, v, s, e in versions
            if None not in (k, s, e, at) and k == key and s <= at < e
        ]
        expected += [(n, key, v) for v in valid] or [(n, key, None)]
    return sorted(expected, key=str)


@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz", "bigint", "decimal(30,6)"])
@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize(
    "options",
    [
        {},
        {"broadcast_bytes": 10, "slice_rows": 150},
        # The list of crowded keys is too long to send: it is joined by a shuffle.
        {"broadcast_bytes": 10, "slice_rows": 150, "listed_keys": 0},
    ],
)
def test_crowded_keys_equal_brute_force(spark, time, overlapping, options):
    case = crowd(overlapping)
    left, right = frames(spark, case)

    def timed(name):
        if time == "bigint":
            return F.unix_micros(name)
        return F.col(name).cast(time)

    left = left.withColumn("at", timed("at"))
    right = right.withColumns({c: timed(c) for c in ("start", "until")})
    df = joined(left, right, **options)
    assert "__slot" in plan_of(df)
    assert sorted(map(tuple, df.collect()), key=str) == crowd_brute_force(*case)


def test_text_times_of_a_crowded_key_are_refused(spark):
    left, right = frames(spark, crowd(False))
    left = left.withColumn("at", F.col("at").cast("string"))
    right = right.withColumns({c: F.col(c).cast("string") for c in ("start", "until")})
    with pytest.raises(ValueError, match="cannot be cut"):
        joined(left, right)
    joined(left, right.where("id = 3")).collect()


def test_every_key_over_the_limit_is_cut_whatever_the_total(spark):
    """A key of a hundred versions among a hundred thousand keys of one."""
    many = spark.range(100_000).selectExpr(
        "CAST(id + 10 AS INT) AS id", "'v' AS name", "0D AS start", "1e9D AS until"
    )
    crowded = spark.range(100).selectExpr(
        "1 AS id", "CAST(id AS STRING) AS name", "CAST(id AS DOUBLE) AS start", "id + 1D AS until"
    )
    facts = spark.range(1000).selectExpr(
        "CAST(id AS INT) AS n", "IF(id < 500, 1, CAST(id AS INT)) AS key", "(id % 100) + 0.5D AS at"
    )
    df = joined(facts, many.union(crowded), broadcast_bytes=10)
    assert "__slot" in plan_of(df) and "__slice" in plan_of(df)
    rows = df.collect()
    assert len(rows) == 1000
    assert all(r.name == (str(r.n % 100) if r.n < 500 else "v") for r in rows)


def test_broadcast_is_decided_by_what_is_sent(spark):
    """Versions that fit before they are repeated per slot, and not after."""
    left, right = frames(spark, crowd(True))
    bytes_ = right.agg(F.sum(joins._width(right))).first()[0]
    assert ops.broadcast_fits(right, bytes_)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "__slice" in plan_of(joined(left, right, broadcast_bytes=bytes_))
        assert "__slice" not in plan_of(joined(left, right, broadcast_bytes=8 * bytes_))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_slots_bound_the_rows_of_a_crowded_key(spark):
    """Open-ended versions overlap, and still are not repeated per slot."""
    for overlapping in (False, True):
        _, right = frames(spark, crowd(overlapping))
        ticks = joins._ticks("timestamp", "timestamp", "timestamp")
        span = ("start", "until")
        slots = joins._slots_of_crowded_keys(right, "id", span, ticks, 64, F.broadcast)
        assert {r["__crowded"] for r in slots.collect()} == {1, 2}
        repeated = joins._with_slots(right, "id", span, slots, ticks)
        assert right.count() <= repeated.count() <= 3 * right.count()


def test_join_leaves_no_columns_of_its_own(spark):
    left, right = frames(spark, crowd(False))
    df = ops.temporal_left_join(
        left,
        right,
        on=("key", "id"),
        at="at",
        valid=("start", "until"),
        broadcast_bytes=10,
    )
    assert df.columns == ["n", "key", "at", "id", "name", "start", "until"]
    assert df.select("fact.*").columns == ["n", "key", "at"]


def test_times_order_as_they_compare(spark):
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), DAY, DAY + timedelta(microseconds=1)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    seconds = [r[0] for r in df.select(joins._ticks("timestamp_ntz")("t")).collect()]
    assert seconds == sorted(set(seconds))
    with pytest.raises(ValueError, match="cannot be cut"):
        joins._ticks("string", "string", "string")


def test_streaming_facts_against_static_versions(spark, skewed, tmp_path):
    facts, versions = frames(spark, skewed)
    landing, out = str(tmp_path / "facts"), str(tmp_path / "out")
    facts.write.parquet(landing)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2)
    stream = stream.parquet(landing)
    # Streaming facts cannot be counted: the caller names what is hot.
    named = {"broadcast_bytes": 10, "hot": {1: 4, 7: 2}}
    for n, options in enumerate(({}, {"broadcast_bytes": 10}, {"few_versions": 1}, named)):
        df = joined(stream, versions, **options)
        assert ("__slice" in plan_of(df)) == (options is named)
        writer = df.writeStream.trigger(availableNow=True)
        writer = writer.option("checkpointLocation", str(tmp_path / f"chk{n}"))
        writer.format("parquet").start(f"{out}{n}").awaitTermination()
        found = spark.read.parquet(f"{out}{n}").collect()
        assert sorted(map(tuple, found), key=str) == brute_force(*skewed)


# --- percentiles -------------------------------------------------------------


def exact(values, share):
    ordered = sorted(v for v in values if v is not None)
    return ordered[max(1, math.ceil(round(share * len(ordered), 9))) - 1]


def spread(kind, count=20_000):
    rng = random.Random(3)
    if kind == "ties":
        # A third of the rows are one value, right at a bound for some shares.
        return [5.0 if n % 3 == 0 else float(rng.randrange(10)) for n in range(count)]
    if kind == "outliers":
        return [rng.expovariate(0.1) for _ in range(count - 3)] + [1e12, -1e12, 1e300]
    if kind == "sorted":
        return sorted(rng.random() for _ in range(count))
    return [None if n % 5 == 0 else rng.gauss(0, 100) for n in range(count)]


@pytest.mark.parametrize("kind", ["ties", "outliers", "sorted", "nulls"])
@pytest.mark.parametrize("shares", [(0.001, 0.999), (1 / 3, 0.5), (0.0, 1.0)])
def test_exact_bounds_equal_sorting(spark, kind, shares):
    values = spread(kind)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    expected = {
        "x_lower_bound": exact(values, shares[0]),
        "x_upper_bound": exact(values, shares[1]),
    }
    at_once = ops.exact_percentile_bounds(df, ["x"], *shares)
    assert at_once.first().asDict() == expected
    # A small window makes the same bounds come from narrowing brackets.
    narrowed = ops.exact_percentile_bounds(
        df, ["x"], *shares, sketch_size=200, window_rows=50
    )
    assert narrowed.first().asDict() == expected


def test_intervals_narrow_whatever_the_order_of_rows(spark):
    """Partitions that each hold a range of values, as clustered files do."""
    df = spark.range(0, 400_000, 1, 40).select(F.col("id").cast("double").alias("x"))
    marks = percentiles._first_pass(df, ["x"], (0.001, 0.999), 200)
    for rows_left in (400_000 * 0.2, 400_000 * 0.04):
        marks = percentiles._split(df, marks, 200)
        for mark in marks:
            assert mark.inside < rows_left
            assert mark.below < mark.rank <= mark.below + mark.inside
    found = ops.exact_percentile_bounds(df, ["x"], sketch_size=200, window_rows=1000)
    assert found.first().asDict() == {"x_lower_bound": 399.0, "x_upper_bound": 399_599.0}


def test_a_poor_sketch_costs_passes_and_never_the_answer(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 500).cast("double").alias("x"))
    right = percentiles.F.kll_sketch_get_quantile_double
    # Values of the sketch, but far from the share asked for.
    monkeypatch.setattr(
        percentiles.F,
        "kll_sketch_get_quantile_double",
        lambda sketch, share: right(sketch, F.lit(0.3)),
    )
    found = ops.exact_percentile_bounds(df, ["x"], 0.5, 0.9, window_rows=10)
    assert found.first().asDict() == {"x_lower_bound": 249.0, "x_upper_bound": 449.0}
    # Values that are none of the sketch's: nothing narrows, and that is said.
    monkeypatch.setattr(
        percentiles.F, "kll_sketch_get_quantile_double", lambda sketch, share: F.lit(-1.0)
    )
    with pytest.raises(RuntimeError, match="passes"):
        ops.exact_percentile_bounds(df, ["x"], 0.5, 0.9, window_rows=10)


@pytest.mark.parametrize("window_rows", [10, 1_000_000])
def test_nan_is_above_all_numbers(spark, window_rows):
    values = [float(n) for n in range(700)] + [math.nan] * 300 + [math.inf] * 5 + [-math.inf] * 5
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    for low, high in ((0.001, 0.5), (0.003, 0.698), (0.7, 0.705), (0.71, 1.0)):
        found = ops.exact_percentile_bounds(
            df, ["x"], low, high, sketch_size=200, window_rows=window_rows
        ).first()
        ordered = sorted(values, key=lambda v: (math.isnan(v), v))
        for bound, share in zip(found, (low, high)):
            expected = ordered[max(1, math.ceil(round(share * len(ordered), 9))) - 1]
            assert bound == expected or math.isnan(bound) and math.isnan(expected)


def test_exact_bounds_of_long_and_decimal_columns(spark):
    base = 1 << 60  # doubles cannot tell neighbours apart here
    df = spark.range(2000).select((F.col("id") + base).alias("n"), F.col("id").cast("decimal(20,2)").alias("d"))
    found = ops.exact_percentile_bounds(df, ["n", "d"], 0.1, 0.9, sketch_size=200, window_rows=50)
    assert [int(v) for v in found.first()] == [base + 199, base + 1799, 199, 1799]


def test_exact_bounds_read_the_rows_four_times(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(300_000).select(F.col("id").cast("double").alias("x")).write.parquet(path)
    reads = []
    df = spark.read.parquet(path)
    counted = percentiles._merged

    def merged(rows, *args, **counts):
        reads.append(1)
        return counted(rows, *args, **counts)

    percentiles._merged = merged
    try:
        ops.exact_percentile_bounds(df, ["x"], sketch_size=1000, window_rows=1000).collect()
    finally:
        percentiles._merged = counted
    assert len(reads) <= 3  # and once more to pick


def test_exact_bounds_of_no_rows(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert ops.exact_percentile_bounds(df, ["x"]).first().asDict() == {
        "x_lower_bound": None,
        "x_upper_bound": None,
    }


def test_approximate_bounds_keep_their_rank_error(spark):
    values = spread("outliers")
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    found = ops.percentile_bounds(df, ["x"], accuracy=200).first()
    ordered = sorted(values)
    for bound, share in (("x_lower_bound", 0.001), ("x_upper_bound", 0.999)):
        rank = ordered.index(found[bound]) + 1
        assert abs(rank - share * len(values)) <= len(values) / 200 + 1


def test_trim_has_no_join(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    bounds = ops.percentile_bounds(df, ["x"], 0.1, 0.9)
    trimmed = ops.trim_outliers(df, bounds, ["x"])
    assert "Join" not in plan_of(trimmed)
    row = bounds.first()
    expected = [float(n) for n in range(1000) if row[0] <= n <= row[1]]
    assert [r["x"] for r in trimmed.orderBy("x").collect()] == expected


# --- trips -------------------------------------------------------------------


def test_trip_edges(spark):
    pickup = "2024-01-01 10:00:00"
    rows = [
        (10.0, 20.0, pickup, "2024-01-01 11:00:00", 1),
        (10.0, 20.0, pickup, pickup, 2),  # no time
        (10.0, 20.0, pickup, "2024-01-01 09:00:00", 3),  # back in time
        (10.0, 20.0, pickup, "2024-01-04 10:00:00", 4),  # 72 hours
        (0.0, 20.0, pickup, "2024-01-01 11:00:00", 5),  # no distance
        (10.0, 0.0, pickup, "2024-01-01 11:00:00", 6),  # no fare
        (10.0, 20.0, "never", "2024-01-01 11:00:00", 7),  # no start
    ]
    raw = spark.createDataFrame(
        rows,
        "trip_distance double, total_amount double, tpep_pickup_datetime string, "
        "tpep_dropoff_datetime string, PULocationID int",
    )
    trips = ops.derive_trips(raw)
    speeds = {r["pickup_loc"]: r["speed"] for r in trips.collect()}
    assert speeds == {1: 10.0, 2: None, 3: -10.0, 4: 0.14, 6: 10.0, 7: None}
    bounds = ops.exact_percentile_bounds(
        trips, ["trip_distance", "speed", "total_amount"], 0.0, 1.0
    )
    kept = ops.trim_trips(trips, bounds)
    assert [r["pickup_loc"] for r in kept.collect()] == [1]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.range(10).selectExpr(
        "id * 1.0D AS trip_distance",
        "id * 2.0D AS total_amount",
        "'2024-01-01 10:00:00' AS tpep_pickup_datetime",
        "'2024-01-01 11:00:00' AS tpep_dropoff_datetime",
        "cast(id AS int) AS PULocationID",
        "id AS unused",
    ).write.parquet(path)
    plan = plan_of(ops.derive_trips(spark.read.parquet(path)))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThan(trip_distance,0.0)" in scan
    assert "unused" not in scan
    totals = ops.curate_trips(ops.summarize_trips(ops.derive_trips(spark.read.parquet(path))))
    # Both aggregates combine before they shuffle.
    assert plan_of(totals).count("partial_count") == 1
    assert plan_of(totals).count("partial_sum(pickup_count") == 1


def test_join_reads_the_columns_it_returns(spark, skewed, tmp_path):
    facts, versions = frames(spark, skewed)
    facts.withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / "facts"))
    df = joined(spark.read.parquet(str(tmp_path / "facts")), versions)
    scan = next(line for line in plan_of(df).splitlines() if "FileScan" in line)
    assert "unused" not in scan


def test_curation_adds_up_the_summary(spark):
    rows = [
        (20.0 + n % 3, 5.0, f"2024-01-01 10:{n % 60:02d}:00", "2024-01-01 12:00:00", n % 2)
        for n in range(120)
    ] + [(1.0, 5.0, "2024-01-01 10:00:00", "2024-01-01 12:00:00", 1)]
    raw = spark.createDataFrame(
        rows,
        "trip_distance double, total_amount double, tpep_pickup_datetime string, "
        "tpep_dropoff_datetime string, PULocationID int",
    )
    summary = ops.summarize_trips(ops.derive_trips(raw))
    totals = ops.curate_trips(summary)
    assert sum(r["pickup_count"] for r in totals.collect()) == 121
    flags = {(r["pickup_loc"], r["long_distance"]): r["pickup_count"] for r in totals.collect()}
    assert flags == {(0, True): 60, (1, True): 60, (1, False): 1}


# --- aggregates --------------------------------------------------------------


def test_revenue_is_sorted_with_unknown_last(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 3.0), (2, 5.0, 4.0), (None, 1.0, None), (1, 1.0, 1.0)],
        "id int, amount double, price double",
    )
    rows = ops.revenue_by(df, ["id"], "amount", "price").collect()
    assert [tuple(r) for r in rows] == [(2, 20.0), (1, 7.0), (None, None)]


def test_first_rows(spark):
    df = spark.range(100)
    rows = ops.first_rows(df, 3, F.desc("id")).collect()
    assert [r["id"] for r in rows] == [99, 98, 97]
    assert ops.first_rows(df, 5).count() == 5


# --- history -----------------------------------------------------------------


def test_latest_row_of_each_key(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (None, 1, "e"), (None, 2, "f")]
    df = spark.createDataFrame(rows, "id int, at int, s string")
    found = {r.id: r.s for r in ops.latest(df, ["id"], ["at"]).collect()}
    assert found[1] in "bc" and (found[2], found[None]) == ("d", "f")
    assert found == {r.id: r.s for r in ops.latest(df.repartition(5), ["id"], ["at"]).collect()}
    assert ops.latest(df.limit(0), ["id"], ["at"]).count() == 0


def test_latest_of_a_hot_key_needs_no_window(spark):
    df = spark.range(1000).selectExpr("IF(id < 900, 0, id) AS k", "id AS at")
    out = ops.latest(df, ["k"], ["at"])
    assert "Window" not in plan_of(out) and "partial_max_by" in plan_of(out)
    assert {r.k: r["at"] for r in out.collect()}[0] == 899


@pytest.mark.parametrize("slot", ["hour", "day", "year"])
def test_versions_follow_each_other(spark, slot):
    rng = random.Random(5)
    rows = [(1 if n % 3 else rng.randrange(2, 9), DAY + timedelta(minutes=rng.randrange(90_000)), n) for n in range(600)]
    rows += [(None, DAY, -1), (1, None, -2), (3, DAY, -3), (3, DAY, -4)]
    df = spark.createDataFrame(rows, "id int, at timestamp, n int")
    found = ops.versions_from_changes(df, "id", "at", order=["n"], slot=slot)
    expected = []
    for key in range(1, 9):
        last = {}
        for k, at, n in rows:
            if k == key and at is not None:
                last[at] = max(n, last.get(at, n))
        times = sorted(last)
        for at, after in zip(times, [*times[1:], datetime(9999, 12, 31)]):
            expected.append((key, last[at], at, after))
    assert sorted(map(tuple, found.select("id", "n", "start_ts", "end_ts").collect())) == sorted(expected)
    facts = spark.createDataFrame([(9, 3, DAY + timedelta(days=2))], "n int, key int, at timestamp")
    versions = found.withColumnsRenamed({"start_ts": "start", "end_ts": "until"}).withColumn("name", F.col("n"))
    assert joined(facts, versions).count() == 1


def test_load_columns_of_a_staging_task(spark, tmp_path):
    from tierflow import Pipeline

    spark.range(3).write.json(str(tmp_path / "in"))
    schema = {"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]}

    def staged(name, wanted):
        source = {"type": "filestore", "format": "json", "path": str(tmp_path / "in"), "read-type": "batch"}
        source["load-metadata"] = wanted
        return {"name": name, "input": source, "schema": schema, "output": {"target": f"stg_{name}", "type": ["file"]}}

    document = {"name": "loads", "staging": [staged("a", True), staged("b", {"id": "process_id"})]}
    run = Pipeline(spark, document, str(tmp_path / "work")).run()
    rows = run.relations["stg_a"].collect()
    assert len({r.load_id for r in rows}) == 1 and all(r.load_time is not None for r in rows)
    assert run.relations["stg_b"].columns == ["id", "load_time", "process_id"]
