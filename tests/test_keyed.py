"""Files with one row a key: loads, buckets left alone, repeats, failures, documents."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tierflow import Pipeline
from tierflow.sinks.keyed import KeyedFiles
from tierflow.spec import SpecError

SCHEMA = "k int, at int, v string"


def files_by_bucket(spark, keyed):
    rows = keyed.read().select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    return {r.f.rsplit("__bucket=", 1)[1].split("/")[0]: r.f for r in rows}


def test_the_last_row_of_each_key_stays(spark, work):
    rng = random.Random(3)
    keyed, held = KeyedFiles(spark, f"{work}/k", ["k"], buckets=8, files=2), {}
    for load in range(4):
        rows = [(rng.choice([*range(50), None]), rng.randint(0, 9), f"{load}-{n}") for n in range(80)]
        rows = list({(k, at): (k, at, v) for k, at, v in rows}.values())
        assert keyed.upsert(spark.createDataFrame(rows, SCHEMA), ["at"])
        for k, at, v in rows:
            if k not in held or at >= held[k][1]:
                held[k] = (k, at, v)
        assert sorted(map(tuple, keyed.read().collect()), key=str) == sorted(held.values(), key=str)


def test_only_touched_buckets_are_written(spark, work):
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=16)
    keyed.upsert(spark.range(500).selectExpr("CAST(id AS int) AS k", "0 AS at", "'a' AS v"))
    before = files_by_bucket(spark, keyed)
    keyed.upsert(spark.createDataFrame([(7, 1, "b")], SCHEMA))
    after = files_by_bucket(spark, keyed)
    changed = {b for b in before if before[b] != after[b]}
    assert len(before) == 16 and len(changed) == 1
    assert keyed.read().where("v = 'b'").collect() == [(7, 1, "b")] and keyed.read().count() == 500


def test_deleted_keys_go(spark, work):
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=4)
    schema = "k int, at int, gone boolean"
    keyed.upsert(spark.createDataFrame([(1, 0, False), (2, 0, None)], schema), ["at"], deleted="gone")
    keyed.upsert(spark.createDataFrame([(1, 1, True), (3, 1, True)], schema), ["at"], deleted="gone")
    assert [r.k for r in keyed.read().collect()] == [2]


def test_folds_equal_one_aggregate(spark, work):
    rng = random.Random(5)
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=4)
    folds = {"n": "sum", "low": "min", "high": "max"}
    every = []
    for _ in range(3):
        rows = [(rng.choice([0, 0, 0, rng.randint(1, 20), None]), 1, v, v) for v in rng.choices(range(1000), k=200)]
        every += rows
        keyed.fold(spark.createDataFrame(rows, "k int, n bigint, low int, high int"), folds)
    times = Counter(k for k, *_ in every)
    expected = {k: (n, min(v for x, _, v, _ in every if x == k), max(v for x, _, v, _ in every if x == k)) for k, n in times.items()}
    assert {r.k: (r.n, r.low, r.high) for r in keyed.read().collect()} == expected


def test_a_batch_counts_once(spark, work):
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=4)
    rows = spark.createDataFrame([(1, 5)], "k int, n bigint")
    assert keyed.fold(rows, {"n": "sum"}, writer="a", batch=0)
    assert not keyed.fold(rows, {"n": "sum"}, writer="a", batch=0)
    assert keyed.fold(rows, {"n": "sum"}, writer="b", batch=0)
    assert keyed.read().collect() == [(1, 10)]


def test_a_failed_change_leaves_what_was_there(spark, work, monkeypatch):
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=4)
    keyed.upsert(spark.createDataFrame([(1, 0, "a")], SCHEMA))
    reader = keyed.read()
    monkeypatch.setattr(keyed, "_switch", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        keyed.upsert(spark.createDataFrame([(1, 1, "b"), (2, 1, "b")], SCHEMA))
    monkeypatch.undo()
    assert keyed.read().collect() == [(1, 0, "a")]
    keyed.upsert(spark.createDataFrame([(1, 2, "c")], SCHEMA))
    # what was read before the last change is still there
    assert reader.collect() == [(1, 0, "a")] and keyed.read().collect() == [(1, 2, "c")]
    for n in range(3, 6):
        keyed.upsert(spark.createDataFrame([(1, n, "d")], SCHEMA))
    assert keyed.current()["number"] == 4 and keyed.read().collect() == [(1, 5, "d")]


def test_refusals(spark, work):
    keyed = KeyedFiles(spark, f"{work}/k", ["k"], buckets=4)
    with pytest.raises(SpecError, match="nothing yet"):
        keyed.read()
    keyed.upsert(spark.createDataFrame([(1, 0, "a")], SCHEMA))
    with pytest.raises(SpecError, match="holds struct"):
        keyed.upsert(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(SpecError, match="buckets"):
        KeyedFiles(spark, f"{work}/k", ["k"], buckets=5).upsert(spark.createDataFrame([(1, 0, "a")], SCHEMA))
    with pytest.raises(SpecError, match="fold"):
        keyed.fold(spark.createDataFrame([(1, 0, "a")], SCHEMA), {"at": "sum", "v": "first"})
    keyed.upsert(spark.createDataFrame([], SCHEMA))
    assert keyed.read().count() == 1


def task(work, mode, **output):
    return {
        "name": "t",
        "code": lambda spark: spark.createDataFrame([(1, 1, "x")], SCHEMA),
        "output": {"target": "std_t", "type": ["file", "view"], "mode": mode, **output},
    }


def test_documents_name_keys_and_folds(spark, work):
    flow = Pipeline(spark, {"name": "keyed", "standard": [task(work, "upsert", keys=["k"], order=["at"])]}, working_dir=work)
    flow.run()
    flow.run()
    assert flow.output("standard", "t").collect() == [(1, 1, "x")]
    for bad in ({}, {"keys": ["k"], "type": ["table", "file"]}):
        with pytest.raises(SpecError, match="needs 'keys'"):
            Pipeline(spark, {"name": "keyed", "standard": [task(work, "upsert", **bad)]})
    with pytest.raises(SpecError, match="folded"):
        Pipeline(spark, {"name": "keyed", "standard": [task(work, "merge", keys=["k"])]})


def test_a_stream_writes_as_its_groups_change(spark, work):
    """Buckets of groups that a micro-batch does not touch keep their files."""
    schema = spark.createDataFrame([], "k int, n bigint").schema
    source = {"type": "filestore", "format": "parquet", "path": f"{work}/in", "read-type": "streaming"}
    document = {
        "name": "merged",
        "staging": [{"name": "in", "input": source, "schema": schema.jsonValue(), "output": {"target": "stg_in", "type": ["view"]}}],
        "serving": [
            {
                "name": "sum",
                "type": "streaming",
                "code": {"lang": "sql", "sql": "SELECT k, n FROM stg_in"},
                "output": {"target": "srv_sum", "type": ["file"], "mode": "merge", "keys": ["k"], "merge": {"n": "sum"}, "buckets": 8},
            }
        ],
    }
    flow = Pipeline(spark, document, working_dir=work)
    spark.range(100).selectExpr("CAST(id AS int) AS k", "1L AS n").write.parquet(f"{work}/in")
    flow.run()
    keyed = KeyedFiles(spark, flow.workspace.data_path("serving", "srv_sum"), ["k"], 8)
    before = files_by_bucket(spark, keyed)
    spark.createDataFrame([(3, 5)], schema).write.mode("append").parquet(f"{work}/in")
    flow.run()
    flow.run()
    after = files_by_bucket(spark, keyed)
    assert sum(before[b] != after[b] for b in before) == 1
    held = {r.k: r.n for r in flow.output("serving", "sum").collect()}
    assert held == {k: 6 if k == 3 else 1 for k in range(100)}
