"""Versions kept by a stream equal those made of all changes, however they are split."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tierflow.operators import versions_from_changes
from tierflow.sinks.keyed import KeyedFiles
from tierflow.streaming import versions, versions_of_stream
from tierflow.streaming.versions import ROCKSDB, STATE_STORE

SCHEMA, START = "k int, n int, v string, at timestamp", datetime(2024, 1, 1)
DAY = timedelta(days=1)


@pytest.fixture
def rocks(spark):
    spark.conf.set(STATE_STORE, ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def changes_of(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3, None]), i, f"v{i}", START + timedelta(hours=rng.randint(0, 60))) for i in range(n)]
    return rows + [(1, n, "no time", None)]


def run(spark, work, parts, mark=None, **options):
    """Each part a micro-batch of a run of its own, then a run without any; the sink's rows."""
    keyed, states = KeyedFiles(spark, f"{work}/sink", ["k", "start_ts"], buckets=4), []

    def take(batch, number):
        keyed.upsert(batch, writer="s", batch=number)

    for part in [*parts, []]:
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{work}/in")
        stream = stream.withWatermark("at", mark) if mark else stream
        found = versions_of_stream(stream, "k", "at", order=["n"], **options)
        writer = found.writeStream.outputMode("update").foreachBatch(take)
        query = writer.option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        states += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return sorted(map(tuple, keyed.read().collect()), key=str), states


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_all_changes_at_once(rocks, work, seed):
    changes = changes_of(seed)
    expected = versions_from_changes(rocks.createDataFrame(changes, SCHEMA), "k", "at", order=["n"])
    random.Random(seed).shuffle(changes)
    parts = [changes[:20], changes[20:90], changes[90:]]
    got, _ = run(rocks, work, parts)
    assert got == sorted(map(tuple, expected.collect()), key=str)
    assert len(got) > 40


def test_what_the_watermark_has_passed_is_forgotten(rocks, work):
    changes = sorted((c for c in changes_of(3) if None not in c), key=lambda c: c[3])
    later = [(9, 1000, "late", START + 30 * DAY)]
    got, states = run(rocks, work, [changes[:60], changes[60:], later], mark="1 hour")
    expected = versions_from_changes(rocks.createDataFrame(changes + later, SCHEMA), "k", "at", order=["n"])
    assert got == sorted(map(tuple, expected.collect()), key=str)
    # one version a key is left, and its timer
    assert states[-1] < max(states) / 3


def test_idle_keys_end(rocks, work):
    changes = [(1, 0, "a", START), (1, 1, "b", START + DAY), (2, 2, "c", START + 8 * DAY)]
    later = [(3, 3, "d", START + 12 * DAY)]
    got, _ = run(rocks, work, [changes, later, [(3, 4, "e", START + 13 * DAY)]], mark="0 seconds", idle=7 * DAY)
    ends = {(k, n): end for k, n, _, _, end in got}
    assert ends[1, 0] == START + DAY and ends[1, 1] == START + 8 * DAY
    assert ends[2, 2].year == 9999 and ends[3, 3] == START + 13 * DAY


def test_refusals(spark, work):
    spark.createDataFrame([(1, 0, "a", START)], SCHEMA).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{work}/in")
    with pytest.raises(ValueError, match="providerClass"):
        versions_of_stream(stream, "k", "at")
    with pytest.raises(ValueError, match="watermark"):
        versions_of_stream(stream, "k", "at", idle=DAY)


def test_many_keys_share_a_state_row(rocks, work, monkeypatch):
    """Calls and state rows grow with groups and their parts, not with keys or versions."""
    monkeypatch.setattr(versions, "GROUPS", 4)
    rng = random.Random(4)
    changes = [(rng.randint(0, 999), i, f"v{i}", START + timedelta(hours=rng.randint(0, 60))) for i in range(4000)]
    expected = versions_from_changes(rocks.createDataFrame(changes, SCHEMA), "k", "at", order=["n"])
    # some keys of a group, so many that it is cut, then changes of few keys, and a part that is empty till then
    parts = [changes[:300], changes[300:3000], changes[3000:3010], changes[3010:]]
    got, states = run(rocks, work, parts)
    assert got == sorted(map(tuple, expected.collect()), key=str)
    keys, most = len({c[0] for c in changes}), max(states)
    # at least two parts a group, and its number of them
    assert 12 <= most < keys / 10 < len(got) / 10


def test_small_packages_and_parts_give_the_same(rocks, work, monkeypatch):
    for limit in ("GROUPS", "PACKED_BYTES", "PACKED_ROWS", "PART_KEYS"):
        monkeypatch.setattr(versions, limit, 2)
    changes = changes_of(5)
    expected = versions_from_changes(rocks.createDataFrame(changes, SCHEMA), "k", "at", order=["n"])
    got, _ = run(rocks, work, [changes[:50], changes[50:]])
    assert got == sorted(map(tuple, expected.collect()), key=str)


def stored(spark, work, rows, schema, order=("n",)):
    """What a sink holds after a run over each of the rows' folders."""
    keyed = KeyedFiles(spark, f"{work}/sink", ["k", "start_ts"], buckets=2)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{work}/in")
        found = versions_of_stream(spark.readStream.schema(schema).parquet(f"{work}/in"), "k", "at", order=order)
        writer = found.writeStream.outputMode("update").foreachBatch(lambda batch, n: keyed.upsert(batch, writer="s", batch=n) and None)
        writer.option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(str, keyed.read().collect()))


NAN = float("nan")


@pytest.mark.parametrize(
    ("kind", "keys"),
    [
        ("double", [NAN, 0.0, -0.0, -1.5]),
        ("struct<a: array<int>, b: string>", [([1, None], None), ([], "x"), (None, None)]),
    ],
)
def test_keys_are_the_ones_spark_groups_by(rocks, work, kind, keys):
    schema = f"k {kind}, n bigint, m map<string, bigint>, d decimal(38, 9), at timestamp"
    rng = random.Random(6)
    rows = [(rng.choice(keys), rng.choice([None, 2**62 + i]), {"a": i}, None, START + i * DAY) for i in range(30)]
    expected = versions_from_changes(rocks.createDataFrame(rows, schema), "k", "at", order=["n"])
    assert stored(rocks, work, [rows[:10], rows[10:]], schema) == sorted(map(str, expected.collect()))


def test_of_changes_that_tie_the_later_counts(rocks, work):
    got = stored(rocks, work, [[(1, n, text, START)] for n, text in enumerate(["first", "second"])], SCHEMA, order=())
    assert len(got) == 1 and "second" in got[0]


def test_state_of_other_columns_is_refused(rocks, work):
    stored(rocks, work, [[(1, 0, "a", START)]], SCHEMA)
    rocks.createDataFrame([(1, 1, "b", START)], SCHEMA).write.mode("append").parquet(f"{work}/in")
    other = rocks.readStream.schema(SCHEMA).parquet(f"{work}/in").withColumn("v", F.length("v"))
    found = versions_of_stream(other, "k", "at", order=["n"])
    query = found.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.collect() and None)
    with pytest.raises(Exception, match="(?i)schema"):
        query.option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start().awaitTermination()


def test_a_collated_key_is_refused(rocks, work):
    rocks.sql("SELECT 'a' COLLATE UTF8_LCASE AS k, timestamp'2024-01-01' AS at").write.parquet(f"{work}/in")
    stream = rocks.readStream.schema("k string collate UTF8_LCASE, at timestamp").parquet(f"{work}/in")
    with pytest.raises(ValueError, match="collation"):
        versions_of_stream(stream, "k", "at")
