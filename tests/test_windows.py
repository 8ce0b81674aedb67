"""Event-time windows: each row is counted in its windows or kept as late, whatever fails."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from tierflow.spec import SpecError
from tierflow.streaming import EventWindows

SCHEMA, START = "g string, at timestamp, v int", datetime(2024, 1, 1)
MEASURES = {"n": ("sum", "1L"), "low": ("min", "v"), "high": ("max", "v")}
HOUR = timedelta(hours=1)


def batches_of(seed, count=5, rows=60):
    rng = random.Random(seed)
    out = []
    for batch in range(count):
        hours = [3 * batch + rng.random() * 6 - (rng.random() < 0.2) * 9 for _ in range(rows)]
        out.append([(rng.choice("aab"), rng.choice([None] + [START + HOUR * h] * 15), rng.randint(0, 99)) for h in hours])
    return out


def by_brute(batches, size, slide, delay):
    """Windows by (start, key) that closed, and what came late, by the watermark of the batches before."""
    counts, late, ended, latest = {}, Counter(), None, None
    for rows in batches:
        for g, at, v in rows:
            if at is None:
                late[(g, at, v, None)] += 1
                continue
            start = START + (at - START) // slide * slide
            while start + size > at:
                if ended is not None and start + size <= ended:
                    late[(g, at, v, start)] += 1
                else:
                    counts.setdefault((start, g), []).append(v)
                start -= slide
        times = [at for _, at, _ in rows if at is not None] + ([latest] if latest else [])
        latest = max(times, default=None)
        ended = latest and latest - delay
    closed = {(s, s + size, g): (len(v), min(v), max(v)) for (s, g), v in counts.items() if s + size <= ended}
    return closed, late


def result(windows):
    closed = [((r.window_start, r.window_end, r.g), (r.n, r.low, r.high)) for r in windows.closed().collect()]
    assert len(closed) == len(dict(closed))
    return dict(closed), Counter((r.g, r["at"], r.v, r.window_start) for r in windows.late().collect())


@pytest.mark.parametrize("slide", [None, 2 * HOUR])
def test_equals_brute_force(spark, work, slide):
    batches, delay = batches_of(1), HOUR
    windows = EventWindows(spark, work, "at", MEASURES, 4 * HOUR, slide, delay, ["g"], buckets=4)
    for number, rows in enumerate(batches):
        windows.take(spark.createDataFrame(rows, SCHEMA), number)
    closed, late = by_brute(batches, 4 * HOUR, slide or 4 * HOUR, delay)
    assert result(windows) == (closed, late)
    assert closed and late
    if slide is None:
        held = sum(r.n for r in windows.still_open().collect())
        assert sum(n for n, _, _ in closed.values()) + late.total() + held == sum(map(len, batches))


@pytest.mark.parametrize("step", ["_write", "_note", "drop_where"])
def test_a_batch_that_fails_midway_is_taken_again(spark, work, monkeypatch, step):
    batches = batches_of(2, count=3)
    windows = EventWindows(spark, work, "at", MEASURES, 4 * HOUR, None, HOUR, ["g"], buckets=4)
    where = windows.open if step == "drop_where" else windows
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        monkeypatch.setattr(where, step, lambda *args: 1 / 0)
        try:
            windows.take(df, number)
        except ZeroDivisionError:
            pass
        monkeypatch.undo()
        windows.take(df, number)
        windows.take(df, number)
    assert result(windows) == by_brute(batches, 4 * HOUR, 4 * HOUR, HOUR)


def test_only_buckets_of_changing_windows_are_written(spark, work):
    windows = EventWindows(spark, work, "at", MEASURES, HOUR, None, 900 * HOUR, ["g"], buckets=32)
    rows = [("a", START + HOUR * n, n) for n in range(200)]
    windows.take(spark.createDataFrame(rows, SCHEMA), 0)
    before = windows.open.current()["folders"]
    windows.take(spark.createDataFrame([("a", START, 5), ("b", START, 7)], SCHEMA), 1)
    after = windows.open.current()["folders"]
    assert len(before) > 20 and sum(before[b] != after[b] for b in before) == 1


def test_refusals(spark, work):
    with pytest.raises(SpecError, match="slide"):
        EventWindows(spark, work, "at", MEASURES, HOUR, 2 * HOUR)
    with pytest.raises(SpecError, match="folds"):
        EventWindows(spark, work, "at", {"n": ("avg", "v")}, HOUR)
