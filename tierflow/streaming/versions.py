"""Versions of a key kept up as its changes stream in."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from itertools import islice

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..operators.history import OPEN_END

# Executors need not have this package.
register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Metadata Spark keeps with a column that has a watermark.
WATERMARK = "spark.watermarkDelayMs"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed values, as state lies by them: groups that keys without timers are hashed to, a power of two.
GROUPS = 4096
# Keys of a part of a group, bytes of changes packed together, versions in a row.
PART_KEYS, PACKED_BYTES, PACKED_ROWS = 128, 8 << 20, 10_000


def versions_of_stream(
    changes: DataFrame,
    key: str,
    at: str,
    valid: tuple[str, str] = ("start_ts", "end_ts"),
    order: Sequence[str] = (),
    idle: timedelta | None = None,
    open_end: str = OPEN_END,
) -> DataFrame:
    """Versions ``[start, end)`` of a key as its changes come, for a sink that upserts.

    Each change gives its own version and, anew, the one before it, which it ends.  A
    sink with one row a key and start, where a later row replaces an earlier one, so
    holds what ``versions_from_changes`` makes of all changes, in whatever order and
    batches they came.  Of changes at one instant the last by ``order`` counts; changes
    without a key or a time are left out.

    State is the starts and rows of a key's versions, in RocksDB, those of many keys as
    one value.  With a watermark on ``at`` each is a row of its own: a timer forgets
    versions that ended before it, as no change can come for them any more; Spark drops
    later ones.  With ``idle``, too, a key without a change for so long is forgotten,
    and its last version ends ``idle`` after its start.
    """
    start, end = valid
    timed = WATERMARK in changes.schema[at].metadata
    if idle is not None and not timed:
        raise ValueError(f"idle keys are told by a watermark on {at!r}")
    if not timed and " collate " in changes.select(key).schema[0].dataType.simpleString():
        raise ValueError(f"{key!r} has a collation: texts that differ are one key to Spark, two to Python")
    names = [name for name in changes.columns if name != at]
    known = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    # an instant as a number
    begins = F.unix_micros(F.col(at).cast("timestamp")).alias("__start")
    held = StructType([changes.schema[name] for name in names])
    made = StructType([*held.fields, StructField("__start", LongType()), StructField("__end", LongType())])
    # ends far ahead are no times a Python worker can hold
    spark = changes.sparkSession
    ends = spark.sql(f"SELECT unix_micros(timestamp'{open_end}')").first()[0]
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB} in the pipeline's conf")
    if timed:
        # watermark and timers follow the column itself
        found = known.select(*names, F.col(at), begins).groupBy(key).transformWithState(
            statefulProcessor=_Versions(names, held, list(order), ends, _millis(idle)),
            outputStructType=made,
            outputMode="Update",
            timeMode="EventTime",
        )
    else:
        numbered = _numbered(len(made))
        rows = known.select(*names, begins, F.col(key).alias("__key"), F.xxhash64(key).alias("__hash"))
        lists = StructType([StructField(n, ArrayType(field.dataType)) for n, field in zip(numbered, made)])
        found = rows.mapInArrow(_pack, "__group long, __changes binary").groupBy("__group").transformWithState(
            statefulProcessor=_GroupedVersions(names, held, list(order), ends),
            outputStructType=lists,
            outputMode="Update",
            timeMode="None",
        )
        found = found.select(F.inline(F.arrays_zip(*numbered))).toDF(*made.names)
    kind = dict(changes.dtypes)[at]
    return found.select(
        *names,
        F.timestamp_micros("__start").cast(kind).alias(start),
        F.timestamp_micros("__end").cast(kind).alias(end),
    )


def _millis(length: timedelta | None) -> int | None:
    return None if length is None else length // timedelta(milliseconds=1)


class _Changed(StatefulProcessor):
    """Takes changes into versions of a key, start to row, and gives those that changed."""

    def __init__(self, names, held, order, open_end):
        self.names, self.held, self.order, self.open_end = names, held, order, open_end

    def close(self) -> None:
        pass

    def _take(self, held: dict, touched: set, value: tuple, start: int) -> None:
        if start not in held or self._rank(value) >= self._rank(held[start]):
            held[start] = value
            touched.add(start)

    def _rank(self, value: tuple) -> tuple:
        """Values of the order columns, nulls first."""
        values = [value[self.names.index(name)] for name in self.order]
        return tuple((False,) if v is None else (True, v) for v in values)

    def _given(self, held: dict, touched: set) -> Iterator[tuple[tuple, int, int]]:
        """Versions that began anew or whose end changed."""
        starts = sorted(held)
        for n, start in enumerate(starts):
            following = starts[n + 1] if n + 1 < len(starts) else None
            if start in touched or following in touched:
                yield held[start], start, self.open_end if following is None else following


class _GroupedVersions(_Changed):
    """Versions of a group of keys: calls from and to Spark cost more than a key's few versions.

    Changes come and versions go packed, many a row.  A group's state is cut into parts
    by the hash of the key, each one value.  A batch reads and writes the parts it
    touches; when one has many keys, the group is cut into more parts.
    """

    def __init__(self, names, held, order, open_end):
        super().__init__(names, held, order, open_end)
        self.columns = Row(*_numbered(len(names) + 2))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", StructType([StructField("depth", IntegerType())]))
        part = StructType([StructField("part", IntegerType())])
        # the row is never filled: by it Spark refuses to go on with other columns
        held = StructType([StructField("versions", BinaryType()), StructField("row", self.held)])
        self.parts = handle.getMapState("parts", part, held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        depth = (self.depth.get() or (0,))[0]
        parts, touched = {}, {}
        for row in rows:
            for hashed, same, start, value in pickle.loads(row["__changes"]):
                part = _part(hashed, depth)
                if part not in parts:
                    parts[part] = self._part_held(part)
                if same not in parts[part]:
                    parts[part][same] = hashed, {}
                if same not in touched:
                    touched[same] = parts[part][same][1], set()
                self._take(*touched[same], value, start)
        if any(len(held) > PART_KEYS for held in parts.values()):
            parts = self._cut(parts, depth)
        for part, held in parts.items():
            self.parts.updateValue((part,), (pickle.dumps(held), None))
        given = (each for held, starts in touched.values() for each in self._given(held, starts))
        while some := list(islice(given, PACKED_ROWS)):
            yield self.columns(*map(list, zip(*((*value, start, end) for value, start, end in some))))

    def _cut(self, parts: dict, depth: int) -> dict:
        """All of the group's parts, dealt anew to so many that each has few keys."""
        cut, every = {part: {} for part in range(1 << depth)}, {}
        for part in cut:
            every |= parts[part] if part in parts else self._part_held(part)
        while len(every) > PART_KEYS // 2 << depth:
            depth += 1
        self.depth.update((depth,))
        for same, (hashed, versions) in every.items():
            cut.setdefault(_part(hashed, depth), {})[same] = hashed, versions
        return cut

    def _part_held(self, part: int) -> dict:
        """The versions of each key of a part, and the key's hash."""
        value = self.parts.getValue((part,))
        return {} if value is None else pickle.loads(value[0])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes by the group of their key, those of a group that come together in one row."""
    groups, size = {}, 0
    for batch in batches:
        *values, starts, keys, hashes = map(_values, batch.columns)
        for hashed, key, start, value in zip(hashes, keys, starts, zip(*values)):
            groups.setdefault(hashed % GROUPS, []).append((hashed, _same(key), start, value))
        size += batch.nbytes
        if size > PACKED_BYTES:
            yield _packed(groups)
            groups, size = {}, 0
    yield _packed(groups)


def _packed(groups: dict[int, list]) -> pa.RecordBatch:
    changes = [pickle.dumps(some) for some in groups.values()]
    columns = [pa.array(list(groups), pa.int64()), pa.array(changes, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["__group", "__changes"])


def _values(column: pa.Array) -> list:
    """What ``to_pylist`` gives, but at once for plain numbers."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if plain and not column.null_count else column.to_pylist()


def _part(hashed: int, depth: int) -> int:
    """The part of a group: bits of the key's hash that did not choose the group."""
    return hashed // GROUPS & (1 << depth) - 1


def _same(key):
    """A key as a value that equals those Spark groups with it."""
    if isinstance(key, dict):
        return tuple(map(_same, key.values()))
    if isinstance(key, list):
        return tuple(map(_same, key))
    if isinstance(key, datetime):
        return key, key.fold
    return key if key == key else "NaN"


def _numbered(n: int) -> list[str]:
    return [f"__{i}" for i in range(n)]


class _Versions(_Changed):
    """Versions of one key, each a state row of its own, which a timer forgets."""

    def __init__(self, names, held, order, open_end, idle):
        super().__init__(names, held, order, open_end)
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        start = StructType([StructField("start", LongType())])
        self.versions = handle.getMapState("versions", start, self.held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, touched = self._versions_held(), set()
        for row in rows:
            self._take(held, touched, tuple(row[name] for name in self.names), row["__start"])
        for start in touched:
            self.versions.updateValue((start,), held[start])
        yield from (self._version(*given) for given in self._given(held, touched))
        self._set_timer(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._versions_held(), timerValues.getCurrentWatermarkInMs() * 1000
        starts = sorted(held)
        for start, end in zip(starts, starts[1:]):
            if end <= now:
                self.versions.removeKey((start,))
                del held[start]
        last = starts[-1]
        if self.idle is not None and last + self.idle * 1000 <= now:
            self.versions.clear()
            yield self._version(held[last], last, last + self.idle * 1000)
        else:
            self._set_timer(held)

    def _version(self, value: tuple, start: int, end: int) -> Row:
        return Row(*self.names, "__start", "__end")(*value, start, end)

    def _versions_held(self) -> dict[int, tuple]:
        return {start[0]: tuple(value) for start, value in self.versions.iterator()}

    def _set_timer(self, held: dict) -> None:
        """One timer a key: when its second version begins, or when the only one is idle."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(held) > 1:
            self.handle.registerTimer(sorted(held)[1] // 1000 + 1)
        elif self.idle is not None:
            self.handle.registerTimer(max(held) // 1000 + 1 + self.idle)
