"""Event-time windows of a stream, whose late rows are kept instead of lost."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import FOLDS
from ..sinks.keyed import BUCKETS, KeyedFiles
from ..spec import SpecError
from ..workspace import names_in, read_text, write_text

# Names below the folder, and columns windows add.
OPEN, CLOSED, LATE, MARKS, CHECKPOINT = "open", "closed", "late", "marks", "checkpoint"
WINDOW = ("window_start", "window_end")


class EventWindows:
    """Tumbling or sliding windows over the event time of a stream, closed once each.

    A row counts in every window of ``size`` that holds its time ``at``, one every
    ``slide`` (every ``size`` if not given), per ``keys``.  ``measures`` names results:
    a fold (sum, min or max) and the column or expression folded.

    The watermark is the latest time of the micro-batches before, less ``delay``.  A
    window that ends at or before it is closed: it is added to ``closed()`` and takes
    no more rows.  A row that comes for a closed window goes to ``late()`` with that
    window, a row without a time goes there without one: every row is counted in
    each of its windows or kept with it.

    Each micro-batch is folded by built-in aggregates and then into the open windows,
    kept as files with one row a window and key; only the buckets of windows that
    rows came for, or that close, are written.  What a micro-batch does is noted under
    its number, step by step, so that one run again after a failure changes nothing.
    The batch is read twice, for the fold and for its late rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        at: str,
        measures: Mapping[str, tuple[str, Column | str]],
        size: timedelta,
        slide: timedelta | None = None,
        delay: timedelta = timedelta(0),
        keys: Sequence[str] = (),
        buckets: int = BUCKETS,
        files: int = 1,
    ):
        if slide is not None and not timedelta(0) < slide <= size:
            raise SpecError(f"windows of {size} cannot slide by {slide}")
        unknown = sorted({fold for fold, _ in measures.values()} - set(FOLDS))
        if unknown:
            raise SpecError(f"unknown folds {unknown}, expected some of {sorted(FOLDS)}")
        self.spark, self.base, self.at, self.measures = spark, base.rstrip("/"), at, dict(measures)
        self.size, self.slide, self.delay, self.keys = size, slide, delay, list(keys)
        self.open = KeyedFiles(
            spark, f"{self.base}/{OPEN}", [*WINDOW, *keys], buckets, files=files, by=WINDOW[:1]
        )

    def start(self, rows: DataFrame, trigger: Mapping[str, Any]) -> StreamingQuery:
        """The query that fills the windows from a stream."""
        writer = rows.writeStream.foreachBatch(self.take).trigger(**trigger)
        return writer.option("checkpointLocation", f"{self.base}/{CHECKPOINT}").start()

    def closed(self) -> DataFrame:
        """Windows that take no more rows: start, end, keys and measures."""
        return self._read(CLOSED)

    def late(self) -> DataFrame:
        """Rows that came too late, with the window they missed."""
        return self._read(LATE)

    def still_open(self) -> DataFrame:
        """Windows that may still take rows, as they are now."""
        return self.open.read()

    def take(self, batch: DataFrame, number: int) -> None:
        """Count one micro-batch, numbered from 0."""
        before = self._mark(number - 1)
        ended = None if before is None else before - self._micros(self.delay)
        seen = Observation()
        timed = F.unix_micros(F.col(self.at).cast("timestamp"))
        paired = self._paired(batch.observe(seen, F.max(timed).alias("latest")))
        in_time = F.lit(True) if ended is None else F.unix_micros(WINDOW[1]) > ended
        if self.open.fold(self._measured(paired.where(in_time)), self._folds(), "rows", number):
            latest = seen.get["latest"]
        else:
            latest = batch.agg(F.max(timed)).first()[0]
        missed = batch.withColumns({name: F.lit(None).cast("timestamp") for name in WINDOW})
        missed = missed.where(F.col(self.at).isNull())
        if ended is not None:
            missed = missed.unionByName(self._paired(batch).where(~in_time))
        self._write(missed, LATE, number)
        after = max((m for m in (before, latest) if m is not None), default=None)
        self._note(number, after)
        if after is not None and self.open.current()["writers"].get("closing", -1) < number:
            over = F.unix_micros(WINDOW[1]) <= after - self._micros(self.delay)
            self._write(self.open.read().where(over), CLOSED, number)
            self.open.drop_where(over, "closing", number)

    def _paired(self, rows: DataFrame) -> DataFrame:
        """Each row with each of its windows; a row without a time has none."""
        size, slide = self._micros(self.size), self._micros(self.slide or self.size)
        time = F.unix_micros(F.col(self.at).cast("timestamp"))
        # starts are multiples of the slide, the last one at or before the time
        first = (F.floor((time - size) / F.lit(slide)) + 1) * slide
        starts = F.sequence(first, F.floor(time / F.lit(slide)) * slide, F.lit(slide).cast("bigint"))
        paired = rows.withColumn("__start", F.explode(starts))
        bounds = (F.col("__start"), F.col("__start") + size)
        return paired.withColumns({n: F.timestamp_micros(b) for n, b in zip(WINDOW, bounds)}).drop("__start")

    def _measured(self, paired: DataFrame) -> DataFrame:
        values = [F.expr(v) if isinstance(v, str) else v for _, v in self.measures.values()]
        return paired.select(*WINDOW, *self.keys, *[v.alias(n) for n, v in zip(self.measures, values)])

    def _folds(self) -> dict[str, str]:
        return {name: fold for name, (fold, _) in self.measures.items()}

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{kind}/batch={number:012d}")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{kind}").drop("batch")

    def _note(self, number: int, latest: int | None) -> None:
        write_text(self.spark, f"{self.base}/{MARKS}/{number:012d}", json.dumps(latest))

    def _mark(self, number: int) -> int | None:
        """The latest time of all micro-batches up to one."""
        if f"{number:012d}" not in names_in(self.spark, f"{self.base}/{MARKS}"):
            return None
        return json.loads(read_text(self.spark, f"{self.base}/{MARKS}/{number:012d}"))

    @staticmethod
    def _micros(length: timedelta) -> int:
        return length // timedelta(microseconds=1)
