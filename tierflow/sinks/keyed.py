"""Files with one row a key, changed bucket by bucket.

Keys are hashed to a fixed number of buckets, each a folder of its own.  A change
reads and writes the buckets it touches; the others stay the files they were.  A
manifest says which folder holds each bucket.  New folders are filled first, then
a marker names the next manifest, so readers see all of a change or none of it, and
a run that fails leaves what was there.  The manifest before the current one and
its folders are kept for readers that began before.  One run at a time writes.

A manifest also notes the last batch of each writer, so that a micro-batch that is
run again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.folds import FOLDS
from ..operators.history import latest
from ..spec import SpecError
from ..workspace import delete_path, names_in, read_text, write_text

BUCKETS = 64
# Names below the folder.
DATA, INCOMING, MANIFESTS, MARKERS = "data", "incoming", "_manifests", "_current"
BUCKET, PART, NEW = "__bucket", "__part", "__new"


class KeyedFiles:
    """One row a key below ``base``; buckets and keys are fixed by the first change.

    A bucket is written by ``files`` tasks: choose buckets and files so that a
    share of the whole fits a task.  ``by`` names some of the keys, where only these
    are to choose the bucket, so that keys which change together lie together.
    Null is a key like any other.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        keys: Sequence[str],
        buckets: int = BUCKETS,
        format: str = "parquet",
        files: int = 1,
        by: Sequence[str] = (),
    ):
        self.spark, self.base, self.keys = spark, base.rstrip("/"), list(keys)
        self.buckets, self.format, self.files = buckets, format, files
        self.by = list(by) or self.keys

    def upsert(
        self,
        rows: DataFrame,
        order: Sequence[str] = (),
        deleted: str | None = None,
        writer: str | None = None,
        batch: int | None = None,
    ) -> bool:
        """Keep the row of each key that is last by ``order``, the new one where they tie.

        Where ``deleted``, a boolean column, is true for that row, the key goes.
        Returns whether anything was done: a batch done before is not done again.
        """

        def combine(every: DataFrame, within: list[str]) -> DataFrame:
            kept = latest(every, [*within, *self.keys], [*order, NEW])
            return kept.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else kept

        return self._change(rows, lambda new: latest(new, self.keys, order), combine, writer, batch)

    def fold(
        self, rows: DataFrame, folds: Mapping[str, str], writer: str | None = None, batch: int | None = None
    ) -> bool:
        """Add rows to the totals held: ``folds`` names sum, min, max or union for every other column."""
        unknown = {name: fold for name, fold in folds.items() if fold not in FOLDS}
        if unknown or set(folds) != set(rows.columns) - set(self.keys):
            raise SpecError(f"columns {rows.columns} need a fold of {sorted(FOLDS)} each, besides keys {self.keys}")

        def folded(every: DataFrame, within: Sequence[str] = ()) -> DataFrame:
            sums = [FOLDS[fold](name).cast(rows.schema[name].dataType).alias(name) for name, fold in folds.items()]
            return every.groupBy(*within, *self.keys).agg(*sums)

        return self._change(rows, folded, folded, writer, batch)

    def drop_where(self, condition: Column, writer: str | None = None, batch: int | None = None) -> bool:
        """Let go of the keys whose rows meet a condition; only their buckets are written."""
        if not self.current()["folders"]:
            return False
        gone = self.read().where(condition)

        def combine(every: DataFrame, within: list[str]) -> DataFrame:
            return every.where(~F.col(NEW) & ~F.coalesce(condition, F.lit(False)))

        return self._change(gone, lambda new: new, combine, writer, batch)

    def read(self) -> DataFrame:
        """The rows held now."""
        return self._read(self.current(), None)

    def current(self) -> dict:
        """The manifest in force: folders by bucket, the columns, the last batch of each writer."""
        marks = names_in(self.spark, f"{self.base}/{MARKERS}")
        if not marks:
            return {"number": -1, "folders": {}, "schema": None, "writers": {}, "buckets": self.buckets, "keys": self.keys}
        return json.loads(read_text(self.spark, f"{self.base}/{MANIFESTS}/{marks[-1]}"))

    # --- one change -----------------------------------------------------------

    def _change(self, rows, reduce, combine, writer, batch) -> bool:
        before = self.current()
        if writer is not None and before["writers"].get(writer, -1) >= batch:
            return False
        if (before["buckets"], before["keys"]) != (self.buckets, self.keys):
            raise SpecError(f"{self.base} has {before['buckets']} buckets by {before['keys']}")
        schema = before["schema"] and StructType.fromJson(before["schema"])
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in rows.schema]:
            raise SpecError(f"{self.base} holds {schema.simpleString()}, not {rows.schema.simpleString()}")
        version = uuid.uuid4().hex
        # what comes is computed once, and reduced to a row a key
        incoming = f"{self.base}/{INCOMING}/{version}"
        self._write(self._dealt(reduce(rows)), incoming)
        touched = _bucket_folders(self.spark, incoming)
        new = self._load([f"{incoming}/{name}" for name in touched.values()], rows.schema)
        if touched:
            every = new.withColumn(NEW, F.lit(True))
            if any(bucket in before["folders"] for bucket in touched):
                every = every.unionByName(self._read(before, touched).withColumn(NEW, F.lit(False)))
            # dealt by bucket first, so grouping by key needs no shuffle of its own
            changed = combine(self._dealt(every), [BUCKET, PART])
            self._write(changed, f"{self.base}/{DATA}/{version}")
        written = _bucket_folders(self.spark, f"{self.base}/{DATA}/{version}")
        folders = {b: folder for b, folder in before["folders"].items() if b not in touched}
        folders |= {b: f"{version}/{name}" for b, name in written.items()}
        self._switch(
            {
                "number": before["number"] + 1,
                "folders": folders,
                "schema": json.loads(rows.schema.json()),
                "writers": before["writers"] | ({writer: batch} if writer is not None else {}),
                "buckets": self.buckets,
                "keys": self.keys,
            }
        )
        delete_path(self.spark, incoming)
        return True

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by the bucket of their key, and the file within it."""
        spread = F.xxhash64(*self.keys, F.lit(1))
        marked = rows.withColumns(
            {
                BUCKET: F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"),
                PART: F.pmod(spread, F.lit(self.files)).cast("int"),
            }
        )
        return marked.repartition(self._tasks(), BUCKET, PART)

    def _tasks(self) -> int:
        return min(self.buckets * self.files, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.drop(PART, NEW).write.format(self.format).partitionBy(BUCKET).save(path)

    def _read(self, manifest: dict, only) -> DataFrame:
        if manifest["schema"] is None:
            raise SpecError(f"{self.base} holds nothing yet")
        folders = [f for b, f in manifest["folders"].items() if only is None or b in only]
        return self._load([f"{self.base}/{DATA}/{f}" for f in folders], StructType.fromJson(manifest["schema"]))

    def _load(self, paths: Sequence[str], schema: StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.format).schema(schema).load(list(paths))

    def _switch(self, manifest: dict) -> None:
        """Put a manifest in force; let go of what the one before the last alone named."""
        marks = names_in(self.spark, f"{self.base}/{MARKERS}")
        name = f"{manifest['number']:012d}-{uuid.uuid4().hex}"
        write_text(self.spark, f"{self.base}/{MANIFESTS}/{name}", json.dumps(manifest))
        write_text(self.spark, f"{self.base}/{MARKERS}/{name}", "")
        kept = {name, *marks[-1:]}
        used: set[str] = set()
        for each in kept:
            used |= set(json.loads(read_text(self.spark, f"{self.base}/{MANIFESTS}/{each}"))["folders"].values())
        for old in names_in(self.spark, f"{self.base}/{MANIFESTS}"):
            if old not in kept:
                for folder in json.loads(read_text(self.spark, f"{self.base}/{MANIFESTS}/{old}"))["folders"].values():
                    if folder not in used:
                        delete_path(self.spark, f"{self.base}/{DATA}/{folder}")
                delete_path(self.spark, f"{self.base}/{MARKERS}/{old}")
                delete_path(self.spark, f"{self.base}/{MANIFESTS}/{old}")


def _bucket_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder names of what a partitioned write gave, by bucket."""
    return {name.partition("=")[2]: name for name in names_in(spark, path) if name.startswith(f"{BUCKET}=")}
