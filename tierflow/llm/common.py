"""Helpers the operators share: Arrow batches, stored tables, text to words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from tierflow.workspace import delete_path, scratch_dir

#: Text of one slice of a batch: what a worker holds as Python objects at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def append_columns(
    df: DataFrame,
    new: dict[str, str],
    compute: Callable[[pa.RecordBatch], dict[str, list]],
    text: str = "text",
) -> DataFrame:
    """``df`` with columns computed slice by slice; a column of the same name gives way."""
    fields = [_parse_datatype_string(kind) for kind in new.values()]
    kept = [name for name in df.columns if name not in new]
    schema = StructType(
        [df.schema[name] for name in kept]
        + [StructField(name, kind) for name, kind in zip(new, fields)]
    )
    arrow = [to_arrow_type(kind) for kind in fields]
    names = list(new)

    def run(batches):
        for piece in slices(batches, text):
            made = compute(piece)
            columns = [piece.column(name) for name in kept]
            columns += [_array(made[name], kind) for name, kind in zip(names, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return df.mapInArrow(run, schema)


def _array(values, kind):
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as no bytes."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def bounds(lengths: Iterable[int]) -> np.ndarray:
    """Offsets of consecutive runs of these lengths, with the end of the last."""
    sizes = np.fromiter(lengths, np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def group_stream(
    batches: Iterable[pa.RecordBatch], keys: list[str], handle: Callable
) -> Iterator:
    """Feed ``handle`` runs of whole groups from batches sorted by ``keys``.

    What is held is a batch and the group that is still open at its end.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            if held:
                change[0] |= column[0] != held[-1].column(key)[-1].as_py()
        if held and not change.any():
            held.append(batch)
            continue
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last or held:
            done = pa.Table.from_batches([*held, batch.slice(0, last)])
            yield from handle(done.combine_chunks())
        held = [batch.slice(last)]
    if held:
        yield from handle(pa.Table.from_batches(held).combine_chunks())

