"""Batch sinks: a file path, a managed table, a view, or any mix of them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from ..sources.messages import decoded_part, quarantined, undecoded_part
from ..sources.schema import TABLE_FORMATS
from ..spec import SinkSpec, SpecError, TaskSpec
from ..workspace import Workspace, path_exists
from .keyed import BUCKETS, KeyedFiles
from .versions import (
    current_path,
    merged_schema,
    note_schema,
    replace_files,
    replace_table,
    stored_schema,
)


def default_mode(stage: str) -> str:
    """Serving results replace each other, the layers before it accumulate."""
    return "overwrite" if stage == "serving" else "append"


def store_batch(
    spark: SparkSession, workspace: Workspace, task: TaskSpec, df: DataFrame
) -> DataFrame:
    """Write ``df`` to the task's stored sinks; return the relation to read on.

    What the task gives is computed, or its source read, once: the first sink
    is written from it, the other sinks and later tasks read what this run
    added to the first.
    """
    mode = task.sink.mode or default_mode(task.stage)
    rows = df
    for number, kind in enumerate(task.sink.stored):
        written = write_sink(spark, workspace, task, rows, kind, mode)
        rows = rows if number else written
    return rows


def write_sink(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    df: DataFrame,
    kind: str,
    mode: str,
) -> DataFrame:
    """Write ``df`` to one sink; return the rows just written, as read back."""
    if task.sink.keyed:
        return change_keyed(spark, workspace, task, df)
    if kind == "table":
        return _write_table(spark, workspace, task, df, mode)
    return _write_files(spark, workspace, task, df, mode)


def keyed_files(spark: SparkSession, workspace: Workspace, task: TaskSpec) -> KeyedFiles:
    """The sink of a task that keeps one row a key."""
    base = workspace.data_path(task.stage, task.sink.target)
    buckets = task.sink.buckets or BUCKETS
    return KeyedFiles(spark, base, task.sink.keys, buckets, workspace.storage_format)


def change_keyed(
    spark: SparkSession, workspace: Workspace, task: TaskSpec, df: DataFrame, batch: int | None = None
) -> DataFrame:
    """Put ``df`` into a keyed sink, a micro-batch once only; return all the sink holds."""
    files = keyed_files(spark, workspace, task)
    writer = None if batch is None else workspace.checkpoint_path(task.stage, task.sink.target, "keyed")
    if task.sink.mode == "merge":
        files.fold(df, task.sink.merge, writer=writer, batch=batch)
    else:
        files.upsert(df, task.sink.order, writer=writer, batch=batch)
    return files.read()


def _write_files(spark, workspace, task, df, mode) -> DataFrame:
    base = workspace.data_path(task.stage, task.sink.target)
    if mode == "overwrite" and not _in_place(workspace, task.sink):
        path = replace_files(spark, base, _writer(workspace, task.sink, df).save)
        note_schema(spark, base, df.schema)
        return _read_files(spark, workspace, task, path, df.schema)
    path = current_path(spark, base)
    if mode == "overwrite" or workspace.storage_format in TABLE_FORMATS:
        _writer(workspace, task.sink, df).mode(mode).save(path)
        return _read_files(spark, workspace, task, path, df.schema)
    if not path_exists(spark, base):
        _writer(workspace, task.sink, df).mode(mode).save(path)
        note_schema(spark, base, df.schema)
        return _read_files(spark, workspace, task, path, df.schema)
    if mode == "ignore":
        return df
    schema = merged_schema(spark, base, df.schema, task.sink.options)
    before = _files(spark, workspace, task, path, schema)
    _writer(workspace, task.sink, df).mode(mode).save(path)
    note_schema(spark, base, schema)
    new = _files(spark, workspace, task, path, schema) - before
    return _read_new(spark, workspace, task, path, df.schema, new)


def _write_table(spark, workspace, task, df, mode) -> DataFrame:
    table, sink = workspace.table(task.sink.target), task.sink
    if mode == "overwrite" and not _in_place(workspace, sink):
        replace_table(
            spark,
            table,
            workspace.table_versions_path(sink.target),
            df,
            sink.partition_by,
            {"format": workspace.storage_format, **sink.options},
            _writer(workspace, sink, df).save,
        )
        return spark.read.table(table).select(*df.columns)
    held = mode == "append" and spark.catalog.tableExists(table)
    if not held or workspace.storage_format in TABLE_FORMATS:
        written = mode != "ignore" or not spark.catalog.tableExists(table)
        _writer(workspace, sink, df).mode(mode).saveAsTable(table)
        return spark.read.table(table).select(*df.columns) if written else df
    before = set(spark.read.table(table).inputFiles())
    _writer(workspace, sink, df).mode(mode).saveAsTable(table)
    spark.catalog.refreshTable(table)
    new = set(spark.read.table(table).inputFiles()) - before
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    location = {row.col_name: row.data_type for row in described}["Location"]
    return _read_new(spark, workspace, task, location, df.schema, new)


def _in_place(workspace: Workspace, sink: SinkSpec) -> bool:
    """Whether an overwrite is left to the writer: a transaction of the format's
    own, or only the partitions that come."""
    dynamic = sink.options.get("partitionOverwriteMode", "").lower() == "dynamic"
    return dynamic or workspace.storage_format in TABLE_FORMATS


def read_sink(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    kind: str,
    schema: StructType | None = None,
) -> DataFrame:
    """What a sink holds; a known ``schema`` saves inferring it from files."""
    if task.sink.keyed:
        return keyed_files(spark, workspace, task).read()
    if kind == "table":
        rows = spark.read.table(workspace.table(task.sink.target))
        return rows if schema is None else rows.select(*schema.names)
    base = workspace.data_path(task.stage, task.sink.target)
    if quarantined(task.source):
        rows = _read_files(spark, workspace, task, base, stored_schema(spark, base))
        return decoded_part(rows) if schema is None else decoded_part(rows).select(*schema.names)
    if schema is None:
        schema = stored_schema(spark, base)
    return _read_files(spark, workspace, task, current_path(spark, base), schema)


def read_quarantine(spark: SparkSession, workspace: Workspace, task: TaskSpec) -> DataFrame:
    """Rows of a message source that could not be decoded, with their body and error."""
    if not quarantined(task.source):
        raise SpecError(f"task {task.name!r} keeps no quarantine")
    base = workspace.data_path(task.stage, task.sink.target)
    rows = _read_files(spark, workspace, task, base, stored_schema(spark, base))
    return undecoded_part(rows, task.source.schema)


def _read_files(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    path: str,
    schema: StructType | None,
) -> DataFrame:
    rows = _reader(spark, workspace, task, schema).load(path)
    # Partition columns come last when read; put them back in their place.
    return rows if schema is None else rows.select(*schema.names)


def _reader(spark, workspace, task, schema):
    reader = spark.read.format(workspace.storage_format).options(**task.sink.options)
    if schema is not None and workspace.storage_format not in TABLE_FORMATS:
        reader = reader.schema(schema)
    return reader


def _files(spark, workspace, task, path, schema) -> set[str]:
    return set(_reader(spark, workspace, task, schema).load(path).inputFiles())


def _read_new(spark, workspace, task, base, schema, files: set[str]) -> DataFrame:
    """The rows of some files of a dataset."""
    if not files:
        return spark.createDataFrame([], schema)
    reader = _reader(spark, workspace, task, schema).option("basePath", base)
    return reader.load([unquote(name) for name in sorted(files)]).select(*schema.names)


def _writer(workspace: Workspace, sink: SinkSpec, df: DataFrame) -> DataFrameWriter:
    writer = df.write.format(workspace.storage_format)
    # Lets an overwrite change the schema in formats that guard it.
    writer = writer.option("overwriteSchema", "true").options(**sink.options)
    return writer.partitionBy(*sink.partition_by) if sink.partition_by else writer
