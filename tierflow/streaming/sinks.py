"""Checkpointed streaming sinks, append and complete."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sinks import change_keyed, write_sink
from ..sinks.versions import merged_schema, note_schema
from ..sources.messages import BAD, quarantined
from ..sources.schema import TABLE_FORMATS
from ..spec import SpecError, TaskSpec
from ..workspace import Workspace, path_exists
from .queries import stopped_on_error


def default_output_mode(stage: str) -> str:
    """Serving republishes its whole result, the layers before it add rows."""
    return "complete" if stage == "serving" else "append"


def start_sinks(
    workspace: Workspace, task: TaskSpec, df: DataFrame, trigger: Mapping[str, Any]
) -> list[StreamingQuery]:
    """Start the queries that fill the task's stored sinks.

    Only the first reads ``df``; the others stream what it has stored, so that
    each row is computed once.  A query that drains its source is waited for
    before the next one reads what it stored.
    """
    if not task.sink.stored:
        return []
    if task.sink.keyed:
        return [_start_keyed(workspace, task, df, trigger)]
    if task.sink.mode is not None:
        raise SpecError(f"task {task.name!r}: a write mode is for batch tasks, not for streams")
    if default_output_mode(task.stage) == "complete":
        return [_start_complete(workspace, task, df, trigger)]
    spark = df.sparkSession
    _check_files(workspace, task, df)
    started: list[StreamingQuery] = []
    with stopped_on_error(started):
        for kind in task.sink.stored:
            rows = stored_stream(spark, workspace, task, df.schema) if started else df
            started.append(_start_append(workspace, task, rows, kind, trigger))
            if "availableNow" in trigger:
                started[-1].awaitTermination()
    return started


def stored_stream(
    spark: SparkSession, workspace: Workspace, task: TaskSpec, schema: StructType
) -> DataFrame:
    """What a streaming task's first sink has stored, each row once, as a stream."""
    if task.sink.stored[0] == "table":
        return spark.readStream.table(workspace.table(task.sink.target)).select(*schema.names)
    reader = spark.readStream.format(workspace.storage_format).options(**task.sink.options)
    if workspace.storage_format not in TABLE_FORMATS:
        reader = reader.schema(schema)
    path = workspace.data_path(task.stage, task.sink.target)
    return reader.load(path).select(*schema.names)


def has_stored(spark: SparkSession, workspace: Workspace, task: TaskSpec) -> bool:
    """Whether a streaming task has filled its first sink before."""
    target, kind = task.sink.target, task.sink.stored[0]
    return path_exists(spark, workspace.checkpoint_path(task.stage, target, kind))


def _check_files(workspace: Workspace, task: TaskSpec, df: DataFrame) -> None:
    if "file" in task.sink.stored and workspace.storage_format not in TABLE_FORMATS:
        spark, base = df.sparkSession, workspace.data_path(task.stage, task.sink.target)
        note_schema(spark, base, merged_schema(spark, base, df.schema, task.sink.options))


def _start_append(
    workspace: Workspace,
    task: TaskSpec,
    df: DataFrame,
    kind: str,
    trigger: Mapping[str, Any],
) -> StreamingQuery:
    """Each row once per sink: every sink has a query and a checkpoint of its own."""
    target = task.sink.target
    checkpoint = workspace.checkpoint_path(task.stage, target, kind)
    writer = df.writeStream.format(workspace.storage_format).outputMode("append")
    writer = writer.options(**task.sink.options).trigger(**trigger)
    if quarantined(task.source):
        # one read and one log of offsets; the two kinds of rows lie in folders of their own
        writer = writer.partitionBy(BAD)
    if task.sink.partition_by:
        writer = writer.partitionBy(*task.sink.partition_by)
    writer = writer.option("checkpointLocation", checkpoint)
    if kind == "table":
        return writer.toTable(workspace.table(target))
    return writer.start(workspace.data_path(task.stage, target))


def _start_complete(
    workspace: Workspace, task: TaskSpec, df: DataFrame, trigger: Mapping[str, Any]
) -> StreamingQuery:
    """Replace the stored result with that of every micro-batch.

    A batch holds the whole result, so writing it again after a failure gives
    the same data.  One query and one state serve all sinks: the first is
    written from the batch, the others from the first.
    """
    stored = task.sink.stored

    def replace(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = write_sink(session, workspace, task, batch, stored[0], "overwrite")
        for kind in stored[1:]:
            write_sink(session, workspace, task, rows, kind, "overwrite")

    checkpoint = workspace.checkpoint_path(task.stage, task.sink.target, "complete")
    writer = df.writeStream.outputMode("complete").foreachBatch(replace)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.start()


def _start_keyed(
    workspace: Workspace, task: TaskSpec, df: DataFrame, trigger: Mapping[str, Any]
) -> StreamingQuery:
    """Put each micro-batch into the buckets it touches.

    A streaming aggregate gives the groups that changed, other queries their new
    rows.  The sink notes the batches it has, so one that is run again is left out.
    """

    def change(batch: DataFrame, batch_id: int) -> None:
        change_keyed(batch.sparkSession, workspace, task, batch, batch_id)

    checkpoint = workspace.checkpoint_path(task.stage, task.sink.target, "keyed")
    writer = df.writeStream.outputMode("update").foreachBatch(change)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
