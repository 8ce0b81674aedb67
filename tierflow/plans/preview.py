"""Looking at a task: its stored output, or its result over sample rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import first_rows
from ..sinks import read_sink
from ..sources import relation_from_rows
from ..sources.samples import json_rows
from ..spec import PipelineSpec, SpecError, TaskSpec
from ..workspace import Workspace
from .namespace import is_view, scoped_views
from .tasks import run_code

# Fixed value: rows shown when the caller names no limit.
PREVIEW_ROWS = 20


def preview(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    limit: int = PREVIEW_ROWS,
    order: tuple = (),
    view: DataFrame | None = None,
) -> DataFrame:
    """First rows of :func:`output_of` a task."""
    return first_rows(output_of(spark, workspace, task, view), limit, *order)


def preview_rows(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    limit: int = PREVIEW_ROWS,
) -> list[dict]:
    """The preview as JSON objects; NULL fields are left out."""
    return json_rows(preview(spark, workspace, task, limit))


def output_of(
    spark: SparkSession,
    workspace: Workspace,
    task: TaskSpec,
    view: DataFrame | None = None,
) -> DataFrame:
    """A task's output: its view, else its table, else its files.

    ``view`` is the relation the task published; without it the session's view
    of that name counts.  A streaming view cannot be read as rows, so what the
    task stored is read instead.
    """
    target = task.sink.target
    if "view" in task.sink.kinds:
        if view is None and is_view(spark, target):
            view = spark.table(target)
        if view is not None and not view.isStreaming:
            return view
    for kind in ("table", "file"):
        if kind in task.sink.kinds:
            return read_sink(spark, workspace, task, kind)
    if view is None:
        raise SpecError(f"task {task.name!r} has not run, its view does not exist")
    raise SpecError(f"streaming view {target!r} keeps no rows to show")


def try_task(
    spark: SparkSession,
    spec: PipelineSpec,
    stage: str,
    name: str,
    samples: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Result of a standard or serving task over sample rows, always in batch.

    ``samples`` gives relations by staging task name; other staging tasks use
    the sample rows of the document.  For a serving task all standard tasks are
    built first.  Nothing is stored, and views of the session are left alone.
    """
    if stage not in ("standard", "serving"):
        raise SpecError(f"cannot try a task of stage {stage!r}")
    chosen = spec.task(stage, name)
    relations = _sample_relations(spark, spec, samples or {})
    for task in spec.standard if stage == "serving" else ():
        relations[task.sink.target] = _over(spark, relations, task)
    skipped = None
    for task in spec.before(chosen):
        try:
            relations[task.sink.target] = _over(spark, relations, task)
        except AnalysisException as error:
            skipped = skipped or error
    try:
        return _over(spark, relations, chosen)
    except AnalysisException as error:
        # A task before it that could not be built is the likely cause.
        raise error from skipped


def _over(
    spark: SparkSession, relations: Mapping[str, DataFrame], task: TaskSpec
) -> DataFrame:
    with scoped_views(spark, relations):
        return run_code(spark, task)


def _sample_relations(
    spark: SparkSession, spec: PipelineSpec, samples: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    relations = {}
    for task in spec.staging:
        if task.name in samples:
            relations[task.sink.target] = samples[task.name]
        elif task.samples is not None:
            relations[task.sink.target] = relation_from_rows(
                spark, task.samples, task.source.schema
            )
    return relations
