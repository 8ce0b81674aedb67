"""Running a pipeline: layers in order, tasks in the order they are listed."""

from __future__ import annotations

import json
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks import read_quarantine, store_batch
from ..sources import decoded_part, load_source, quarantined, relation_from_rows, watermarked
from ..spec import STAGES, PipelineSpec, SourceSpec, SpecError, TaskSpec, parse_pipeline
from ..streaming import (
    AT_ONCE,
    DRAIN,
    default_output_mode,
    finish,
    has_stored,
    run_for,
    start_sinks,
    stored_stream,
)
from ..workspace import Workspace, read_text, shared_root, write_text
from .namespace import current_schema, drop_schema
from .preview import PREVIEW_ROWS, json_rows, output_of, preview, try_task
from .tasks import run_code

# Formats sample rows can be landed in for a file source to read.
LANDING_FORMATS = ("csv", "json")


@dataclass
class Run:
    """What a run produced: the relation of each target, and its queries."""

    relations: dict[str, DataFrame] = field(default_factory=dict)
    queries: list[StreamingQuery] = field(default_factory=list)


class Pipeline:
    """A pipeline document bound to a session and a working folder.

    The working folder must be reachable by all executors; the session's
    ``spark.checkpoint.dir`` is the default.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: PipelineSpec | Mapping[str, Any] | str,
        working_dir: str | None = None,
        storage_format: str = "parquet",
    ) -> None:
        self.spark = spark
        self.spec = spec if isinstance(spec, PipelineSpec) else parse_pipeline(spec)
        self.workspace = Workspace(
            app=self.spec.name,
            working_dir=working_dir or shared_root(spark),
            storage_format=storage_format,
        )
        # Relations this object published as views, which other pipelines of
        # the session may have replaced since.
        self._views: dict[str, DataFrame] = {}

    def run(
        self,
        stage: str | None = None,
        task: str | None = None,
        await_seconds: float | None = None,
        trigger: Mapping[str, Any] | None = None,
    ) -> Run:
        """Run all layers, one layer, or one task.

        Streaming tasks drain what their sources hold.  With ``await_seconds``
        the queries of each task run that long and are stopped; with just a
        ``trigger`` they are left running and returned.
        """
        stages = STAGES if stage is None else (stage,)
        chosen = [
            t
            for s in stages
            for t in self.spec.layer(s)
            if task is None or t.name == task
        ]
        if task is not None and not chosen:
            raise SpecError(f"no task {task!r} in {', '.join(stages)}")
        run = Run()
        with self._session():
            for each in chosen:
                self._run_task(each, run, await_seconds, trigger)
        return run

    def resolve(self, stage: str) -> dict[str, DataFrame]:
        """Views of every task before ``stage``, built without writing anything."""
        with self._session():
            relations: dict[str, DataFrame] = {}
            self._resolve(stage, relations)
            return relations

    def preview(self, stage: str, task: str, limit: int = PREVIEW_ROWS):
        """First rows of a task's output as JSON objects, and their DataFrame."""
        with self._session():
            chosen = self.spec.task(stage, task)
            view = self._views.get(chosen.sink.target)
            rows = preview(self.spark, self.workspace, chosen, limit, view=view)
            return json_rows(rows), rows

    def output(self, stage: str, task: str) -> DataFrame:
        """The whole output of a task."""
        with self._session():
            chosen = self.spec.task(stage, task)
            view = self._views.get(chosen.sink.target)
            return output_of(self.spark, self.workspace, chosen, view)

    def quarantine(self, task: str) -> DataFrame:
        """Messages of a staging task that could not be decoded, with body and error."""
        with self._session():
            return read_quarantine(self.spark, self.workspace, self.spec.task("staging", task))

    def try_task(
        self,
        stage: str,
        task: str,
        samples: Mapping[str, DataFrame] | None = None,
    ) -> DataFrame:
        """Result of a task over sample rows; nothing is stored."""
        with self._conf():
            return try_task(self.spark, self.spec, stage, task, samples)

    def land_samples(self, mode: str = "errorifexists") -> list[str]:
        """Write each staging task's sample rows where its file source reads."""
        landed = []
        with self._conf():
            for task in self.spec.staging:
                source = task.source
                if task.samples is None or not _lands(source):
                    continue
                rows = relation_from_rows(self.spark, task.samples, source.schema)
                writer = rows.write.format(source.format).mode(mode)
                writer.option("header", "true").save(source.path)
                landed.append(source.path)
        return landed

    def clean(self) -> None:
        """Drop the pipeline's schema and delete all it has stored."""
        drop_schema(self.spark, self.workspace)

    def _run_task(
        self,
        task: TaskSpec,
        run: Run,
        await_seconds: float | None,
        trigger: Mapping[str, Any] | None,
    ) -> None:
        self._resolve(task.stage, run.relations)
        skipped = self._resolve_siblings(task, run.relations)
        inputs = self._feed(task, run.relations)
        try:
            df = self._build(task)
        except AnalysisException as error:
            # A task before it that could not be built is the likely cause.
            raise error from (skipped[0] if skipped else None)
        if df.isStreaming:
            if task.code is not None and not task.streaming:
                raise SpecError(f"batch task {task.name!r} reads a streaming relation")
            pace = trigger or (DRAIN if await_seconds is None else AT_ONCE)
            if inputs:
                path = self.workspace.inputs_path(task.stage, task.sink.target)
                write_text(self.spark, path, json.dumps(inputs))
            queries = start_sinks(self.workspace, task, df, pace)
            run.queries += queries
            if await_seconds is not None:
                run_for(queries, await_seconds)
            elif trigger is None:
                finish(queries)
        else:
            df = store_batch(self.spark, self.workspace, task, df)
        df = decoded_part(df) if quarantined(task.source) else df
        run.relations[task.sink.target] = df
        if "view" in task.sink.kinds:
            self._publish(task.sink.target, df)

    def _resolve(self, stage: str, known: dict[str, DataFrame]) -> None:
        """Add to ``known`` the views of earlier layers it does not hold yet."""
        for earlier in STAGES[: STAGES.index(stage)]:
            for task in self.spec.layer(earlier):
                self._resolve_task(task, known)

    def _resolve_siblings(
        self, task: TaskSpec, known: dict[str, DataFrame]
    ) -> list[AnalysisException]:
        """Add the views of tasks listed before ``task`` in its layer.

        One that cannot be built is left out, as the task may not read it; why
        is returned.
        """
        skipped: list[AnalysisException] = []
        for sibling in self.spec.before(task) if task.source is None else ():
            try:
                self._resolve_task(sibling, known)
            except AnalysisException as error:
                skipped.append(error)
        return skipped

    def _feed(self, task: TaskSpec, known: dict[str, DataFrame]) -> dict[str, str]:
        """Views of streams that are stored read what is stored.

        A stream that was never stored is built from its source instead.  What a
        task read first it goes on reading, as its checkpoint counts on it.
        """
        if task.source is not None:
            return {}
        path = self.workspace.inputs_path(task.stage, task.sink.target)
        noted = json.loads(read_text(self.spark, path) or "{}")
        chosen: dict[str, str] = {}
        earlier = [t for s in STAGES[: STAGES.index(task.stage)] for t in self.spec.layer(s)]
        for other in (*earlier, *self.spec.before(task)):
            target = other.sink.target
            rows = known.get(target)
            if rows is None or not rows.isStreaming or not other.sink.stored or other.sink.keyed:
                continue
            if "view" not in other.sink.kinds or default_output_mode(other.stage) == "complete":
                continue
            held = has_stored(self.spark, self.workspace, other)
            chosen[target] = noted.get(target, "stored" if held else "built")
            if chosen[target] == "stored":
                schema = self._build(other).schema if quarantined(other.source) else rows.schema
                rows = stored_stream(self.spark, self.workspace, other, schema)
                if other.source is not None:
                    rows = watermarked(rows, other.source)
            else:
                rows = self._build(other)
            rows = decoded_part(rows) if quarantined(other.source) else rows
            self._publish(target, rows)
        return chosen

    def _resolve_task(self, task: TaskSpec, known: dict[str, DataFrame]) -> None:
        target = task.sink.target
        if "view" in task.sink.kinds and target not in known:
            known[target] = self._build(task)
            if quarantined(task.source):
                known[target] = decoded_part(known[target])
            self._publish(target, known[target])

    def _publish(self, target: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(target)
        self._views[target] = df

    def _build(self, task: TaskSpec) -> DataFrame:
        if task.source is not None:
            return load_source(self.spark, task.source)
        return run_code(self.spark, task)

    @contextmanager
    def _session(self):
        with self._conf(), current_schema(self.spark, self.workspace):
            yield

    @contextmanager
    def _conf(self):
        """The document's session settings, for as long as the pipeline works."""
        before = {key: self.spark.conf.get(key, None) for key in self.spec.conf}
        try:
            for key, value in self.spec.conf.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)


def _lands(source: SourceSpec | None) -> bool:
    return (
        source is not None
        and source.kind.lower() == "filestore"
        and source.format in LANDING_FORMATS
        and source.path is not None
    )
