"""Pipeline documents: JSON in, plain dataclasses out.

A document names a pipeline and three ordered layers of tasks.  A staging task
has a typed source; a standard or serving task has SQL or Python code over the
relations of the layers before it.  Every task publishes its result to any of
three sinks: ``table``, ``file`` and ``view``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Layer and sink names of the document format.
STAGES = ("staging", "standard", "serving")
SINK_KINDS = ("table", "file", "view")
READ_TYPES = ("batch", "streaming")
WRITE_MODES = ("append", "overwrite", "errorifexists", "ignore", "upsert", "merge")
KEYED_MODES = ("upsert", "merge")


class SpecError(ValueError):
    """The document does not describe a runnable pipeline."""


@dataclass(frozen=True)
class SourceSpec:
    """Where a staging task reads from.

    ``settings`` holds every key of the source that is not named here, such as
    the account of an object store or the table of a JDBC source.
    """

    kind: str
    schema: StructType | None = None
    format: str | None = None
    path: str | None = None
    read_type: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    settings: Mapping[str, Any] = field(default_factory=dict)

    def setting(self, name: str) -> Any:
        """A required key, accepted with dashes or underscores."""
        found = self.optional(name)
        if found is None:
            raise SpecError(f"source {self.kind!r} needs {name!r}")
        return found

    def optional(self, name: str, default: Any = None) -> Any:
        for spelling in (name, name.replace("_", "-"), name.replace("-", "_")):
            if self.settings.get(spelling) is not None:
                return self.settings[spelling]
        return default


@dataclass(frozen=True)
class SinkSpec:
    """Where a task publishes; ``mode`` overrides the layer's write mode."""

    target: str
    kinds: tuple[str, ...]
    mode: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    # of the modes that keep one row a key
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    buckets: int | None = None
    merge: Mapping[str, str] = field(default_factory=dict)

    @property
    def keyed(self) -> bool:
        return self.mode in KEYED_MODES

    @property
    def stored(self) -> tuple[str, ...]:
        """The kinds that keep data, in the order they are written."""
        return tuple(kind for kind in ("file", "table") if kind in self.kinds)


@dataclass(frozen=True)
class CodeSpec:
    """SQL text, Python text or a Python callable from session to DataFrame."""

    lang: str
    text: str | None = None
    build: Callable[[SparkSession], DataFrame] | None = None


@dataclass(frozen=True)
class TaskSpec:
    name: str
    stage: str
    sink: SinkSpec
    streaming: bool = False
    source: SourceSpec | None = None
    code: CodeSpec | None = None
    samples: Sequence[Mapping[str, Any]] | None = None


@dataclass(frozen=True)
class PipelineSpec:
    name: str
    staging: tuple[TaskSpec, ...] = ()
    standard: tuple[TaskSpec, ...] = ()
    serving: tuple[TaskSpec, ...] = ()
    conf: Mapping[str, str] = field(default_factory=dict)

    def layer(self, stage: str) -> tuple[TaskSpec, ...]:
        if stage not in STAGES:
            raise SpecError(f"unknown stage {stage!r}, expected one of {STAGES}")
        return getattr(self, stage)

    def tasks(self) -> Iterator[TaskSpec]:
        for stage in STAGES:
            yield from self.layer(stage)

    def before(self, task: TaskSpec) -> tuple[TaskSpec, ...]:
        """Tasks listed before one in its layer."""
        layer = self.layer(task.stage)
        return layer[: layer.index(task)]

    def task(self, stage: str, name: str) -> TaskSpec:
        for task in self.layer(stage):
            if task.name == name:
                return task
        raise SpecError(f"no task {name!r} in {stage}")


def parse_pipeline(document: Mapping[str, Any] | str) -> PipelineSpec:
    """Read a document given as JSON text or as parsed JSON.

    Layers may be lists of tasks or objects keyed by task name; a task may keep
    its target, sinks, code and source keys at its root instead of in
    ``output``, ``code`` and ``input``.
    """
    if isinstance(document, str):
        document = json.loads(document)
    name = document.get("name")
    if not name:
        raise SpecError("a pipeline needs a name")
    layers = {
        stage: tuple(
            _task(stage, raw) for raw in _named_tasks(document.get(stage) or ())
        )
        for stage in STAGES
    }
    conf = {key: _option(value) for key, value in (document.get("conf") or {}).items()}
    return PipelineSpec(name=name, conf=conf, **layers)


def load_pipeline(spark: SparkSession, path: str) -> PipelineSpec:
    """Read a document from any path Spark can reach."""
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise SpecError(f"{path} is empty")
    return parse_pipeline(row["value"])


def _named_tasks(layer: Any) -> Iterator[Mapping[str, Any]]:
    if isinstance(layer, Mapping):
        for name, body in layer.items():
            yield {"name": name, **body}
    else:
        yield from layer


def _task(stage: str, raw: Mapping[str, Any]) -> TaskSpec:
    name = raw.get("name")
    if not name:
        raise SpecError(f"a {stage} task needs a name")
    samples = raw.get("sampleData")
    if stage == "staging":
        source, sink = _source(raw), _sink(name, raw)
        if source.optional("quarantine") and ("file" not in sink.kinds or "table" in sink.kinds or sink.partition_by):
            raise SpecError(f"task {name!r}: a quarantine is kept in an unpartitioned file sink, not in tables")
        return TaskSpec(
            name=name,
            stage=stage,
            sink=sink,
            streaming=source.read_type == "streaming",
            source=source,
            samples=samples,
        )
    return TaskSpec(
        name=name,
        stage=stage,
        sink=_sink(name, raw),
        streaming=_read_type(raw.get("type", "batch")) == "streaming",
        code=_code(name, raw),
        samples=samples,
    )


def _read_type(value: str) -> str:
    lowered = str(value).lower()
    if lowered not in READ_TYPES:
        raise SpecError(f"unknown read type {value!r}, expected one of {READ_TYPES}")
    return lowered


def _source(raw: Mapping[str, Any]) -> SourceSpec:
    nested = raw.get("input") or {}
    # Keys of the task itself are the fallback for keys the source leaves out.
    taken = {"name", "input", "output", "schema", "sampleData", "target"}
    merged = {k: v for k, v in raw.items() if k not in taken} | dict(nested)
    kind = merged.pop("type", None)
    read_type = merged.pop("read-type", None) or merged.pop("read_type", None)
    if "type" not in nested and str(kind).lower() in READ_TYPES:
        # Keyed-layer form: the root "type" is the read type of a file source.
        read_type, kind = read_type or kind, "filestore"
    if not kind:
        raise SpecError(f"staging task {raw['name']!r} needs a source type")
    schema = raw.get("schema") or merged.pop("schema", None)
    merged.pop("schema", None)
    options = merged.pop("options", None) or {}
    location = merged.pop("location", None)
    return SourceSpec(
        kind=str(kind),
        schema=_schema(raw["name"], schema),
        format=merged.pop("format", None),
        path=merged.pop("path", None) or location,
        read_type=_read_type(read_type) if read_type else None,
        options={key: _option(value) for key, value in options.items()},
        settings=merged,
    )


def _schema(name: str, schema: Any) -> StructType | None:
    """Spark's JSON form, parsed or as the text a sample's inference returns."""
    if schema is None or isinstance(schema, StructType):
        return schema
    try:
        parsed = json.loads(schema) if isinstance(schema, str) else schema
        return StructType.fromJson(parsed)
    except (ValueError, KeyError, TypeError) as error:
        raise SpecError(f"task {name!r} declares no readable schema") from error


def _option(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _sink(name: str, raw: Mapping[str, Any]) -> SinkSpec:
    output = raw.get("output") or {}
    if not isinstance(output, Mapping):
        output = {"type": output}
    target = output.get("target") or raw.get("target")
    if not target:
        raise SpecError(f"task {name!r} needs an output target")
    kinds = output.get("type") or ()
    kinds = (kinds,) if isinstance(kinds, str) else tuple(kinds)
    unknown = [kind for kind in kinds if kind not in SINK_KINDS]
    if unknown or not kinds:
        raise SpecError(
            f"task {name!r} has output types {list(kinds)}, "
            f"expected some of {SINK_KINDS}"
        )
    mode = output.get("mode")
    if mode is not None and mode not in WRITE_MODES:
        raise SpecError(f"task {name!r} has unknown write mode {mode!r}")
    if mode in KEYED_MODES and (not output.get("keys") or "file" not in kinds or "table" in kinds):
        raise SpecError(f"task {name!r}: mode {mode!r} needs 'keys' and a file sink, and writes no table")
    if mode == "merge" and not output.get("merge"):
        raise SpecError(f"task {name!r}: mode 'merge' needs 'merge', how each column is folded")
    return SinkSpec(
        target=target,
        kinds=kinds,
        mode=mode,
        options={
            key: _option(value)
            for key, value in (output.get("options") or {}).items()
        },
        partition_by=tuple(output.get("partition_by") or ()),
        keys=tuple(output.get("keys") or ()),
        order=tuple(output.get("order") or ()),
        buckets=int(output["buckets"]) if output.get("buckets") else None,
        merge=dict(output.get("merge") or {}),
    )


def _code(name: str, raw: Mapping[str, Any]) -> CodeSpec:
    code = raw.get("code")
    if callable(code):
        return CodeSpec(lang="python", build=code)
    if code is None:
        lang = next((lang for lang in ("sql", "python") if lang in raw), None)
        code = {} if lang is None else {"lang": lang, lang: raw[lang]}
    lang = code.get("lang")
    if lang not in ("sql", "python"):
        raise SpecError(f"task {name!r} has unknown code language {lang!r}")
    text = code.get(lang)
    if callable(text):
        return CodeSpec(lang=lang, build=text)
    if not text:
        raise SpecError(f"task {name!r} has no {lang} code")
    return CodeSpec(lang=lang, text=text if isinstance(text, str) else "\n".join(text))
