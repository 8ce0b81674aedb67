"""File sources: a whole folder, a lake table's folder, or only new files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..spec import SourceSpec, SpecError
from .schema import TABLE_FORMATS, conform

# Options set before the document's own.
FILE_DEFAULTS = {"header": "true"}
# Option prefix of incremental discovery, and the option naming its format.
DISCOVERY_PREFIX = "cloudFiles."
DISCOVERY_FORMAT = "format"


def load_files(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Batch or streaming scan of a folder in any format Spark reads.

    The schema is declared, so nothing is read ahead to infer it.
    """
    return _read(spark, source, source.format, FILE_DEFAULTS | dict(source.options))


def load_lake(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Batch or streaming read of a stored dataset by its path.

    The format is the document's, else the session's default table format.
    Where the dataset keeps a schema of its own, the declared one is cast to.
    """
    stored = source.format or spark.conf.get("spark.sql.sources.default")
    if stored not in TABLE_FORMATS:
        return _read(spark, source, stored, dict(source.options))
    own = replace(source, schema=None)
    return conform(_read(spark, own, stored, dict(source.options)), source.schema)


def load_incremental_files(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Stream that picks up each new file of a folder exactly once.

    The sink's checkpoint remembers which files were read.  The rate is set by
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``; discovery options may
    carry the prefix they have in documents written for a vendor's reader.

    The folder is listed for every micro-batch.  With ``archive``, a folder outside it,
    files move there once a later batch has been committed, so what is listed are the
    new files and those of the last batch, however many came before.
    """
    options = {
        key.removeprefix(DISCOVERY_PREFIX): value
        for key, value in source.options.items()
    }
    stored = source.format or options.get(DISCOVERY_FORMAT)
    options.pop(DISCOVERY_FORMAT, None)
    archive = source.optional("archive")
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    reader = spark.readStream.format(_required(stored, source, "format"))
    return _load(reader.options(**(FILE_DEFAULTS | options)), source)


def _read(
    spark: SparkSession, source: SourceSpec, stored: str | None, options: dict
) -> DataFrame:
    if source.read_type not in ("batch", "streaming"):
        raise SpecError(f"unknown read type {source.read_type!r}")
    reader = spark.read if source.read_type == "batch" else spark.readStream
    reader = reader.format(_required(stored, source, "format"))
    return _load(reader.options(**options), source)


def _load(reader, source: SourceSpec) -> DataFrame:
    if source.schema is not None:
        reader = reader.schema(source.schema)
    return reader.load(_required(source.path, source, "path"))


def _required(value: str | None, source: SourceSpec, name: str) -> str:
    if not value:
        raise SpecError(f"source {source.kind!r} needs a {name}")
    return value
