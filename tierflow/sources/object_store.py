"""Object-store scans: account, container and folder become one URI.

Credentials are Hadoop settings given at submit time, never in the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import SourceSpec, SpecError
from .files import FILE_DEFAULTS

# URI forms of the two Hadoop file systems.
ABFS_URI = "abfss://{container}@{account}.dfs.core.windows.net/{folder}"
ADL_URI = "adl://{account}.{endpoint}/{folder}"


def abfs_uri(source: SourceSpec) -> str:
    return ABFS_URI.format(
        container=source.setting("container-name"),
        account=source.setting("storage-account"),
        folder=source.setting("data-folder"),
    )


def adl_uri(source: SourceSpec) -> str:
    return ADL_URI.format(
        account=source.setting("storage-resource"),
        endpoint=source.setting("endpoint"),
        folder=source.setting("directory-name"),
    )


def load_object_store(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Batch scan below a container.

    A ``root`` setting puts another Hadoop file system in the store's place;
    containers are then folders below it.
    """
    root = source.optional("root")
    if root:
        container = source.setting("container-name")
        folder = source.setting("data-folder")
        return _scan(spark, source, f"{root.rstrip('/')}/{container}/{folder}")
    return _scan(spark, source, abfs_uri(source))


def load_adl(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Batch scan of a first-generation store; ``endpoint`` is its host's domain."""
    return _scan(spark, source, adl_uri(source))


def _scan(spark: SparkSession, source: SourceSpec, uri: str) -> DataFrame:
    if not source.format:
        raise SpecError(f"source {source.kind!r} needs a format")
    reader = spark.read.format(source.format)
    reader = reader.options(**(FILE_DEFAULTS | dict(source.options)))
    if source.schema is not None:
        reader = reader.schema(source.schema)
    return reader.load(uri)
