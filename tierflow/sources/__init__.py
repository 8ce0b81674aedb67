"""Typed sources: ``source.kind`` picks the loader, every loader returns a
DataFrame whose ``isStreaming`` tells batch from stream."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.history import with_load_columns
from ..spec import SourceSpec, SpecError
from .files import load_files, load_incremental_files, load_lake
from .jdbc import load_jdbc
from .messages import BAD, decode_json, decode_or_explain, decoded_part, load_messages, quarantined, undecoded_part
from .object_store import load_adl, load_object_store
from .samples import infer_sample, relation_from_rows

Loader = Callable[[SparkSession, SourceSpec], DataFrame]

# Source type names accepted in documents.
LOADERS: dict[str, Loader] = {
    "filestore": load_files,
    "deltalake": load_lake,
    "lake": load_lake,
    "autoloader": load_incremental_files,
    "incremental_files": load_incremental_files,
    "eventhub": load_messages,
    "messages": load_messages,
    "jdbc": load_jdbc,
    "adls_gen2": load_object_store,
    "object_store": load_object_store,
    "adls_gen1": load_adl,
}

# Types whose names documents write with a vendor's word in front.
VENDOR_TYPES = ("eventhub", "messages", "adls_gen1", "adls_gen2", "object_store")


def register_source(kind: str, loader: Loader) -> None:
    """Add a source type of your own."""
    LOADERS[kind.lower()] = loader


def load_source(spark: SparkSession, source: SourceSpec) -> DataFrame:
    kind = source.kind.lower()
    if kind not in LOADERS:
        bare = re.sub(r"^[a-z0-9]+_", "", kind)
        kind = bare if bare in VENDOR_TYPES else kind
    if kind not in LOADERS:
        raise SpecError(f"unknown source type {source.kind!r}")
    rows = watermarked(LOADERS[kind](spark, source), source)
    wanted = source.optional("load_metadata")
    if not wanted:
        return rows
    return with_load_columns(rows, wanted if isinstance(wanted, Mapping) else {})


def watermarked(rows: DataFrame, source: SourceSpec) -> DataFrame:
    """Rows with the watermark their source declares: ``{"column": ..., "delay": ...}``."""
    mark = source.optional("watermark")
    if not mark:
        return rows
    if not isinstance(mark, Mapping) or not {"column", "delay"} <= set(mark):
        raise SpecError(f"source {source.kind!r}: a watermark needs 'column' and 'delay'")
    return rows.withWatermark(mark["column"], mark["delay"])


__all__ = [
    "BAD",
    "LOADERS",
    "decode_json",
    "decode_or_explain",
    "decoded_part",
    "infer_sample",
    "load_source",
    "quarantined",
    "register_source",
    "relation_from_rows",
    "undecoded_part",
    "watermarked",
]
