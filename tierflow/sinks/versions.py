"""Replacing stored data in one step, and checking what is added to it.

A result that replaces another is written to a folder of its own.  Only when all
of it is there, readers are switched: for files by a marker, whose name says
which folder is the current one, for tables by the table's location.  A run that
fails or is stopped before leaves the last result in place.  The result before
the current one is kept until the next switch, for readers that began before.
One run at a time writes to a sink.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..spec import SpecError
from ..workspace import delete_path, names_in, read_text, write_text

# Names below a file sink's folder; readers of files skip what begins like this.
MARKERS, VERSIONS, SCHEMA = "_current", "_versions", "_stored_schema"


def current_path(spark: SparkSession, base: str) -> str:
    """Where the data of a file sink lies now."""
    marks = names_in(spark, f"{base}/{MARKERS}")
    return f"{base}/{VERSIONS}/{marks[-1]}" if marks else base


def replace_files(spark: SparkSession, base: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a new folder, then make it the current one."""
    marks = names_in(spark, f"{base}/{MARKERS}")
    number = int(marks[-1].partition("-")[0]) + 1 if marks else 0
    name = f"{number:012d}-{uuid.uuid4().hex}"
    path = f"{base}/{VERSIONS}/{name}"
    write(path)
    write_text(spark, f"{base}/{MARKERS}/{name}", "")
    kept = {name, *marks[-1:]}
    for folder in (MARKERS, VERSIONS):
        for old in names_in(spark, f"{base}/{folder}"):
            if old not in kept:
                delete_path(spark, f"{base}/{folder}/{old}")
    return path


def replace_table(
    spark: SparkSession, table: str, versions: str, df: DataFrame, partition_by, options, write
) -> None:
    """Have ``write`` fill a new folder, then point the table at it.

    Where columns or partitions differ the table is declared anew over the new
    folder; its data is never touched.
    """
    path = f"{versions}/{uuid.uuid4().hex}"
    write(path)
    before = None
    if spark.catalog.tableExists(table):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
        facts = {row.col_name: row.data_type for row in rows}
        before, external = facts.get("Location"), facts.get("Type") == "EXTERNAL"
        same = spark.table(table).schema.simpleString() == df.schema.simpleString()
        if external and same and not partition_by and "# Partition Information" not in facts:
            spark.sql(f"ALTER TABLE {table} SET LOCATION {_text(path)}")
        else:
            spark.sql(f"DROP TABLE {table}")
            before = before if external else None
            _declare(spark, table, path, df, partition_by, options)
    else:
        _declare(spark, table, path, df, partition_by, options)
    spark.catalog.refreshTable(table)
    kept = {path.rsplit("/", 1)[-1], (before or "").rstrip("/").rsplit("/", 1)[-1]}
    for old in names_in(spark, versions):
        if old not in kept:
            delete_path(spark, f"{versions}/{old}")


def _declare(spark, table, path, df, partition_by, options) -> None:
    columns = df._jdf.schema().toDDL()
    parts = ", ".join("`" + name.replace("`", "``") + "`" for name in partition_by)
    options = dict(options)
    text = f"CREATE TABLE {table} ({columns}) USING {options.pop('format')}"
    if options:
        text += " OPTIONS (" + ", ".join(f"{_text(k)} {_text(v)}" for k, v in options.items()) + ")"
    if parts:
        text += f" PARTITIONED BY ({parts})"
    spark.sql(f"{text} LOCATION {_text(path)}")
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {table}")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stored_schema(spark: SparkSession, base: str) -> StructType | None:
    """The columns a file sink was given so far."""
    text = read_text(spark, f"{base}/{SCHEMA}")
    return None if text is None else StructType.fromJson(json.loads(text))


def merged_schema(
    spark: SparkSession, base: str, schema: StructType, options: Mapping[str, str]
) -> StructType:
    """The columns a file sink has once rows of ``schema`` are added to it.

    Columns must be the ones stored, by name and type; with ``mergeSchema``
    some may be missing and new ones come last.
    """
    known = stored_schema(spark, base)
    if known is None:
        return schema
    merge = options.get("mergeSchema", "false").lower() == "true"
    before = {f.name.lower(): f for f in known}
    after = {f.name.lower(): f for f in schema}
    changed = [
        f"{f.name} {before[n].dataType.simpleString()} -> {f.dataType.simpleString()}"
        for n, f in after.items()
        if n in before and f.dataType.simpleString() != before[n].dataType.simpleString()
    ]
    added = [f for n, f in after.items() if n not in before]
    missing = [f.name for n, f in before.items() if n not in after]
    if changed or not merge and (added or missing):
        raise SpecError(
            f"rows to append to {base} differ from what is stored: changed {changed}, "
            f"added {[f.name for f in added]}, missing {missing}"
        )
    return StructType([*known.fields, *added])


def note_schema(spark: SparkSession, base: str, schema: StructType) -> None:
    if stored_schema(spark, base) != schema:
        write_text(spark, f"{base}/{SCHEMA}", schema.json())

