"""Relations from sample rows pasted into a document or a preview request.

Samples are small by nature: they are typed in by hand and travel inside the
document.  Everything after the first parallelised row is ordinary Spark.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..spec import SpecError
from ..workspace import delete_path, scratch_dir
from .messages import decode_json

# Fixed value: rows shown of a pasted sample.
SAMPLE_ROWS = 25


def relation_from_rows(
    spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: StructType
) -> DataFrame:
    """Rows as JSON text, typed by the declared schema.

    Going through JSON accepts what a document can hold: an int for a double
    column, an ISO timestamp with an offset, missing keys.
    """
    lines = [(json.dumps(row),) for row in rows]
    return decode_json(spark.createDataFrame(lines, "line string"), "line", schema)


def read_inferred(spark: SparkSession, path: str, format: str) -> DataFrame:
    """JSON or CSV files read with an inferred schema.

    JSON has a record per line; CSV cells may contain line breaks.
    """
    if format not in ("json", "csv"):
        raise SpecError(f"cannot infer a {format!r} sample, expected json or csv")
    reader = spark.read.format(format).option("inferSchema", "true")
    if format == "csv":
        reader = reader.option("header", "true").option("multiLine", "true")
    return reader.load(path)


def infer_sample(
    spark: SparkSession, text: str, format: str = "json", limit: int = SAMPLE_ROWS
) -> tuple[list[dict[str, Any]], str]:
    """First rows of a pasted sample, and the schema to declare for it as JSON.

    A JSON sample is an array, an object, or a record per line.
    """
    path = scratch_dir(spark, "sample")
    lines = _json_lines(text) if format == "json" else [text]
    pasted = spark.createDataFrame([(line,) for line in lines], "value string")
    pasted.coalesce(1).write.text(path)
    rows = read_inferred(spark, path, format).limit(limit)
    shown = json_rows(rows), rows.schema.json()
    delete_path(spark, path)
    return shown


def _json_lines(text: str) -> list[str]:
    try:
        whole = json.loads(text)
    except json.JSONDecodeError:
        return [text]
    return [json.dumps(row) for row in (whole if isinstance(whole, list) else [whole])]


def json_rows(df: DataFrame) -> list[dict[str, Any]]:
    """A limited DataFrame as JSON objects; NULL fields are left out."""
    lines = df.select(F.to_json(F.struct("*")).alias("line")).collect()
    return [json.loads(row["line"]) for row in lines]
