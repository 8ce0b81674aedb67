"""Declared schemas and sources that bring their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Table formats keep their schema and refuse one given by the reader.
TABLE_FORMATS = {"delta", "hudi", "iceberg"}


def conform(df: DataFrame, schema: StructType | None) -> DataFrame:
    """The declared columns, cast to their declared types."""
    if schema is None:
        return df
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
