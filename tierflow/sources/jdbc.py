"""JDBC table source, read in parallel ranges of a partition column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import SourceSpec, SpecError
from .schema import conform

# Spark's names for the settings of a range-partitioned read.
RANGE_OPTIONS = {
    "partition_column": "partitionColumn",
    "lower_bound": "lowerBound",
    "upper_bound": "upperBound",
    "num_partitions": "numPartitions",
}


def jdbc_options(source: SourceSpec) -> dict[str, str]:
    """Reader options: connection, table, and the ranges to read in parallel.

    Without a partition column the table comes through one connection and one
    task, so name one for any table that does not fit in a task.
    """
    options = dict(source.options)
    options["url"] = str(source.setting("jdbc_url"))
    options["dbtable"] = str(source.setting("table_name"))
    for name, option in (("jdbc_username", "user"), ("jdbc_password", "password")):
        if source.optional(name) is not None:
            options[option] = str(source.optional(name))
    ranges = {
        option: str(source.optional(name))
        for name, option in RANGE_OPTIONS.items()
        if source.optional(name) is not None
    }
    if ranges and len(ranges) < len(RANGE_OPTIONS):
        raise SpecError(f"a partitioned read needs all of {list(RANGE_OPTIONS)}")
    return options | ranges


def load_jdbc(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """The table, cast to the declared schema after the driver's own types."""
    table = spark.read.format("jdbc").options(**jdbc_options(source)).load()
    return conform(table, source.schema)
