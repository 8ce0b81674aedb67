"""Names task code sees: the pipeline's schema and views of other tasks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..workspace import Workspace, delete_path


def create_schema(spark: SparkSession, workspace: Workspace) -> None:
    """The pipeline's schema, with its tables below the working folder."""
    location = workspace.tables_dir.replace("'", "\\'")
    spark.sql(
        f"CREATE SCHEMA IF NOT EXISTS {workspace.schema} LOCATION '{location}'"
    )


def drop_schema(spark: SparkSession, workspace: Workspace) -> None:
    """Drop the schema and its tables, and delete everything stored."""
    spark.sql(f"DROP SCHEMA IF EXISTS {workspace.schema} CASCADE")
    delete_path(spark, workspace.root)


@contextmanager
def current_schema(spark: SparkSession, workspace: Workspace) -> Iterator[None]:
    """Unqualified table names mean the pipeline's tables inside the block."""
    before = spark.catalog.currentDatabase()
    create_schema(spark, workspace)
    spark.catalog.setCurrentDatabase(workspace.app)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)


@contextmanager
def scoped_views(
    spark: SparkSession, relations: Mapping[str, DataFrame]
) -> Iterator[None]:
    """Publish relations as views for the block, then put back what was there."""
    before = {name: spark.table(name) for name in relations if is_view(spark, name)}
    for name, relation in relations.items():
        relation.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in relations:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def is_view(spark: SparkSession, name: str) -> bool:
    """Whether the session has a temporary view of this name."""
    quoted = "`" + name.replace("`", "``") + "`"
    if not spark.catalog.tableExists(quoted):
        return False
    return spark.catalog.getTable(quoted).isTemporary
