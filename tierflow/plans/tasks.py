"""Task code: SQL text or Python, giving a DataFrame.

Python text runs in the driver with the session at hand, so a pipeline
document is trusted code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import SpecError, TaskSpec

# The variable Python text assigns, and the view it is published as.
RESULT_NAME = "output_df"
RESULT_VIEW = "__{name}_code_output__"


def run_code(spark: SparkSession, task: TaskSpec) -> DataFrame:
    code = task.code
    if code is None:
        raise SpecError(f"task {task.name!r} has no code")
    if code.build is not None:
        return _published(code.build(spark), task)
    if code.lang == "sql":
        return spark.sql(code.text)
    names = {"spark": spark}
    exec(compile(code.text, f"<task {task.name}>", "exec"), names)
    return _published(names.get(RESULT_NAME), task)


def _published(result: object, task: TaskSpec) -> DataFrame:
    if not isinstance(result, DataFrame):
        raise SpecError(f"task {task.name!r} must give a DataFrame as {RESULT_NAME}")
    result.createOrReplaceTempView(RESULT_VIEW.format(name=task.name))
    return result
