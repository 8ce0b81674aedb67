"""Pipeline documents over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tierflow import Pipeline
from tierflow.sources.files import FILE_DEFAULTS
from tierflow.workspace import scratch_dir

from .tables import PRICE_SCHEMA, SALES_SCHEMA, prices, table

SALES_COLUMNS = [field["name"] for field in SALES_SCHEMA["fields"]]
JOIN_SQL = [
    "SELECT price.fruit, price.id, sales.l_quantity AS amount,",
    "       price.price, sales.l_shipdate AS ts",
    "FROM stg_sales sales",
    "LEFT JOIN stg_price price",
    "  ON sales.L_PartKey = price.ID",
    " AND sales.l_shipdate >= price.start_ts",
    " AND sales.l_shipdate < price.end_ts",
]
TOTAL_SQL = [
    "SELECT id, fruit, sum(amount * price) AS total",
    "FROM std_sold",
    "GROUP BY id, fruit",
    "ORDER BY total DESC",
]


def file_input(path: str, format: str, read_type: str = "batch", **options) -> dict:
    return {
        "type": "filestore",
        "format": format,
        "path": path,
        "read-type": read_type,
        "options": options,
    }


def given(sf_dir: str, name: str) -> dict:
    """A given table as a file source."""
    return file_input(f"{sf_dir}/{name}.parquet", "parquet")


def staging(name: str, source: dict, schema: dict, *sinks: str) -> dict:
    output = {"target": f"stg_{name}", "type": list(sinks)}
    return {"name": name, "input": source, "schema": schema, "output": output}


def sql_task(name: str, target: str, code, *sinks: str, mode: str = "batch") -> dict:
    """A task of SQL text, or of a Python callable."""
    return {
        "name": name,
        "type": mode,
        "code": code if callable(code) else {"lang": "sql", "sql": code},
        "output": {"target": target, "type": list(sinks)},
    }


def pipeline(
    spark: SparkSession, label: str, conf: dict | None = None, **layers: list
) -> Pipeline:
    """A pipeline of a name of its own, stored below the shared folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    return Pipeline(spark, {"name": name, "conf": conf or {}, **layers})


def parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def land(spark: SparkSession, df: DataFrame, format: str, path: str | None = None) -> str:
    """Write a table to a landing folder, where more can land later.

    It is spread over the cores, so that streams find several files.
    """
    path = path or scratch_dir(spark, "landing")
    df = df.repartition(parallelism(spark))
    df.write.format(format).mode("append").options(**FILE_DEFAULTS).save(path)
    return path


def batches(spark: SparkSession) -> dict[str, str]:
    """Source options that give every other core a file of a micro-batch.

    A table spread over the cores by :func:`land` makes two batches.
    """
    return {"maxFilesPerTrigger": str(max(1, parallelism(spark) // 2))}


def streaming_conf(spark: SparkSession) -> dict:
    """Streaming state keeps its number of partitions: one per core of the cluster."""
    return {"spark.sql.shuffle.partitions": parallelism(spark)}


def sales_pipeline(
    spark: SparkSession,
    sf_dir: str,
    label: str,
    mode: str = "batch",
    sold_sinks: tuple[str, ...] = ("file", "view"),
    total_sinks: tuple[str, ...] = ("table", "file"),
    staged_sinks: tuple[str, ...] = ("file", "view"),
    join_code=JOIN_SQL,
    total_code=TOTAL_SQL,
    total_output: dict | None = None,
) -> Pipeline:
    """Sales joined to the price of their time, then totalled.

    Prices are a static CSV folder.  Sales are the given table, or a landing
    folder of it read as a stream.
    """
    price_path = land(spark, prices(spark, sf_dir), "csv")
    conf = {}
    if mode == "streaming":
        lines = table(spark, sf_dir, "lineitem").select(*SALES_COLUMNS)
        path = land(spark, lines, "parquet")
        sales_input = file_input(path, "parquet", mode, **batches(spark))
        conf = streaming_conf(spark)
    else:
        sales_input = given(sf_dir, "lineitem")
    total = sql_task("total", "srv_total", total_code, *total_sinks, mode=mode)
    total["output"] |= total_output or {}
    return pipeline(
        spark,
        label,
        conf,
        staging=[
            staging("sales", sales_input, SALES_SCHEMA, *staged_sinks),
            staging("price", file_input(price_path, "csv"), PRICE_SCHEMA, "view"),
        ],
        standard=[sql_task("sold", "std_sold", join_code, *sold_sinks, mode=mode)],
        serving=[total],
    )
