"""Batch sinks, layers, views, try-runs and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.plans import preview
from tierflow.sinks import read_sink

from .documents import SALES_COLUMNS, given, pipeline, sales_pipeline, sql_task, staging
from .queries_batch import REVENUE_SQL, SOLD_SQL, rounded
from .tables import GIVEN_ORDERS_SCHEMA, SALES_SCHEMA, plain, prices, table

STATUS_SQL = """
    SELECT o_orderstatus, count(*) AS orders FROM stg_orders GROUP BY o_orderstatus"""
PRIORITY_SQL = """
    SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS dearest
    FROM stg_orders GROUP BY o_orderpriority, o_orderstatus"""


def _staged_orders(sf_dir, *sinks: str) -> dict:
    return staging("orders", given(sf_dir, "orders"), GIVEN_ORDERS_SCHEMA, *sinks)


def _output(flow, stage: str, task: str, kind: str):
    spec = flow.spec.task(stage, task)
    return read_sink(flow.spark, flow.workspace, spec, kind)


def _appended(spark, sf_dir, kind: str):
    """Orders run twice into a sink that accumulates."""
    flow = pipeline(spark, "append", staging=[_staged_orders(sf_dir, kind)])
    flow.run()
    flow.run()
    return plain(_output(flow, "staging", "orders", kind))


def _replaced(spark, sf_dir, kind: str):
    """A serving result replaced by one of another schema."""
    staged = _staged_orders(sf_dir, "view")
    flow = pipeline(
        spark,
        "overwrite",
        staging=[staged],
        serving=[
            sql_task("status", "srv_orders", STATUS_SQL, kind),
            sql_task("priority", "srv_orders", PRIORITY_SQL, kind),
        ],
    )
    flow.run()
    return _output(flow, "serving", "priority", kind)


def sink_file_append(spark, sf_dir):
    return _appended(spark, sf_dir, "file")


def sink_table_append(spark, sf_dir):
    return _appended(spark, sf_dir, "table")


def sink_append_merged(spark, sf_dir):
    """Orders, then orders with one more column, in one file sink."""
    given_orders = table(spark, sf_dir, "orders")
    runs = [given_orders, given_orders.withColumn("o_year", F.year("o_orderdate"))]
    task = sql_task("orders", "std_orders", lambda _: runs.pop(0), "file")
    task["output"]["options"] = {"mergeSchema": True}
    flow = pipeline(spark, "merged", standard=[task])
    flow.run()
    flow.run()
    return plain(_output(flow, "standard", "orders", "file"))


def sink_file_overwrite(spark, sf_dir):
    return _replaced(spark, sf_dir, "file")


def sink_table_overwrite(spark, sf_dir):
    return _replaced(spark, sf_dir, "table")


def sink_view(spark, sf_dir):
    flow = pipeline(spark, "viewed", staging=[_staged_orders(sf_dir, "view")])
    flow.run()
    return plain(spark.table("stg_orders"))


def sink_fanout(spark, sf_dir):
    """One result read back from its files, its table and its view."""
    staged = _staged_orders(sf_dir, "view")
    task = sql_task("status", "srv_status", STATUS_SQL, "table", "file", "view")
    flow = pipeline(spark, "fanout", staging=[staged], serving=[task])
    view = flow.run().relations["srv_status"]
    tagged = [
        rows.withColumn("sink", F.lit(kind))
        for kind, rows in (
            ("file", _output(flow, "serving", "status", "file")),
            ("table", _output(flow, "serving", "status", "table")),
            ("view", view),
        )
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def sink_upsert(spark, sf_dir):
    """The last order of each customer, over three loads into one sink."""
    loads = [table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == n) for n in (2, 0, 1)]
    task = sql_task("orders", "std_orders", lambda _: loads.pop(0), "file")
    task["output"] |= {"mode": "upsert", "keys": ["o_custkey"], "order": ["o_orderdate", "o_orderkey"], "buckets": 16}
    flow = pipeline(spark, "upserted", standard=[task])
    for _ in range(3):
        flow.run()
    return plain(_output(flow, "standard", "orders", "file"))


def layers_batch(spark, sf_dir):
    """All layers: stage, join to the valid price, total per part."""
    flow = sales_pipeline(spark, sf_dir, "sales")
    flow.run()
    return rounded(_output(flow, "serving", "total", "table"), 2, "total")


def layers_single_task(spark, sf_dir):
    """One standard task; the views it reads are built, not stored."""
    flow = sales_pipeline(spark, sf_dir, "single")
    flow.run(stage="standard", task="sold")
    return plain(_output(flow, "standard", "sold", "file"))


def resolve_views(spark, sf_dir):
    flow = sales_pipeline(spark, sf_dir, "resolved")
    return plain(flow.resolve("serving")["std_sold"])


def _tried(spark, sf_dir, stage: str, task: str):
    flow = sales_pipeline(spark, sf_dir, "tried", mode="streaming")
    lines = table(spark, sf_dir, "lineitem").select(*SALES_COLUMNS)
    samples = {"sales": lines, "price": prices(spark, sf_dir)}
    return flow.try_task(stage, task, samples)


def try_standard(spark, sf_dir):
    return plain(_tried(spark, sf_dir, "standard", "sold"))


def try_serving(spark, sf_dir):
    return rounded(_tried(spark, sf_dir, "serving", "total"), 2, "total")


def preview_topk(spark, sf_dir):
    """The twenty most-sold parts of a stored result."""
    text = "SELECT l_partkey AS id, sum(l_quantity) AS sold FROM stg_sales GROUP BY id"
    counted = pipeline(
        spark,
        "preview",
        staging=[staging("sales", given(sf_dir, "lineitem"), SALES_SCHEMA, "view")],
        serving=[sql_task("sold", "srv_sold", text, "file")],
    )
    counted.run()
    task = counted.spec.task("serving", "sold")
    order = (F.desc("sold"), F.asc("id"))
    return preview(spark, counted.workspace, task, order=order)


QUERIES = {
    f.__name__: f
    for f in (
        sink_file_append,
        sink_table_append,
        sink_append_merged,
        sink_upsert,
        sink_file_overwrite,
        sink_table_overwrite,
        sink_view,
        sink_fanout,
        layers_batch,
        layers_single_task,
        resolve_views,
        try_standard,
        try_serving,
        preview_topk,
    )
}

_TWICE_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders"
_DEAREST_SQL = """
    SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS dearest
    FROM orders GROUP BY o_orderpriority, o_orderstatus"""

ORACLES = {
    "sink_upsert": """
        SELECT * FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "sink_file_append": _TWICE_SQL,
    "sink_table_append": _TWICE_SQL,
    "sink_append_merged": """
        SELECT *, NULL::INTEGER AS o_year FROM orders
        UNION ALL SELECT *, year(o_orderdate)::INTEGER FROM orders""",
    "sink_file_overwrite": _DEAREST_SQL,
    "sink_table_overwrite": _DEAREST_SQL,
    "sink_view": "SELECT * FROM orders",
    "sink_fanout": """
        SELECT o_orderstatus, count(*) AS orders, sink
        FROM orders, (VALUES ('file'), ('table'), ('view')) AS s(sink)
        GROUP BY o_orderstatus, sink""",
    "layers_batch": REVENUE_SQL,
    "layers_single_task": SOLD_SQL,
    "resolve_views": SOLD_SQL,
    "try_standard": SOLD_SQL,
    "try_serving": REVENUE_SQL,
    "preview_topk": """
        SELECT l_partkey AS id, sum(l_quantity) AS sold FROM lineitem
        GROUP BY l_partkey ORDER BY sold DESC, id LIMIT 20""",
}
