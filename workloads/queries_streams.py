"""Streams: append and complete sinks, restart, chained views, parity with batch."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tierflow import operators as ops
from tierflow.sinks import read_sink
from tierflow.streaming import DRAIN, EventWindows, finish, interval_join, versions_of_stream
from tierflow.streaming.versions import ROCKSDB, STATE_STORE
from tierflow.workspace import scratch_dir

from .documents import (
    batches,
    file_input,
    land,
    pipeline,
    sales_pipeline,
    sql_task,
    staging,
    streaming_conf,
)
from .queries_batch import (
    ORACLES as BATCH_SQL,
    REVENUE_SQL,
    SESSION_GAP,
    SESSION_MEASURES,
    SESSIONS_SQL,
    SOLD_SQL,
    rounded,
    watched,
)
from .tables import ORDERS_SCHEMA, declared, orders, plain, table


def _output(flow, stage: str, task: str, kind: str):
    return read_sink(flow.spark, flow.workspace, flow.spec.task(stage, task), kind)


def _orders_stream(spark, sf_dir, *sinks: str, serving=()):
    """Orders landed as files and staged as a stream."""
    path = land(spark, orders(spark, sf_dir), "json")
    source = file_input(path, "json", "streaming", **batches(spark))
    return pipeline(
        spark,
        "orders",
        streaming_conf(spark),
        staging=[staging("orders", source, ORDERS_SCHEMA, *sinks)],
        serving=list(serving),
    )


def _staged(spark, sf_dir, kind: str):
    flow = _orders_stream(spark, sf_dir, kind)
    flow.run()
    return plain(_output(flow, "staging", "orders", kind))


def _counted(spark, sf_dir, kind: str):
    text = """
        SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS dearest
        FROM stg_orders GROUP BY o_orderpriority"""
    task = sql_task("count", "srv_count", text, kind, mode="streaming")
    flow = _orders_stream(spark, sf_dir, "view", serving=[task])
    flow.run()
    return _output(flow, "serving", "count", kind)


def stream_dedup(spark, sf_dir):
    """Events landed twice, each kept once while the watermark remembers it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    path = land(spark, events, "parquet")
    land(spark, events, "parquet", path)
    schema = events.schema.jsonValue()
    source = file_input(path, "parquet", "streaming")

    def once(session):
        return ops.latest_stream(
            session.table("stg_events"), ["event_id"], "ts", "3650 days"
        )

    flow = pipeline(
        spark,
        "once",
        streaming_conf(spark),
        staging=[staging("events", source, schema, "view")],
        standard=[sql_task("once", "std_events", once, "file", mode="streaming")],
    )
    flow.run()
    return plain(_output(flow, "standard", "once", "file"))


EVENT_SCHEMA = declared(event_id="long", user_id="long", ts="timestamp", value="double")
#: Events before and after this come in two runs.
SPLIT = "2024-01-15"


def _instants(spark, sf_dir, *kinds: str):
    """Events of some types with their time as an instant."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.where(F.col("event_type").isin(*kinds)) if kinds else events
    return events.select("event_id", "user_id", "ts", "value")


def _heartbeat(spark, days: int):
    """A row of no event, so many days after all events: it moves the watermark on.

    It has a user of its own, as a join drops rows without a key before it sees their time.
    """
    return spark.sql(
        "SELECT CAST(NULL AS bigint) AS event_id, -1L AS user_id, "
        f"timestamp'2100-01-01' + INTERVAL {days} DAYS AS ts, CAST(NULL AS double) AS value"
    )


def _event_source(name: str, path: str, delay: str):
    source = file_input(path, "parquet", "streaming") | {"watermark": {"column": "ts", "delay": delay}}
    return staging(name, source, EVENT_SCHEMA, "view")


def stream_stream_join(spark, sf_dir):
    """Errors with their user's clicks of six hours before, both as streams, over a restart."""
    kinds = {"errors": "error", "clicks": "click"}
    paths = {name: scratch_dir(spark, name) for name in kinds}
    begins = F.col("ts") >= F.lit(SPLIT).cast("timestamp")

    def joined(session):
        clicks = session.table("stg_clicks").select(
            "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")
        )
        errors = session.table("stg_errors").select("event_id", "user_id", "ts")
        within = (timedelta(hours=-6), timedelta(0))
        return interval_join(errors, clicks, "user_id", ("ts", "click_ts"), within, "left")

    flow = pipeline(
        spark,
        "joined",
        streaming_conf(spark),
        staging=[_event_source(name, path, "1 hour") for name, path in paths.items()],
        standard=[sql_task("joined", "std_joined", joined, "file", mode="streaming")],
    )
    # rows of a heartbeat move the watermark, the run after them releases what it passed
    for part in (~begins, begins, 0, 1):
        for name, kind in kinds.items():
            heartbeat = isinstance(part, int)
            rows = _heartbeat(spark, part) if heartbeat else _instants(spark, sf_dir, kind).where(part)
            land(spark, rows, "parquet", paths[name])
        flow.run()
    return plain(_output(flow, "standard", "joined", "file")).where("event_id IS NOT NULL")


#: Events that come after all others, and how late rows may be.
STRAGGLERS, DELAY = "event_id % 50 = 7", timedelta(days=2)


def _windows(spark, sf_dir, **lengths) -> EventWindows:
    """Events counted in windows by user group; stragglers come last, then a heartbeat closes all."""
    counted = {"events": ("sum", "1L"), "most": ("max", "value"), "first_event": ("min", "event_id")}
    windows = EventWindows(
        spark, scratch_dir(spark, "windows"), "ts", counted, delay=DELAY, keys=["user_group"], buckets=16, **lengths
    )
    begins = F.col("ts") >= F.lit(SPLIT).cast("timestamp")
    events = _instants(spark, sf_dir)
    usual = events.where(f"NOT ({STRAGGLERS})")
    path = scratch_dir(spark, "events")
    for rows in (usual.where(~begins), usual.where(begins), events.where(STRAGGLERS), _heartbeat(spark, 0)):
        land(spark, rows, "parquet", path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        finish([windows.start(stream.withColumn("user_group", F.col("user_id") % 4), DRAIN)])
    return windows


def stream_windows(spark, sf_dir):
    """Closed tumbling windows of six hours."""
    return plain(_windows(spark, sf_dir, size=timedelta(hours=6)).closed())


def stream_windows_sliding(spark, sf_dir):
    """Closed windows of a day, one every six hours."""
    return plain(_windows(spark, sf_dir, size=timedelta(hours=24), slide=timedelta(hours=6)).closed())


def stream_windows_late(spark, sf_dir):
    """The stragglers that came after their window had closed."""
    late = _windows(spark, sf_dir, size=timedelta(hours=6)).late()
    return plain(late.select("event_id", "ts", "window_start"))


def stream_sessions(spark, sf_dir):
    """The sessions of the same events as a stream, open ones kept in state over a restart."""
    path = scratch_dir(spark, "events")
    source = _event_source("events", path, "10 minutes")

    def found(session):
        events = session.table("stg_events")
        return ops.sessions(events, "user_id", "ts", SESSION_GAP, SESSION_MEASURES)

    flow = pipeline(
        spark,
        "sessions",
        streaming_conf(spark),
        staging=[source],
        standard=[sql_task("sessions", "std_sessions", found, "file", mode="streaming")],
    )
    events = watched(_instants(spark, sf_dir))
    begins = F.col("ts") >= F.lit(SPLIT).cast("timestamp")
    for rows in (events.where(~begins), events.where(begins), _heartbeat(spark, 0), _heartbeat(spark, 1)):
        land(spark, rows, "parquet", path)
        flow.run()
    return plain(_output(flow, "standard", "sessions", "file")).where("user_id >= 0")


def stream_versions(spark, sf_dir):
    """Versions of each customer from orders that come in any order, over a restart."""
    whole = orders(spark, sf_dir).select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice", "o_orderdate")
    path = scratch_dir(spark, "orders")
    source = file_input(path, "parquet", "streaming", **batches(spark))

    def versions(session):
        return versions_of_stream(session.table("stg_orders"), "id", "o_orderdate", order=["o_orderkey"])

    task = sql_task("versions", "std_versions", versions, "file", mode="streaming")
    task["output"] |= {"mode": "upsert", "keys": ["id", "start_ts"], "buckets": 8}
    flow = pipeline(
        spark,
        "versions",
        streaming_conf(spark) | {STATE_STORE: ROCKSDB},
        staging=[staging("orders", source, whole.schema.jsonValue(), "view")],
        standard=[task],
    )
    for part in (F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") % 2 == 0):
        land(spark, whole.where(part), "parquet", path)
        flow.run()
    flow.run()
    return plain(_output(flow, "standard", "versions", "file"))


def sink_stream_file_append(spark, sf_dir):
    return _staged(spark, sf_dir, "file")


def sink_stream_table_append(spark, sf_dir):
    return _staged(spark, sf_dir, "table")


def sink_stream_file_complete(spark, sf_dir):
    return _counted(spark, sf_dir, "file")


def sink_stream_table_complete(spark, sf_dir):
    return _counted(spark, sf_dir, "table")


def _join_valid_price(spark):
    """Task code: the temporal join operator over the staged views."""
    sales = spark.table("stg_sales").withColumn(
        "ts", F.col("l_shipdate").cast("timestamp")
    )
    joined = ops.temporal_left_join(
        sales,
        spark.table("stg_price"),
        on=("l_partkey", "id"),
        at="ts",
        valid=("start_ts", "end_ts"),
    )
    return joined.select(
        "version.fruit",
        "version.id",
        F.col("fact.l_quantity").alias("amount"),
        "version.price",
        "fact.ts",
    )


def _total_by_part(spark):
    """Task code: revenue per part, greatest first."""
    return ops.revenue_by(spark.table("std_sold"), ["id", "fruit"], "amount", "price")


def stream_temporal_join(spark, sf_dir):
    """Streaming sales against static prices, by the operator."""
    flow = sales_pipeline(
        spark,
        sf_dir,
        "stream_join",
        mode="streaming",
        staged_sinks=("view",),
        sold_sinks=("file",),
        join_code=_join_valid_price,
    )
    flow.run(stage="standard")
    return plain(_output(flow, "standard", "sold", "file"))


def stream_revenue_complete(spark, sf_dir):
    """A sorted streaming aggregate, replaced with every micro-batch."""
    flow = sales_pipeline(
        spark,
        sf_dir,
        "stream_total",
        mode="streaming",
        staged_sinks=("view",),
        sold_sinks=("view",),
        total_sinks=("file",),
        join_code=_join_valid_price,
        total_code=_total_by_part,
    )
    flow.run(stage="serving")
    return rounded(_output(flow, "serving", "total", "file"), 2, "total")


def stream_revenue_merged(spark, sf_dir):
    """The same totals, folded into the groups each micro-batch touches; no state is kept."""
    flow = sales_pipeline(
        spark,
        sf_dir,
        "stream_merged",
        mode="streaming",
        staged_sinks=("view",),
        sold_sinks=("view",),
        total_sinks=("file",),
        join_code=_join_valid_price,
        total_code="SELECT id, fruit, amount * price AS total FROM std_sold",
        total_output={"mode": "merge", "keys": ["id", "fruit"], "merge": {"total": "sum"}, "buckets": 8},
    )
    flow.run(stage="serving")
    return rounded(_output(flow, "serving", "total", "file"), 2, "total")


def stream_counts_upserted(spark, sf_dir):
    """A streaming aggregate whose changed groups replace those held, over a restart."""
    whole = orders(spark, sf_dir)
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    path = land(spark, whole.where(~late), "parquet")
    source = file_input(path, "parquet", "streaming", **batches(spark))
    text = """
        SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS dearest
        FROM stg_orders GROUP BY o_custkey"""
    task = sql_task("count", "srv_count", text, "file", mode="streaming")
    task["output"] |= {"mode": "upsert", "keys": ["o_custkey"], "buckets": 8}
    flow = pipeline(
        spark,
        "counted",
        streaming_conf(spark),
        staging=[staging("orders", source, ORDERS_SCHEMA, "view")],
        serving=[task],
    )
    flow.run()
    land(spark, whole.where(late), "parquet", path)
    flow.run()
    flow.run()
    return _output(flow, "serving", "count", "file")


def stream_view_chain(spark, sf_dir):
    """Serving SQL reads a streaming view over a streaming view."""
    flow = sales_pipeline(
        spark,
        sf_dir,
        "view_chain",
        mode="streaming",
        staged_sinks=("view",),
        sold_sinks=("view",),
        total_sinks=("table",),
    )
    flow.run()
    return rounded(_output(flow, "serving", "total", "table"), 2, "total")


def layers_streaming(spark, sf_dir):
    """All layers as streams, every layer stored."""
    flow = sales_pipeline(spark, sf_dir, "streaming", mode="streaming")
    flow.run()
    return rounded(_output(flow, "serving", "total", "table"), 2, "total")


def stream_batch_parity(spark, sf_dir):
    """Totals of the same documents run as a stream and as a batch."""
    results = []
    for mode in ("batch", "streaming"):
        flow = sales_pipeline(
            spark,
            sf_dir,
            mode,
            mode=mode,
            staged_sinks=("view",),
            sold_sinks=("view",),
            total_sinks=("file",),
        )
        flow.run()
        total = rounded(_output(flow, "serving", "total", "file"), 2, "total")
        results.append(total.withColumn("mode", F.lit(mode)))
    return results[0].unionByName(results[1])


def stream_restart(spark, sf_dir):
    """Each order once, over a run, a run with more files, and a run with none."""
    whole = orders(spark, sf_dir)
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    path = land(spark, whole.where(~late), "parquet")
    source = file_input(path, "parquet", "streaming", **batches(spark))
    task = staging("orders", source, ORDERS_SCHEMA, "file", "table")
    flow = pipeline(spark, "restart", staging=[task])
    flow.run()
    land(spark, whole.where(late), "parquet", path)
    flow.run()
    flow.run()
    kinds = [
        plain(_output(flow, "staging", "orders", kind)).withColumn("sink", F.lit(kind))
        for kind in ("file", "table")
    ]
    return kinds[0].unionByName(kinds[1])


QUERIES = {
    f.__name__: f
    for f in (
        stream_dedup,
        sink_stream_file_append,
        sink_stream_table_append,
        sink_stream_file_complete,
        sink_stream_table_complete,
        stream_temporal_join,
        stream_stream_join,
        stream_versions,
        stream_sessions,
        stream_windows,
        stream_windows_sliding,
        stream_windows_late,
        stream_revenue_complete,
        stream_revenue_merged,
        stream_counts_upserted,
        stream_view_chain,
        layers_streaming,
        stream_batch_parity,
        stream_restart,
    )
}

_COUNT_SQL = """
    SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS dearest
    FROM orders GROUP BY o_orderpriority"""



def _windows_sql(starts: str, hours: int, select: str) -> str:
    """Rows with each of their windows, in time or late by the watermark of the usual events."""
    return f"""
        WITH paired AS (
            SELECT *, user_id % 4 AS user_group, time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * back) AS window_start
            FROM events, unnest({starts}) AS t(back)),
        judged AS (
            SELECT *, window_start + INTERVAL {hours} HOURS AS window_end,
                   NOT ({STRAGGLERS}) OR window_start + INTERVAL {hours} HOURS >
                       (SELECT max(ts) FROM events WHERE NOT ({STRAGGLERS})) - INTERVAL {DELAY.days} DAYS AS in_time
            FROM paired)
        {select}"""


_CLOSED = """
        SELECT window_start, window_end, user_group, count(*) AS events, max(value) AS most, min(event_id) AS first_event
        FROM judged WHERE in_time GROUP BY ALL"""

ORACLES = {
    "stream_dedup": "SELECT event_id, user_id, ts, value FROM events",
    "sink_stream_file_append": "SELECT * FROM orders",
    "sink_stream_table_append": "SELECT * FROM orders",
    "sink_stream_file_complete": _COUNT_SQL,
    "sink_stream_table_complete": _COUNT_SQL,
    "stream_temporal_join": SOLD_SQL,
    "stream_stream_join": """
        SELECT e.event_id, e.user_id, e.ts, c.event_id AS click_id, c.ts AS click_ts
        FROM (SELECT * FROM events WHERE event_type = 'error') e
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
          ON c.user_id = e.user_id AND c.ts BETWEEN e.ts - INTERVAL 6 HOURS AND e.ts""",
    "stream_revenue_complete": REVENUE_SQL,
    "stream_versions": BATCH_SQL["versions_from_changes"],
    "stream_sessions": SESSIONS_SQL,
    "stream_windows": _windows_sql("[0]", 6, _CLOSED),
    "stream_windows_sliding": _windows_sql("[0, 1, 2, 3]", 24, _CLOSED),
    "stream_windows_late": _windows_sql("[0]", 6, "SELECT event_id, ts, window_start FROM judged WHERE NOT in_time"),
    "stream_revenue_merged": REVENUE_SQL,
    "stream_counts_upserted": """
        SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY o_custkey""",
    "stream_view_chain": REVENUE_SQL,
    "layers_streaming": REVENUE_SQL,
    "stream_batch_parity": f"""
        SELECT r.*, mode
        FROM ({REVENUE_SQL}) r, (VALUES ('batch'), ('streaming')) AS m(mode)""",
    "stream_restart": """
        SELECT o.*, sink FROM orders o, (VALUES ('file'), ('table')) AS s(sink)""",
}
