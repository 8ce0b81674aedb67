"""Sources: the given tables landed in a format, then read by a typed source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tierflow.sources import decode_json, load_source
from tierflow.sources.samples import read_inferred
from tierflow.spec import SourceSpec
from tierflow.workspace import scratch_dir

from .documents import batches, file_input, land, pipeline, staging
from .tables import GIVEN_ORDERS_SCHEMA, ORDERS_SCHEMA, declared, orders, plain, table

ORDERS = StructType.fromJson(ORDERS_SCHEMA)


def _file(path: str, format: str, schema: StructType | None, **options) -> SourceSpec:
    return SourceSpec(
        kind="filestore",
        format=format,
        path=path,
        read_type="batch",
        schema=schema,
        options=options,
    )


def drained(spark: SparkSession, source: dict, schema: dict) -> DataFrame:
    """A streaming source drained into a file sink, and what it stored."""
    task = staging("stream", source, schema, "file")
    flow = pipeline(spark, "drained", staging=[task])
    flow.run()
    return flow.output("staging", "stream")


def src_csv_batch(spark, sf_dir):
    path = land(spark, orders(spark, sf_dir), "csv")
    return plain(load_source(spark, _file(path, "csv", ORDERS)))


def src_json_batch(spark, sf_dir):
    path = land(spark, orders(spark, sf_dir), "json")
    return plain(load_source(spark, _file(path, "json", ORDERS)))


def src_parquet_batch(spark, sf_dir):
    schema = StructType.fromJson(GIVEN_ORDERS_SCHEMA)
    return load_source(spark, _file(f"{sf_dir}/orders.parquet", "parquet", schema))


def src_text_batch(spark, sf_dir):
    """Lines of all documents."""
    path = land(spark, table(spark, sf_dir, "documents").select("text"), "text")
    return load_source(spark, _file(path, "text", None))


def src_options(spark, sf_dir):
    """Cells between bars, names after a blank that the reader drops."""
    customer = table(spark, sf_dir, "customer")
    blank = F.concat(F.lit(" "), "c_name").alias("c_name")
    padded = customer.select("c_custkey", blank, "c_acctbal")
    path = scratch_dir(spark, "landing")
    writer = padded.write.option("header", "true").option("sep", "|")
    writer.option("ignoreLeadingWhiteSpace", "false").csv(path)
    schema = StructType.fromJson(
        declared(c_custkey="long", c_name="string", c_acctbal="double")
    )
    options = {"sep": "|", "ignoreLeadingWhiteSpace": "true"}
    return load_source(spark, _file(path, "csv", schema, **options))


def src_file_stream(spark, sf_dir):
    path = land(spark, orders(spark, sf_dir), "json")
    source = file_input(path, "json", "streaming", **batches(spark))
    return plain(drained(spark, source, ORDERS_SCHEMA))


def src_lake_batch(spark, sf_dir):
    source = SourceSpec(
        kind="lake",
        path=f"{sf_dir}/orders.parquet",
        read_type="batch",
        schema=StructType.fromJson(GIVEN_ORDERS_SCHEMA),
    )
    return load_source(spark, source)


def src_lake_stream(spark, sf_dir):
    path = land(spark, orders(spark, sf_dir), "parquet")
    source = {
        "type": "lake",
        "path": path,
        "read-type": "Streaming",
        "options": batches(spark),
    }
    return plain(drained(spark, source, ORDERS_SCHEMA))


def src_incremental_files(spark, sf_dir):
    """Files landing between two runs are read by the second, and only once."""
    whole = orders(spark, sf_dir)
    late = F.col("o_orderstatus") == "F"
    path = land(spark, whole.where(~late), "csv")
    source = {
        "type": "incremental_files",
        "format": "csv",
        "path": path,
        "options": {"pathGlobFilter": "*.csv", **batches(spark)},
    }
    task = staging("new_files", source, ORDERS_SCHEMA, "file")
    flow = pipeline(spark, "incremental", staging=[task])
    flow.run()
    land(spark, whole.where(late), "csv", path)
    flow.run()
    return plain(flow.output("staging", "new_files"))


def src_message_decode(spark, sf_dir):
    """JSON bodies of a stream, with the id of their envelope."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    source = {
        "type": "messages",
        "format": "parquet",
        "path": land(spark, events, "parquet"),
        "options": batches(spark),
        "envelope": "event_id long, props string",
        "body": "props",
        "keep": ["event_id"],
    }
    return drained(spark, source, declared(k="integer"))


def src_incremental_archive(spark, sf_dir):
    """Orders that come in three parts; files move to an archive once they are read."""
    path = scratch_dir(spark, "landing")
    source = {"type": "incremental_files", "format": "parquet", "path": path, "archive": scratch_dir(spark, "archive")}
    flow = pipeline(spark, "archived", staging=[staging("orders", source, ORDERS_SCHEMA, "file")])
    whole = orders(spark, sf_dir)
    for part in range(3):
        land(spark, whole.where(F.col("o_orderkey") % 3 == part), "parquet", path)
        flow.run()
    flow.run()
    return plain(flow.output("staging", "orders"))


# Bodies damaged by event: cut short, of another type, without the field, or missing.
_DAMAGED = """
    CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) WHEN event_id % 11 = 0 THEN '{"k": "x"}'
         WHEN event_id % 13 = 0 THEN '{"other": 1}' WHEN event_id % 17 = 0 THEN NULL ELSE props END"""


def src_message_quarantine(spark, sf_dir):
    """Decoded messages, and those that do not decode with their body, over a restart."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{_DAMAGED} AS body")
    path = scratch_dir(spark, "messages")
    source = {
        "type": "messages",
        "format": "parquet",
        "path": path,
        "options": batches(spark),
        "envelope": "event_id long, body string",
        "keep": ["event_id"],
        "quarantine": True,
    }
    schema = {"type": "struct", "fields": [{"name": "k", "type": "integer", "nullable": False, "metadata": {}}]}
    flow = pipeline(spark, "messages", staging=[staging("messages", source, schema, "file", "view")])
    for half in (0, 1):
        land(spark, events.where(f"event_id % 2 = {half}"), "parquet", path)
        flow.run()
    flow.run()
    decoded = flow.output("staging", "messages")
    bad = flow.quarantine("messages")
    return decoded.selectExpr("event_id", "k", "CAST(NULL AS string) AS body", "CAST(NULL AS string) AS error").unionByName(
        bad.selectExpr("event_id", "CAST(NULL AS int) AS k", "_body AS body", "_error AS error")
    )


def src_object_store(spark, sf_dir):
    """A container below a shared folder in the store's place."""
    root = scratch_dir(spark, "store")
    land(spark, orders(spark, sf_dir), "csv", f"{root}/sales/2024/orders")
    source = SourceSpec(
        kind="adls_gen2",
        format="csv",
        schema=ORDERS,
        settings={
            "storage-account": "account",
            "container-name": "sales",
            "data-folder": "2024/orders",
            "root": root,
        },
    )
    return plain(load_source(spark, source))


def src_inline_sample(spark, sf_dir):
    """Rows as JSON text, typed by a declared schema."""
    line = F.to_json(F.struct("*")).alias("line")
    lines = orders(spark, sf_dir).select(line)
    return plain(decode_json(lines, "line", ORDERS))


def src_infer_sample(spark, sf_dir):
    """JSON records read without a declared schema."""
    path = land(spark, table(spark, sf_dir, "customer"), "json")
    return read_inferred(spark, path, "json")


QUERIES = {
    f.__name__: f
    for f in (
        src_csv_batch,
        src_json_batch,
        src_parquet_batch,
        src_text_batch,
        src_options,
        src_file_stream,
        src_lake_batch,
        src_lake_stream,
        src_incremental_files,
        src_incremental_archive,
        src_message_decode,
        src_message_quarantine,
        src_object_store,
        src_inline_sample,
        src_infer_sample,
    )
}

_ORDERS_SQL = "SELECT * FROM orders"

ORACLES = {
    "src_csv_batch": _ORDERS_SQL,
    "src_json_batch": _ORDERS_SQL,
    "src_parquet_batch": _ORDERS_SQL,
    "src_text_batch": r"""
        SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS value FROM documents""",
    "src_options": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "src_file_stream": _ORDERS_SQL,
    "src_lake_batch": _ORDERS_SQL,
    "src_lake_stream": _ORDERS_SQL,
    "src_incremental_files": _ORDERS_SQL,
    "src_incremental_archive": _ORDERS_SQL,
    "src_message_decode": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
    "src_message_quarantine": f"""
        WITH damaged AS (SELECT event_id, props, {_DAMAGED} AS body FROM events),
        told AS (
            SELECT *, CASE WHEN body IS NULL THEN 'no body' WHEN body = '{{"other": 1}}' THEN 'lacks k'
                           WHEN body <> props THEN 'not JSON of the declared schema' END AS error FROM damaged)
        SELECT event_id, CASE WHEN error IS NULL THEN CAST(json_extract(body, '$.k') AS INTEGER) END AS k,
               CASE WHEN error IS NOT NULL THEN body END AS body, error
        FROM told""",
    "src_object_store": _ORDERS_SQL,
    "src_inline_sample": _ORDERS_SQL,
    "src_infer_sample": """
        SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
               c_acctbal, c_mktsegment
        FROM customer""",
}
