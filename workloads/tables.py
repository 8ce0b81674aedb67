"""The given tables, shaped as the relations the pipelines work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# When prices change, and which parts get no second price.
FIRST_PRICE, SECOND_PRICE, LAST_PRICE = "1995-01-01", "1998-01-01", "2099-12-31 23:59:59"
WITHDRAWN_SIZE = 40
PRICE_FACTOR = 1.1
# Seconds of a trip, spread over its events.
TRIP_STEP, TRIP_SPAN = 37, 5400



def declared(**types: str) -> dict:
    """A schema as documents declare it: Spark's JSON form."""
    fields = [
        {"name": name, "type": kind, "nullable": True, "metadata": {}}
        for name, kind in types.items()
    ]
    return {"type": "struct", "fields": fields}


SALES_SCHEMA = declared(
    l_partkey="long", l_quantity="double", l_shipdate="timestamp_ntz"
)
PRICE_SCHEMA = declared(
    id="long",
    fruit="string",
    color="string",
    price="double",
    start_ts="timestamp",
    end_ts="timestamp",
)
GIVEN_ORDERS_SCHEMA = declared(
    o_orderkey="long",
    o_custkey="long",
    o_orderstatus="string",
    o_totalprice="double",
    o_orderdate="timestamp_ntz",
    o_orderpriority="string",
)
ORDERS_SCHEMA = declared(
    o_orderkey="long",
    o_custkey="long",
    o_orderstatus="string",
    o_totalprice="double",
    o_orderdate="timestamp",
    o_orderpriority="string",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as an instant, as file sources declare it."""
    date = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", date)


def plain(df: DataFrame) -> DataFrame:
    """Instants as wall-clock timestamps, for comparison with SQL."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales: which part, how many, when."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.col("l_quantity").alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by validity: every part has a first, all but large ones a second."""
    part = table(spark, sf_dir, "part")
    first = _price(part, F.col("p_retailprice"), FIRST_PRICE, SECOND_PRICE)
    kept = part.where(F.col("p_size") <= WITHDRAWN_SIZE)
    raised = F.col("p_retailprice") * PRICE_FACTOR
    return first.unionAll(_price(kept, raised, SECOND_PRICE, LAST_PRICE))


def _price(part: DataFrame, price, start: str, end: str) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("fruit"),
        F.col("p_brand").alias("color"),
        price.alias("price"),
        F.lit(start).cast("timestamp").alias("start_ts"),
        F.lit(end).cast("timestamp").alias("end_ts"),
    )


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with text timestamps, as raw files hold them."""
    seconds = (F.col("event_id") * TRIP_STEP % TRIP_SPAN).cast("int")
    dropoff = F.col("ts") + F.make_dt_interval(secs=seconds)
    text = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf_dir, "events").select(
        (F.col("value") / 10).alias("trip_distance"),
        F.col("value").alias("total_amount"),
        F.date_format("ts", text).alias("tpep_pickup_datetime"),
        F.date_format(dropoff, text).alias("tpep_dropoff_datetime"),
        F.col("user_id").cast("int").alias("PULocationID"),
    )


# The same relations in SQL.
PRICES_SQL = f"""
  SELECT p_partkey AS id, p_name AS fruit, p_brand AS color, p_retailprice AS price,
         TIMESTAMP '{FIRST_PRICE} 00:00:00' AS start_ts,
         TIMESTAMP '{SECOND_PRICE} 00:00:00' AS end_ts
  FROM part
  UNION ALL
  SELECT p_partkey, p_name, p_brand, p_retailprice * CAST({PRICE_FACTOR} AS DOUBLE),
         TIMESTAMP '{SECOND_PRICE} 00:00:00', TIMESTAMP '{LAST_PRICE}'
  FROM part WHERE p_size <= {WITHDRAWN_SIZE}"""

SALES_SQL = "SELECT l_partkey AS id, l_quantity AS amount, l_shipdate AS ts FROM lineitem"

RAW_TRIPS_SQL = f"""
  SELECT value / 10 AS trip_distance, value AS total_amount,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS tpep_pickup_datetime,
         strftime(ts + to_seconds(event_id * {TRIP_STEP} % {TRIP_SPAN}),
                  '%Y-%m-%d %H:%M:%S') AS tpep_dropoff_datetime,
         CAST(user_id AS INTEGER) AS PULocationID
  FROM events"""
