"""Projections, predicates, joins, aggregates, scalar functions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow import functions as fn
from tierflow import operators as ops
from tierflow.operators.percentiles import ACCURACY, LOWER, UPPER
from tierflow.plans import run_code, scoped_views
from tierflow.spec import CodeSpec, SinkSpec, TaskSpec
from tierflow.workspace import scratch_dir

from .tables import (
    PRICES_SQL,
    RAW_TRIPS_SQL,
    SALES_SQL,
    plain,
    prices,
    raw_trips,
    sales,
    table,
)

# --- shared shapes ---------------------------------------------------------


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the price valid when they happened."""
    joined = ops.temporal_left_join(
        sales(spark, sf_dir),
        prices(spark, sf_dir),
        on=("id", "id"),
        at="ts",
        valid=("start_ts", "end_ts"),
    )
    return joined.select(
        "version.fruit", "version.id", "fact.amount", "version.price", "fact.ts"
    )


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written once, so several readers share the work."""
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, ops.derive_trips(raw_trips(spark, sf_dir)), "trips")


def code_task(name: str, **code) -> TaskSpec:
    return TaskSpec(
        name=name,
        stage="standard",
        sink=SinkSpec(target=name, kinds=("view",)),
        code=CodeSpec(**code),
    )


def run_sql(spark: SparkSession, text: str, **relations: DataFrame) -> DataFrame:
    """A SQL task over named relations."""
    with scoped_views(spark, relations):
        return run_code(spark, code_task("sql", lang="sql", text=text))


SOLD_SQL = f"""
  WITH sales AS ({SALES_SQL}), price AS ({PRICES_SQL})
  SELECT price.fruit, price.id, sales.amount, price.price, sales.ts
  FROM sales LEFT JOIN price
    ON sales.id = price.id AND sales.ts >= price.start_ts AND sales.ts < price.end_ts"""

REVENUE_SQL = f"""
  SELECT id, fruit, round(sum(amount * price), 2) AS total
  FROM ({SOLD_SQL}) GROUP BY id, fruit"""

_EPOCH = "epoch(strptime({}, '%Y-%m-%d %H:%M:%S'))"
_DURATION = (
    f"CAST({_EPOCH.format('tpep_dropoff_datetime')}"
    f" - {_EPOCH.format('tpep_pickup_datetime')} AS BIGINT)"
)
_PICKUP = "strptime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S')"


def _round2(expression: str) -> str:
    """HALF_UP on the decimal text of a double."""
    text = f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 20))"
    return f"CAST(round({text}, 2) AS DOUBLE)"


_SPEED = _round2(f"trip_distance / nullif({_DURATION}, 0) * 3600")

STD1_SQL = f"""
  SELECT trip_distance, total_amount,
         CAST({_PICKUP} AS DATE) AS pickup_date,
         {_DURATION} AS trip_duration,
         {_SPEED} AS speed,
         strftime({_PICKUP}, '%Y-%m-%d %H:%M:00') AS pickup_date_time,
         CAST(hour({_PICKUP}) AS INTEGER) AS pickup_hour,
         CAST(minute({_PICKUP}) AS INTEGER) AS pickup_minute,
         CAST(floor(minute({_PICKUP}) / 10) AS BIGINT) AS pickup_timeslot,
         PULocationID AS pickup_loc
  FROM ({RAW_TRIPS_SQL}) WHERE trip_distance > 0"""

_BOUNDED = ("trip_distance", "speed", "total_amount")
_BOUNDS_SQL = ", ".join(
    f"quantile_disc({c}, {p}) AS {c}_{side}_bound"
    for c in _BOUNDED
    for side, p in (("lower", 0.001), ("upper", 0.999))
)
_WITHIN_SQL = " AND ".join(
    f"{c} BETWEEN {c}_lower_bound AND {c}_upper_bound" for c in _BOUNDED
)
BOUNDS_SQL = f"SELECT {_BOUNDS_SQL} FROM ({STD1_SQL})"
TRIM_SQL = f"""
  WITH t AS ({STD1_SQL}), b AS (SELECT {_BOUNDS_SQL} FROM t)
  SELECT t.* FROM t, b WHERE {_WITHIN_SQL}"""
STD2_SQL = f"""{TRIM_SQL}
    AND trip_duration > 0 AND trip_duration < 259200 AND speed > 0 AND total_amount > 0"""


def summary_sql(source: str) -> str:
    measures = ", ".join(
        f"{sum_} AS sum_{label}, min({c}) AS min_{label}, max({c}) AS max_{label}"
        for c, label, sum_ in (
            ("trip_duration", "trip_duration", "CAST(sum(trip_duration) AS BIGINT)"),
            ("trip_distance", "trip_distance", "round(sum(trip_distance), 4)"),
            ("total_amount", "trip_fare_amount", "round(sum(total_amount), 4)"),
        )
    )
    return f"""
  SELECT pickup_date, pickup_loc, pickup_hour, pickup_minute, pickup_timeslot,
         pickup_date_time, trip_distance > 15 AS long_distance,
         count(*) AS pickup_count, {measures},
         min(speed) AS min_speed, max(speed) AS max_speed,
         round(avg(speed), 6) AS avg_speed
  FROM ({source}) GROUP BY ALL"""


def curation_sql(source: str) -> str:
    return f"""
  SELECT pickup_date, pickup_loc, long_distance,
         CAST(sum(pickup_count) AS BIGINT) AS pickup_count,
         CAST(sum(sum_trip_duration) AS BIGINT) AS sum_trip_duration,
         round(sum(sum_trip_distance), 4) AS sum_trip_distance,
         round(sum(sum_trip_fare_amount), 4) AS sum_trip_fare_amount
  FROM ({source}) GROUP BY ALL"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles, freed of the order they were added in."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


SUMMED = ("sum_trip_distance", "sum_trip_fare_amount")


# --- queries ---------------------------------------------------------------


def temporal_left_join(spark, sf_dir):
    return plain(sold(spark, sf_dir))


def revenue_by_key(spark, sf_dir):
    total = ops.revenue_by(sold(spark, sf_dir), ["id", "fruit"], "amount", "price")
    return rounded(total, 2, "total")


def sort_desc(spark, sf_dir):
    part = ops.summarize(
        table(spark, sf_dir, "lineitem"), ["l_partkey"], {"total": F.sum("l_quantity")}
    )
    return part.orderBy(F.desc("total"))


def task_sql(spark, sf_dir):
    text = """
        SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS dearest
        FROM orders
        GROUP BY o_orderpriority"""
    return run_sql(spark, text, orders=table(spark, sf_dir, "orders"))


def task_python(spark, sf_dir):
    text = "\n".join(
        [
            "from pyspark.sql import functions as F",
            "suppliers = spark.table('supplier').alias('s')",
            "output_df = suppliers.groupBy('s_nationkey').agg(",
            "    F.count('*').alias('suppliers'), F.max('s_acctbal').alias('best'))",
        ]
    )
    with scoped_views(spark, {"supplier": table(spark, sf_dir, "supplier")}):
        return run_code(spark, code_task("balances", lang="python", text=text))


def project_alias(spark, sf_dir):
    text = "SELECT c.C_CUSTKEY AS id, c.c_name AS Name, c.C_AcctBal AS balance FROM customer c"
    return run_sql(spark, text, customer=table(spark, sf_dir, "customer"))


def filter_predicate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where(F.col("value") > 10).select("event_id", "user_id", "value")


def filter_between(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    within = F.col("l_quantity").between(
        F.col("l_tax") * 100, F.col("l_discount") * 500
    ) & F.col("l_extendedprice").between(1000, 50000)
    return lineitem.where(within).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


def project_boolean(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") > 15).alias("large")
    )


def cte(spark, sf_dir):
    text = """
        WITH spent AS (
            SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS orders
            FROM orders GROUP BY o_custkey
        )
        SELECT orders AS order_count, count(*) AS customers,
               round(max(total), 2) AS most_spent
        FROM spent GROUP BY orders"""
    return run_sql(spark, text, orders=table(spark, sf_dir, "orders"))


def qualified_star(spark, sf_dir):
    text = "SELECT o.* FROM orders o WHERE o.o_totalprice > 100000"
    return run_sql(spark, text, orders=table(spark, sf_dir, "orders"))


def outlier_trim(spark, sf_dir):
    rides = trips(spark, sf_dir)
    bounds = ops.exact_percentile_bounds(rides, _BOUNDED)
    return ops.trim_outliers(rides, bounds, _BOUNDED)


def percentile_bounds(spark, sf_dir):
    return ops.exact_percentile_bounds(trips(spark, sf_dir), _BOUNDED)


def percentile_bounds_narrowed(spark, sf_dir):
    """The same bounds by narrowing intervals, as large tables need it."""
    rides = trips(spark, sf_dir)
    return ops.exact_percentile_bounds(rides, _BOUNDED, sketch_size=512, window_rows=100)


def percentile_bounds_approx(spark, sf_dir):
    """Approximate bounds, each with whether its rank is as near as promised.

    ``rows / accuracy`` off at most; a rank is a range where values repeat.
    """
    rides = trips(spark, sf_dir)
    bounds = ops.percentile_bounds(rides, _BOUNDED)
    shares = (("lower", LOWER), ("upper", UPPER))
    sought = [(f"{c}_{side}_bound", c, share) for c in _BOUNDED for side, share in shares]
    placed, columns = {}, []
    for name, column, share in sought:
        bound = bounds.select(name).scalar()
        placed[f"{name}_under"] = F.col(column) < bound
        placed[f"{name}_upto"] = F.col(column) <= bound
        rows = F.count(column)
        rank, slack = rows * share, rows / ACCURACY + 1
        first, last = F.count_if(f"{name}_under") + 1, F.count_if(f"{name}_upto")
        columns.append(((first <= rank + slack) & (last >= rank - slack)).alias(name))
    near = rides.withColumns(placed).agg(*columns)
    return near.unpivot([], [name for name, *_ in sought], "bound", "near")


def dedup_latest(spark, sf_dir):
    """The last order of every customer."""
    return ops.latest(
        table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]
    )


def versions_from_changes(spark, sf_dir):
    """What every customer paid last, as versions between two orders."""
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return ops.versions_from_changes(changes, "id", "o_orderdate", order=["o_orderkey"])


def multi_agg(spark, sf_dir):
    measures = {
        "sum_qty": F.sum("l_quantity"),
        "min_price": F.min("l_extendedprice"),
        "max_price": F.max("l_extendedprice"),
        "avg_qty": F.avg("l_quantity"),
    }
    large = (F.col("l_quantity") > 15).alias("large")
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", large]
    lineitem = table(spark, sf_dir, "lineitem")
    return ops.summarize(lineitem, keys, measures, rows="line_count")


def group_by_alias(spark, sf_dir):
    text = """
        SELECT value > 15 AS expensive, event_type, count(*) AS events
        FROM events GROUP BY expensive, event_type"""
    return run_sql(spark, text, events=table(spark, sf_dir, "events"))


def reaggregate(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    finer = ops.summarize(
        lineitem,
        ["l_suppkey", "l_returnflag", "l_linestatus"],
        {"sum_qty": F.sum("l_quantity")},
        rows="line_count",
    )
    return ops.roll_up(finer, ["l_suppkey"], ["line_count", "sum_qty"])


def fn_to_date(spark, sf_dir):
    raw = raw_trips(spark, sf_dir)
    return raw.select(
        "tpep_pickup_datetime", fn.to_day("tpep_pickup_datetime").alias("pickup_date")
    )


def fn_duration(spark, sf_dir):
    pickup, dropoff = "tpep_pickup_datetime", "tpep_dropoff_datetime"
    return raw_trips(spark, sf_dir).select(
        pickup,
        dropoff,
        fn.unix_seconds(pickup).alias("pickup_seconds"),
        fn.duration_seconds(pickup, dropoff).alias("trip_duration"),
    )


def fn_minute_text(spark, sf_dir):
    pickup = "tpep_pickup_datetime"
    return raw_trips(spark, sf_dir).select(
        pickup, fn.minute_text(pickup).alias("pickup_date_time")
    )


def fn_hour_minute(spark, sf_dir):
    pickup = "tpep_pickup_datetime"
    return raw_trips(spark, sf_dir).select(
        pickup,
        fn.hour_of(pickup).alias("pickup_hour"),
        fn.minute_of(pickup).alias("pickup_minute"),
    )


def fn_timeslot(spark, sf_dir):
    pickup = "tpep_pickup_datetime"
    return raw_trips(spark, sf_dir).select(
        pickup, fn.time_slot(pickup).alias("pickup_timeslot")
    )


def fn_speed(spark, sf_dir):
    duration = fn.duration_seconds("tpep_pickup_datetime", "tpep_dropoff_datetime")
    return raw_trips(spark, sf_dir).select(
        "trip_distance",
        "tpep_pickup_datetime",
        fn.speed_per_hour("trip_distance", duration).alias("speed"),
    )


def fn_safe_divide(spark, sf_dir):
    """Some discounts are zero, so their quotient is NULL."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        fn.safe_divide("l_quantity", "l_discount").alias("quantity_per_discount"),
    )


def taxi_std1(spark, sf_dir):
    return ops.derive_trips(raw_trips(spark, sf_dir))


def taxi_std2(spark, sf_dir):
    return ops.trim_trips(trips(spark, sf_dir))


def _taxi_summary(spark, sf_dir):
    return ops.summarize_trips(taxi_std2(spark, sf_dir))


def taxi_std3(spark, sf_dir):
    summary = rounded(_taxi_summary(spark, sf_dir), 4, *SUMMED)
    return rounded(summary, 6, "avg_speed")


def taxi_serving(spark, sf_dir):
    return rounded(ops.curate_trips(_taxi_summary(spark, sf_dir)), 4, *SUMMED)


# --- as-of joins -----------------------------------------------------------


def _errors_and_clicks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"), "value"
    )
    return errors, clicks


def asof_join(spark, sf_dir):
    """Every error with the last click of its user before it."""
    errors, clicks = _errors_and_clicks(spark, sf_dir)
    return ops.asof_join(errors, clicks, "user_id", ("ts", "click_ts"), order=["click_id"])


def asof_join_nearest(spark, sf_dir):
    """Every sale with the order of the part's supplier nearest in time, a week away at most."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    ordered = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("l_suppkey"), "o_orderkey", "o_orderdate"
    )
    return ops.asof_join(
        lines, ordered, "l_suppkey", ("l_shipdate", "o_orderdate"),
        order=["o_orderkey"], direction="nearest", tolerance="7 days", equal=False,
    )


ASOF_SQL = """
  WITH errors AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
  clicks AS (
    SELECT user_id, event_id AS click_id, ts AS click_ts, value FROM events WHERE event_type = 'click'
    QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
  SELECT event_id, errors.user_id, ts, click_id, click_ts, value
  FROM errors ASOF LEFT JOIN clicks ON errors.user_id = clicks.user_id AND errors.ts >= clicks.click_ts"""

NEAREST_SQL = """
  WITH lines AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM lineitem),
  points AS (SELECT DISTINCT l_suppkey, l_shipdate FROM lines),
  ordered AS (
    SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1),
  near AS (
    SELECT l_suppkey, l_shipdate, o_orderkey, o_orderdate FROM points JOIN ordered ON o_custkey = l_suppkey
     AND o_orderdate <> l_shipdate
     AND o_orderdate BETWEEN l_shipdate - INTERVAL 7 DAYS AND l_shipdate + INTERVAL 7 DAYS
    QUALIFY row_number() OVER (
      PARTITION BY l_suppkey, l_shipdate
      ORDER BY abs(epoch_us(o_orderdate) - epoch_us(l_shipdate)), o_orderdate) = 1)
  SELECT lines.*, o_orderkey, o_orderdate FROM lines LEFT JOIN near USING (l_suppkey, l_shipdate)"""


# --- sessions ----------------------------------------------------------------

SESSION_GAP = timedelta(minutes=30)
# Rows of a key after which its time is cut; low, so that the hot user's is.
SESSION_SLOT_ROWS = 500
SESSION_MEASURES = {"events": ("sum", "1L"), "most": ("max", "value"), "first_event": ("min", "event_id")}


def watched(events):
    """Events by user; a third of all are of user 0."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    return events.select("event_id", user.alias("user_id"), "ts", "value")


def sessions(spark, sf_dir):
    """Events of a user at most half an hour apart, the hot user's time in slots."""
    events = watched(table(spark, sf_dir, "events"))
    return plain(ops.sessions(events, "user_id", "ts", SESSION_GAP, SESSION_MEASURES, slot_rows=SESSION_SLOT_ROWS))


SESSIONS_SQL = """
  WITH watched AS (
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, ts, value FROM events),
  cut AS (
    SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTES, true) AS begins
    FROM watched WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM cut)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end,
         count(*) AS events, max(value) AS most, min(event_id) AS first_event
  FROM numbered GROUP BY user_id, n"""


# --- totals at many levels ---------------------------------------------------


def running_total(spark, sf_dir):
    """Cents and orders up to the day of each order."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", cents.alias("cents"), F.lit(1).cast("bigint").alias("one"))
    return ops.running_total(rows, "o_orderdate", {"cents_so_far": "cents", "orders_so_far": "one"}).drop("one")


def running_total_by_key(spark, sf_dir):
    """Quantity of each return flag up to the day of each line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity")
    return ops.running_total(rows, "l_shipdate", {"quantity_so_far": "l_quantity"}, keys=["l_returnflag"])


_CUBED = {"lines": ("sum", "1L"), "quantity": ("sum", "l_quantity"), "dearest": ("max", "l_extendedprice")}
_DIMENSIONS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


def cube_lattice(spark, sf_dir):
    """Lines by every subset of four columns, each level from its smallest parent."""
    return ops.cube(table(spark, sf_dir, "lineitem"), _DIMENSIONS, _CUBED)


def rollup_lattice(spark, sf_dir):
    return ops.rollup(table(spark, sf_dir, "lineitem"), _DIMENSIONS, _CUBED)


def distinct_rollup(spark, sf_dir):
    """Different users and values of each event type, exactly; a third of all rows are of one type."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("kind")
    rows = events.select(kind, "user_id", "value")
    users = ops.distinct_counts(rows, ["kind"], "user_id", "users")
    return users.join(ops.distinct_counts(rows, ["kind"], "value", "amounts"), "kind")


def distinct_rollup_sketched(spark, sf_dir):
    """Whether sketches per day and type, united per type, are within three standard errors."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = stored(spark, ops.distinct_sketches(events, ["event_type", "day"], "event_id"), "sketches")
    counts = ops.estimated(ops.rolled_up(daily, ["event_type"]))
    exact = ops.distinct_counts(events, ["event_type"], "event_id", "exact")
    off = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 3 * 1.04 / 2**6
    return counts.join(exact, "event_type").select("event_type", off.alias("near"))


_LEVELS_SQL = """
        SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) AS lines,
               sum(l_quantity) AS quantity, max(l_extendedprice) AS dearest,
               GROUPING(l_returnflag, l_linestatus, l_linenumber, l_suppkey)::INTEGER AS level
        FROM lineitem GROUP BY {kind}(l_returnflag, l_linestatus, l_linenumber, l_suppkey)"""


QUERIES = {
    f.__name__: f
    for f in (
        temporal_left_join,
        revenue_by_key,
        sort_desc,
        task_sql,
        task_python,
        project_alias,
        filter_predicate,
        filter_between,
        project_boolean,
        cte,
        qualified_star,
        outlier_trim,
        percentile_bounds,
        percentile_bounds_narrowed,
        percentile_bounds_approx,
        dedup_latest,
        versions_from_changes,
        asof_join,
        asof_join_nearest,
        sessions,
        running_total,
        running_total_by_key,
        cube_lattice,
        rollup_lattice,
        distinct_rollup,
        distinct_rollup_sketched,
        multi_agg,
        group_by_alias,
        reaggregate,
        fn_to_date,
        fn_duration,
        fn_minute_text,
        fn_hour_minute,
        fn_timeslot,
        fn_speed,
        fn_safe_divide,
        taxi_std1,
        taxi_std2,
        taxi_std3,
        taxi_serving,
    )
}

ORACLES = {
    "temporal_left_join": SOLD_SQL,
    "revenue_by_key": REVENUE_SQL,
    "sort_desc": """
        SELECT l_partkey, sum(l_quantity) AS total FROM lineitem
        GROUP BY l_partkey ORDER BY total DESC""",
    "task_sql": """
        SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS dearest
        FROM orders GROUP BY o_orderpriority""",
    "task_python": """
        SELECT s_nationkey, count(*) AS suppliers, max(s_acctbal) AS best
        FROM supplier GROUP BY s_nationkey""",
    "project_alias": """
        SELECT c_custkey AS id, c_name AS "Name", c_acctbal AS balance FROM customer""",
    "filter_predicate": "SELECT event_id, user_id, value FROM events WHERE value > 10",
    "filter_between": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
        WHERE l_quantity BETWEEN l_tax * 100 AND l_discount * 500
          AND l_extendedprice BETWEEN 1000 AND 50000""",
    "project_boolean": """
        SELECT l_orderkey, l_linenumber, l_quantity > 15 AS large FROM lineitem""",
    "cte": """
        WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS orders
                       FROM orders GROUP BY o_custkey)
        SELECT orders AS order_count, count(*) AS customers,
               round(max(total), 2) AS most_spent
        FROM spent GROUP BY orders""",
    "qualified_star": "SELECT * FROM orders WHERE o_totalprice > 100000",
    "outlier_trim": TRIM_SQL,
    "percentile_bounds": BOUNDS_SQL,
    "percentile_bounds_narrowed": BOUNDS_SQL,
    "percentile_bounds_approx": "SELECT bound, true AS near FROM (VALUES "
    + ", ".join(f"('{c}_{side}_bound')" for c in _BOUNDED for side in ("lower", "upper"))
    + ") AS b(bound)",
    "dedup_latest": """
        SELECT * FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey
                                   ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "versions_from_changes": """
        WITH changes AS (
            SELECT * FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate
                                       ORDER BY o_orderkey DESC) = 1)
        SELECT o_custkey AS id, o_orderkey, o_totalprice, o_orderdate AS start_ts,
               lead(o_orderdate, 1, TIMESTAMP '9999-12-31 00:00:00') OVER (
                   PARTITION BY o_custkey ORDER BY o_orderdate) AS end_ts
        FROM changes""",
    "asof_join": ASOF_SQL,
    "sessions": SESSIONS_SQL,
    "running_total": """
        SELECT o_orderkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents,
               sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderdate)::BIGINT AS cents_so_far,
               count(*) OVER (ORDER BY o_orderdate) AS orders_so_far
        FROM orders""",
    "running_total_by_key": """
        SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_quantity,
               sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS quantity_so_far
        FROM lineitem""",
    "cube_lattice": _LEVELS_SQL.format(kind="CUBE"),
    "rollup_lattice": _LEVELS_SQL.format(kind="ROLLUP"),
    "distinct_rollup": """
        SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS kind,
               count(DISTINCT user_id) AS users, count(DISTINCT value) AS amounts
        FROM events GROUP BY kind""",
    "distinct_rollup_sketched": "SELECT DISTINCT event_type, true AS near FROM events",
    "asof_join_nearest": NEAREST_SQL,
    "multi_agg": """
        SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey,
               l_quantity > 15 AS large, count(*) AS line_count,
               sum(l_quantity) AS sum_qty, min(l_extendedprice) AS min_price,
               max(l_extendedprice) AS max_price,
               avg(l_quantity) AS avg_qty
        FROM lineitem GROUP BY ALL""",
    "group_by_alias": """
        SELECT value > 15 AS expensive, event_type, count(*) AS events
        FROM events GROUP BY ALL""",
    "reaggregate": """
        SELECT l_suppkey, CAST(sum(line_count) AS BIGINT) AS line_count,
               sum(sum_qty) AS sum_qty
        FROM (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS line_count,
                     sum(l_quantity) AS sum_qty
              FROM lineitem GROUP BY ALL)
        GROUP BY l_suppkey""",
    "fn_to_date": f"""
        SELECT tpep_pickup_datetime, CAST({_PICKUP} AS DATE) AS pickup_date
        FROM ({RAW_TRIPS_SQL})""",
    "fn_duration": f"""
        SELECT tpep_pickup_datetime, tpep_dropoff_datetime,
               CAST({_EPOCH.format("tpep_pickup_datetime")} AS BIGINT) AS pickup_seconds,
               {_DURATION} AS trip_duration
        FROM ({RAW_TRIPS_SQL})""",
    "fn_minute_text": f"""
        SELECT tpep_pickup_datetime,
               strftime({_PICKUP}, '%Y-%m-%d %H:%M:00') AS pickup_date_time
        FROM ({RAW_TRIPS_SQL})""",
    "fn_hour_minute": f"""
        SELECT tpep_pickup_datetime, CAST(hour({_PICKUP}) AS INTEGER) AS pickup_hour,
               CAST(minute({_PICKUP}) AS INTEGER) AS pickup_minute
        FROM ({RAW_TRIPS_SQL})""",
    "fn_timeslot": f"""
        SELECT tpep_pickup_datetime,
               CAST(floor(minute({_PICKUP}) / 10) AS BIGINT) AS pickup_timeslot
        FROM ({RAW_TRIPS_SQL})""",
    "fn_speed": f"""
        SELECT trip_distance, tpep_pickup_datetime, {_SPEED} AS speed
        FROM ({RAW_TRIPS_SQL})""",
    "fn_safe_divide": """
        SELECT l_orderkey, l_linenumber,
               l_quantity / nullif(l_discount, 0) AS quantity_per_discount
        FROM lineitem""",
    "taxi_std1": STD1_SQL,
    "taxi_std2": STD2_SQL,
    "taxi_std3": summary_sql(STD2_SQL),
    "taxi_serving": curation_sql(summary_sql(STD2_SQL)),
}
