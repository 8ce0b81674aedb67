"""Comparing a Spark result with SQL run over the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark type to the SQL type a column must have.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def sql_rows(sf_dir: str, text: str) -> tuple[dict[str, str], Counter]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    cursor = con.execute(text)
    types = {d[0]: str(d[1]) for d in cursor.description}
    return types, _counted(list(types), cursor.fetchall())


def spark_rows(df) -> tuple[dict[str, str], Counter]:
    types = dict(df.dtypes)
    return types, _counted(list(types), df.collect())


def _counted(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def assert_same(df, sf_dir: str, text: str) -> None:
    spark_types, left = spark_rows(df)
    sql_types, right = sql_rows(sf_dir, text)
    assert {n: TYPES[t] for n, t in spark_types.items()} == sql_types
    assert sum(left.values()) == sum(right.values())
    only = list((left - right).items())[:3], list((right - left).items())[:3]
    assert left == right, only
    assert left, "the comparison covers no rows"
