"""Fruit sales against versioned fruit prices: the pipelines' worked example."""

from __future__ import annotations

# Sample rows of the example.
SALE_TS = "2022-01-10T00:00:00.000+08:00"
START_TS, END_TS = "2015-01-01T00:00:00.000+08:00", "2099-12-31T23:59:59.000+08:00"
AMOUNTS = {1: 12, 2: 13, 3: 14, 4: 15, 5: 16, 6: 17, 7: 18}
FRUITS = [
    (1, "Red Grape", "Red", 2),
    (2, "Peach", "Yellow", 3),
    (3, "Orange", "Orange", 2),
    (4, "Green Apple", "Green", 3),
    (5, "Fiji Apple", "Red", 3.5),
    (6, "Banana", "Yellow", 1),
    (7, "Green Grape", " Green", 2),
]
# Files of the example, with the blanks they contain.
PRICE_CSV = """ID,Fruit,Color,Price,Start_TS,End_TS
1,Red Grape,Red, 2.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
2,Peach,Yellow,3.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
3,Orange,Orange, 2.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
4,Green Apple,Green, 3.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
5,Fiji Apple,Red, 3.5, 2015-01-01 00:00:00,2099-12-31 23:59:59
6,Banana,Yellow, 1.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
7,Green Grape, Green,2.0, 2015-01-01 00:00:00,2099-12-31 23:59:59
"""
# Totals of the sample rows, and of the three days of files.
SAMPLE_TOTALS = {
    (1, "Red Grape"): 24.0,
    (2, "Peach"): 39.0,
    (3, "Orange"): 28.0,
    (4, "Green Apple"): 45.0,
    (5, "Fiji Apple"): 56.0,
    (6, "Banana"): 17.0,
    (7, "Green Grape"): 36.0,
}
FILE_TOTALS = {
    (1, "Red Grape"): 92.0,
    (2, "Peach"): 147.0,
    (3, "Orange"): 104.0,
    (4, "Green Apple"): 165.0,
    (5, "Fiji Apple"): 203.0,
    (6, "Banana"): 61.0,
    (7, "Green Grape"): 128.0,
}


def declared(**types: str) -> dict:
    fields = [
        {"name": n, "type": t, "nullable": True, "metadata": {}}
        for n, t in types.items()
    ]
    return {"type": "struct", "fields": fields}


SALES_SCHEMA = declared(ID="integer", Amount="integer", TS="timestamp")
PRICE_SCHEMA = declared(
    ID="integer",
    Fruit="string",
    Color="string",
    Price="double",
    Start_TS="timestamp",
    End_TS="timestamp",
)

SALES_ROWS = [{"ID": i, "Amount": n, "TS": SALE_TS} for i, n in AMOUNTS.items()]
PRICE_ROWS = [
    {
        "ID": i,
        "Fruit": fruit,
        "Color": color,
        "Price": price,
        "Start_TS": START_TS,
        "End_TS": END_TS,
    }
    for i, fruit, color, price in FRUITS
]

# Statements of this project: a sale's cost is settled where its price is found.
JOIN = [
    "SELECT fruit, stg_price.id, amount, price, ts, amount * price AS cost",
    "FROM stg_sales LEFT JOIN stg_price",
    "  ON stg_price.id = stg_sales.id AND ts >= start_ts AND ts < end_ts",
]
TOTAL = "SELECT id, fruit, sum(cost) AS total FROM std_fruit_sales GROUP BY ALL"


def write_sales_day(folder, day: str, first: int) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    lines = [f"{i},{first + i - 1},{day} 00:00:00" for i in range(1, 8)]
    (folder / f"{day}.csv").write_text("\n".join(["ID,Amount,TS", *lines]) + "\n")


def write_files(folder) -> None:
    """The three days of sales and the prices as landed files."""
    write_sales_day(folder / "sales", "2022-01-10", 12)
    write_sales_day(folder / "sales", "2022-01-11", 12)
    write_sales_day(folder / "sales", "2022-01-12", 22)
    (folder / "price").mkdir(parents=True)
    (folder / "price" / "001.csv").write_text(PRICE_CSV)


def document(
    folder,
    name: str,
    mode: str = "batch",
    format: str = "csv",
    total_sinks=("table", "file"),
    sold_sinks=("file", "view"),
) -> dict:
    def staged(task: str, target: str, part: str, read: str, schema, rows) -> dict:
        return {
            "name": task,
            "input": {
                "type": "filestore",
                "format": format,
                "path": str(folder / part),
                "read-type": read,
            },
            "output": {"target": target, "type": ["file", "view"]},
            "schema": schema,
            "sampleData": rows,
        }

    return {
        "name": name,
        "staging": [
            staged("sales", "stg_sales", "sales", mode, SALES_SCHEMA, SALES_ROWS),
            staged("price", "stg_price", "price", "batch", PRICE_SCHEMA, PRICE_ROWS),
        ],
        "standard": [
            {
                "name": "join",
                "type": mode,
                "code": {"lang": "sql", "sql": JOIN},
                "output": {"target": "std_fruit_sales", "type": list(sold_sinks)},
            }
        ],
        "serving": [
            {
                "name": "total",
                "type": mode,
                "code": {"lang": "sql", "sql": TOTAL},
                "output": {"target": "srv_fruit_total", "type": list(total_sinks)},
            }
        ],
    }


def totals(df) -> dict:
    return {(r["id"], r["fruit"]): r["total"] for r in df.collect()}
