import json

import pytest
from pyspark.sql.types import StructType

import fruit
from tierflow import SpecError
from tierflow.sources import infer_sample, load_source, register_source, relation_from_rows
from tierflow.sources.jdbc import jdbc_options
from tierflow.sources.messages import bus_options
from tierflow.sources.object_store import abfs_uri, adl_uri
from tierflow.spec import SourceSpec

SALES = StructType.fromJson(fruit.SALES_SCHEMA)


def test_unknown_type_is_refused(spark):
    with pytest.raises(SpecError, match="unknown source type"):
        load_source(spark, SourceSpec(kind="carrier_pigeon"))


def test_vendor_word_before_a_known_type(spark, tmp_path):
    (tmp_path / "container" / "sales").mkdir(parents=True)
    (tmp_path / "container" / "sales" / "a.csv").write_text(
        "ID,Amount,TS\n1,2,2022-01-01 00:00:00\n"
    )
    source = SourceSpec(
        kind="vendor_adls_gen2",
        format="csv",
        schema=SALES,
        settings={
            "storage-account": "acc",
            "container-name": "container",
            "data-folder": "sales",
            "root": str(tmp_path),
        },
    )
    assert [(r["ID"], r["Amount"]) for r in load_source(spark, source).collect()] == [(1, 2)]


def test_own_source_type(spark):
    register_source("numbers", lambda spark, source: spark.range(3))
    assert load_source(spark, SourceSpec(kind="Numbers")).count() == 3


@pytest.mark.parametrize("read_type", [None, "sometimes"])
def test_unknown_read_type_is_refused(spark, read_type):
    source = SourceSpec(kind="filestore", format="csv", path="/x", read_type=read_type)
    with pytest.raises(SpecError, match="read type"):
        load_source(spark, source)


def test_missing_format_and_path_are_refused(spark):
    with pytest.raises(SpecError, match="format"):
        load_source(spark, SourceSpec(kind="filestore", path="/x", read_type="batch"))
    with pytest.raises(SpecError, match="path"):
        load_source(spark, SourceSpec(kind="filestore", format="csv", read_type="batch"))


def test_empty_folder_gives_declared_schema(spark, tmp_path):
    source = SourceSpec(
        kind="filestore", format="csv", path=str(tmp_path), read_type="batch", schema=SALES
    )
    df = load_source(spark, source)
    assert df.count() == 0
    assert df.columns == ["ID", "Amount", "TS"]


def test_options_replace_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;2;2022-01-01 00:00:00\n")
    source = SourceSpec(
        kind="filestore",
        format="csv",
        path=str(tmp_path),
        read_type="batch",
        schema=SALES,
        options={"header": "false", "sep": ";"},
    )
    assert [(r["ID"], r["Amount"]) for r in load_source(spark, source).collect()] == [(1, 2)]


def test_batch_and_stream_differ_by_read_type_only(spark, tmp_path):
    def load(read_type):
        return load_source(
            spark,
            SourceSpec(
                kind="filestore",
                format="json",
                path=str(tmp_path),
                read_type=read_type,
                schema=SALES,
            ),
        )

    assert not load("batch").isStreaming
    assert load("streaming").isStreaming
    assert load("batch").dtypes == load("streaming").dtypes


def test_table_format_keeps_its_schema(spark, tmp_path, monkeypatch):
    """A reader that refuses a schema is given none; declared types are cast to."""
    path = str(tmp_path / "lake")
    spark.range(3).selectExpr("id AS ID", "id * 2 AS Amount").write.parquet(path)
    schema = StructType.fromJson(fruit.declared(Amount="string", ID="integer"))
    source = SourceSpec(kind="lake", path=path, read_type="batch", schema=schema)
    monkeypatch.setattr("tierflow.sources.files.TABLE_FORMATS", {"parquet"})
    df = load_source(spark, source)
    assert df.dtypes == [("Amount", "string"), ("ID", "int")]
    assert sorted(map(tuple, df.collect())) == [("0", 0), ("2", 1), ("4", 2)]


def test_discovery_prefix_is_dropped(spark, tmp_path):
    source = SourceSpec(
        kind="autoloader",
        path=str(tmp_path),
        schema=SALES,
        options={"cloudFiles.format": "csv", "cloudFiles.maxFilesPerTrigger": "1"},
    )
    assert load_source(spark, source).isStreaming


def test_object_store_uris():
    gen2 = SourceSpec(
        kind="adls_gen2",
        settings={"storage-account": "acc", "container-name": "c", "data-folder": "a/b"},
    )
    assert abfs_uri(gen2) == "abfss://c@acc.dfs.core.windows.net/a/b"
    gen1 = SourceSpec(
        kind="adls_gen1",
        settings={
            "storage-resource": "acc",
            "directory-name": "a/b",
            "endpoint": "store.example",
        },
    )
    assert adl_uri(gen1) == "adl://acc.store.example/a/b"
    with pytest.raises(SpecError, match="container-name"):
        abfs_uri(SourceSpec(kind="adls_gen2", settings={"storage-account": "acc"}))


def test_jdbc_reader_options():
    settings = {
        "jdbc_url": "jdbc:db://host/x",
        "table_name": "orders",
        "jdbc_username": "u",
        "jdbc_password": "p",
    }
    single = SourceSpec(kind="jdbc", settings=settings, options={"fetchsize": "1000"})
    assert jdbc_options(single) == {
        "url": "jdbc:db://host/x",
        "dbtable": "orders",
        "user": "u",
        "password": "p",
        "fetchsize": "1000",
    }
    ranges = {
        "partition_column": "id",
        "lower_bound": 0,
        "upper_bound": 100,
        "num_partitions": 4,
    }
    options = jdbc_options(SourceSpec(kind="jdbc", settings=settings | ranges))
    assert options["partitionColumn"] == "id"
    assert options["numPartitions"] == "4"
    with pytest.raises(SpecError, match="partitioned read"):
        jdbc_options(SourceSpec(kind="jdbc", settings=settings | {"partition_column": "id"}))
    with pytest.raises(SpecError, match="table_name"):
        jdbc_options(SourceSpec(kind="jdbc", settings={"jdbc_url": "x"}))


class RecordedReader:
    """Stands in for a session's reader, as no database is started for tests."""

    def __init__(self, table):
        self.table, self.given = table, {}

    def format(self, name):
        self.given["format"] = name
        return self

    def options(self, **options):
        self.given.update(options)
        return self

    def load(self):
        return self.table


def test_jdbc_table_is_cast_to_the_declared_schema(spark):
    table = spark.range(2).selectExpr("id AS ID", "cast(id AS decimal(10, 0)) AS Amount")
    session = type("Session", (), {"read": RecordedReader(table)})()
    schema = StructType.fromJson(fruit.declared(ID="integer", Amount="double"))
    settings = {"jdbc_url": "jdbc:db://host/x", "table_name": "t"}
    source = SourceSpec(kind="jdbc", schema=schema, settings=settings)
    df = load_source(session, source)
    assert session.read.given["format"] == "jdbc"
    assert session.read.given["dbtable"] == "t"
    assert df.dtypes == [("ID", "int"), ("Amount", "double")]


def test_bus_connection_cannot_be_replaced():
    options = {
        "eventhubs.connectionString": "other",
        "eventhubs.consumerGroup": "g",
        "unrelated": "x",
    }
    source = SourceSpec(kind="eventhub", options=options, settings={"connection": "mine"})
    assert bus_options(source) == {
        "eventhubs.connectionString": "mine",
        "eventhubs.consumerGroup": "g",
    }


def test_message_without_json_gives_nulls(spark):
    from tierflow.sources import decode_json

    df = spark.createDataFrame([(1, b'{"ID": 5}'), (2, b"oops")], "n int, body binary")
    rows = decode_json(df, "body", SALES, keep=["n"]).orderBy("n").collect()
    assert [(r["n"], r["ID"], r["Amount"]) for r in rows] == [(1, 5, None), (2, None, None)]


def test_sample_rows_are_typed_by_the_schema(spark):
    df = relation_from_rows(
        spark, fruit.PRICE_ROWS, StructType.fromJson(fruit.PRICE_SCHEMA)
    )
    row = df.where("ID = 1").first()
    assert row["Price"] == 2.0
    assert row["Start_TS"].isoformat() == "2014-12-31T16:00:00"


@pytest.mark.parametrize(
    "text",
    [
        '[\n {"a": 1, "b": "x"},\n {"a": 2}\n]',
        '{"a": 1, "b": "x"}\n{"a": 2}\n',
    ],
)
def test_infer_json_sample(spark, text):
    rows, schema = infer_sample(spark, text)
    assert rows == [{"a": 1, "b": "x"}, {"a": 2}]
    fields = {f["name"]: f["type"] for f in json.loads(schema)["fields"]}
    assert fields == {"a": "long", "b": "string"}


def test_infer_csv_sample(spark):
    text = 'id,note,at\n1,"two\nlines",2022-01-01 00:00:00\n2,,2022-01-02 00:00:00\n'
    rows, schema = infer_sample(spark, text, "csv")
    assert rows[0]["note"] == "two\nlines"
    assert "note" not in rows[1]
    fields = {f["name"]: f["type"] for f in json.loads(schema)["fields"]}
    assert fields == {"id": "integer", "note": "string", "at": "timestamp"}


def test_infer_sample_shows_25_rows(spark):
    text = "\n".join(json.dumps({"n": n}) for n in range(40))
    rows, _ = infer_sample(spark, text)
    assert len(rows) == 25
    with pytest.raises(SpecError):
        infer_sample(spark, "x", "xml")
