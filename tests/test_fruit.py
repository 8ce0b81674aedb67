"""The worked example against its published and hand-computed totals."""

import pytest

import fruit
from tierflow import Pipeline


def stored(flow, kind="table"):
    from tierflow.sinks import read_sink

    task = flow.spec.task("serving", "total")
    return fruit.totals(read_sink(flow.spark, flow.workspace, task, kind))


@pytest.mark.parametrize("format", ["csv", "json"])
def test_batch_over_landed_samples(spark, tmp_path, work, format):
    flow = Pipeline(spark, fruit.document(tmp_path, f"golden_{format}", format=format), work)
    landed = flow.land_samples()
    assert landed == [str(tmp_path / "sales"), str(tmp_path / "price")]
    run = flow.run()
    assert stored(flow) == stored(flow, "file") == fruit.SAMPLE_TOTALS
    assert fruit.totals(run.relations["srv_fruit_total"]) == fruit.SAMPLE_TOTALS
    assert run.queries == []


def test_batch_over_files(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_files"), work)
    flow.run()
    assert stored(flow) == fruit.FILE_TOTALS


def test_streaming_equals_batch(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "golden_stream", "streaming")
    document["staging"][0]["input"]["options"] = {"maxFilesPerTrigger": 1}
    flow = Pipeline(spark, document, work)
    run = flow.run()
    assert stored(flow) == stored(flow, "file") == fruit.FILE_TOTALS
    assert not any(query.isActive for query in run.queries)
    assert run.relations["std_fruit_sales"].isStreaming


def test_streaming_restart_takes_late_file_once(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_late", "streaming"), work)
    flow.run()
    fruit.write_sales_day(tmp_path / "sales", "2022-01-13", 12)
    flow.run()
    flow.run()
    expected = {
        key: total + fruit.SAMPLE_TOTALS[key] for key, total in fruit.FILE_TOTALS.items()
    }
    assert stored(flow) == expected
    assert flow.output("standard", "join").count() == 28


def test_timed_streaming_run_stops(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "golden_timed", "streaming", total_sinks=("table",))
    flow = Pipeline(spark, document, work)
    run = flow.run(await_seconds=8)
    assert len(run.queries) == 3
    assert not any(query.isActive for query in run.queries)
    assert stored(flow) == fruit.FILE_TOTALS


def test_queries_with_a_trigger_are_left_running(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "golden_running", "streaming")
    flow = Pipeline(spark, document, work)
    run = flow.run(stage="staging", trigger={"processingTime": "1 second"})
    (query,) = run.queries
    assert query.isActive
    query.processAllAvailable()
    fruit.write_sales_day(tmp_path / "sales", "2022-01-14", 1)
    query.processAllAvailable()
    query.stop()
    assert flow.output("staging", "sales").count() == 28


def test_columns_and_types_of_layers(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_types"), work)
    run = flow.run()
    assert run.relations["std_fruit_sales"].dtypes == [
        ("fruit", "string"),
        ("id", "int"),
        ("amount", "int"),
        ("price", "double"),
        ("ts", "timestamp"),
        ("cost", "double"),
    ]
    assert run.relations["srv_fruit_total"].dtypes == [
        ("id", "int"),
        ("fruit", "string"),
        ("total", "double"),
    ]


def test_sale_without_price_is_kept(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    (tmp_path / "sales" / "extra.csv").write_text(
        "ID,Amount,TS\n"
        "9,5,2022-01-10 00:00:00\n"  # no such fruit
        "1,100,2015-01-01 00:00:00\n"  # the first instant of the price
        "1,100,2099-12-31 23:59:59\n"  # the first instant after it
        "x,7,bad\n"  # malformed cells
    )
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_edges"), work)
    flow.run()
    found = stored(flow)
    assert found.pop((None, None)) is None
    assert found == fruit.FILE_TOTALS | {(1, "Red Grape"): 92.0 + 200.0}
    rows = flow.output("staging", "sales").where("id is null").collect()
    assert [(r["ID"], r["Amount"], r["TS"]) for r in rows] == [(None, 7, None)]


def test_blanks_in_price_file(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_blanks"), work)
    prices = flow.resolve("standard")["stg_price"]
    rows = {r["ID"]: r for r in prices.collect()}
    assert rows[7]["Color"] == " Green"
    assert rows[1]["Price"] == 2.0
    assert rows[1]["Start_TS"].isoformat() == "2015-01-01T00:00:00"


def test_empty_folders_give_empty_results(spark, tmp_path, work):
    for part in ("sales", "price"):
        (tmp_path / part).mkdir()
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_empty"), work)
    run = flow.run()
    assert run.relations["stg_sales"].columns == ["ID", "Amount", "TS"]
    assert run.relations["std_fruit_sales"].count() == 0
    assert stored(flow) == stored(flow, "file") == {}


def test_price_that_changes_matches_on_either_side(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    (tmp_path / "price" / "002.csv").write_text(
        "ID,Fruit,Color,Price,Start_TS,End_TS\n"
        "8,Kiwi,Green,1.0,2022-01-01 00:00:00,2022-01-12 00:00:00\n"
        "8,Kiwi,Green,10.0,2022-01-12 00:00:00,2099-12-31 23:59:59\n"
    )
    (tmp_path / "sales" / "kiwi.csv").write_text(
        "ID,Amount,TS\n8,1,2022-01-11 23:59:59\n8,1,2022-01-12 00:00:00\n"
    )
    flow = Pipeline(spark, fruit.document(tmp_path, "golden_change"), work)
    flow.run()
    assert stored(flow) == fruit.FILE_TOTALS | {(8, "Kiwi"): 11.0}
    assert flow.output("standard", "join").where("id = 8").count() == 2
