import pytest
from pyspark.sql import functions as F

import fruit
from tierflow import Pipeline, SpecError
from tierflow.plans import preview, preview_rows, scoped_views
from tierflow.sinks import read_sink
from tierflow.workspace import path_exists, scratch_dir, shared_root


@pytest.fixture
def flow(spark, tmp_path, work, request):
    fruit.write_files(tmp_path)
    name = "flow_" + request.node.name.replace("[", "_").replace("]", "")
    return Pipeline(spark, fruit.document(tmp_path, name), work)


def sink(flow, stage, task, kind):
    return read_sink(flow.spark, flow.workspace, flow.spec.task(stage, task), kind)


def exists(flow, stage, target):
    return path_exists(flow.spark, flow.workspace.data_path(stage, target))


def code(name, target, lang, text, *kinds, **extra):
    return {
        "name": name,
        "type": "batch",
        "code": {"lang": lang, lang: text},
        "output": {"target": target, "type": list(kinds), **extra},
    }


# --- selection and resolution --------------------------------------------------


def test_run_one_layer(flow):
    flow.run(stage="staging")
    assert exists(flow, "staging", "stg_sales")
    assert not exists(flow, "standard", "std_fruit_sales")


def test_run_one_task_builds_what_it_reads_without_writing(flow):
    flow.run(stage="serving", task="total")
    assert fruit.totals(sink(flow, "serving", "total", "table")) == fruit.FILE_TOTALS
    assert not exists(flow, "staging", "stg_sales")
    assert not exists(flow, "standard", "std_fruit_sales")


def test_serving_run_does_not_append_the_standard_layer_again(flow):
    flow.run()
    flow.run(stage="serving")
    assert sink(flow, "standard", "join", "file").count() == 21


def test_resolve_never_writes(flow):
    relations = flow.resolve("serving")
    assert set(relations) == {"stg_sales", "stg_price", "std_fruit_sales"}
    assert relations["std_fruit_sales"].count() == 21
    assert not path_exists(flow.spark, flow.workspace.data_path("staging", "stg_sales"))


def siblings(tmp_path, name):
    """A standard layer of a broken task and two that build on each other."""
    document = fruit.document(tmp_path, name)
    document["standard"] = [
        code("broken", "std_broken", "sql", "SELECT * FROM nowhere", "view"),
        code("one", "std_one", "sql", "SELECT id, amount FROM stg_sales", "view"),
        code("two", "std_two", "sql", "SELECT sum(amount) AS s FROM std_one", "file"),
    ]
    document["serving"] = []
    return document


def test_task_reads_tasks_listed_before_it(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, siblings(tmp_path, "siblings"), work)
    run = flow.run(stage="standard", task="two")
    assert [tuple(r) for r in run.relations["std_two"].collect()] == [(385,)]
    assert [tuple(r) for r in flow.try_task("standard", "two").collect()] == [(105,)]
    with pytest.raises(Exception, match="nowhere"):
        flow.run(stage="standard")


def test_failing_stream_leaves_no_query_running(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "failing", "streaming", sold_sinks=("file", "table"))
    document["standard"][0]["code"]["sql"] = "SELECT raise_error('stop') AS x FROM stg_sales"
    flow = Pipeline(spark, document, work)
    with pytest.raises(Exception, match="stop"):
        flow.run(stage="standard", await_seconds=60)
    assert not [q for q in spark.streams.active]


def test_unknown_task_and_stage(flow):
    with pytest.raises(SpecError):
        flow.run(task="missing")
    with pytest.raises(SpecError):
        flow.run(stage="gold")


def test_callers_schema_is_left_alone(flow, spark):
    before = spark.catalog.currentDatabase()
    flow.run()
    assert spark.catalog.currentDatabase() == before


# --- write modes -----------------------------------------------------------------


def test_batch_append_accumulates_and_serving_is_replaced(flow):
    flow.run()
    run = flow.run()
    assert sink(flow, "staging", "sales", "file").count() == 42
    assert sink(flow, "standard", "join", "file").count() == 42
    # Views and later layers see the rows of this run only.
    assert run.relations["std_fruit_sales"].count() == 21
    assert fruit.totals(sink(flow, "serving", "total", "table")) == fruit.FILE_TOTALS


def test_mode_of_a_task(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "own_mode")
    document["standard"][0]["output"]["mode"] = "overwrite"
    flow = Pipeline(spark, document, work)
    flow.run()
    flow.run()
    assert sink(flow, "standard", "join", "file").count() == 21


def test_partitioned_sink_keeps_column_order(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "partitioned")
    document["standard"][0]["output"]["partition_by"] = ["id"]
    flow = Pipeline(spark, document, work)
    run = flow.run()
    assert run.relations["std_fruit_sales"].columns[:2] == ["fruit", "id"]
    assert fruit.totals(sink(flow, "serving", "total", "table")) == fruit.FILE_TOTALS


@pytest.mark.parametrize("storage", ["json", "orc"])
def test_storage_format(spark, tmp_path, work, storage):
    """Types survive a format that does not keep them."""
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, f"stored_{storage}", total_sinks=("file",))
    flow = Pipeline(spark, document, work, storage_format=storage)
    for _ in range(2):
        run = flow.run()
        assert dict(run.relations["std_fruit_sales"].dtypes)["ts"] == "timestamp"
        assert fruit.totals(run.relations["srv_fruit_total"]) == fruit.FILE_TOTALS


def test_table_feeds_the_next_layer(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "tables", sold_sinks=("table",))
    flow = Pipeline(spark, document, work)
    flow.run()
    assert fruit.totals(sink(flow, "serving", "total", "file")) == fruit.FILE_TOTALS


def test_fanout_computes_the_result_once(spark, tmp_path, work):
    """A random column is the same in every sink only if it was computed once."""
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "fanout")
    text = "SELECT id, uuid() AS mark FROM stg_sales"
    document["standard"] = [code("mark", "std_mark", "sql", text, "file", "table", "view")]
    document["serving"] = [
        code("copy", "srv_mark", "sql", "SELECT * FROM std_mark", "table", "file")
    ]
    flow = Pipeline(spark, document, work)
    for _ in range(2):  # into empty sinks, then into sinks that hold rows
        run = flow.run()
        marks = {r["mark"] for r in run.relations["std_mark"].collect()}
        assert len(marks) == 21
        for stage, task, kind in (
            ("standard", "mark", "file"),
            ("standard", "mark", "table"),
        ):
            assert marks <= {r["mark"] for r in sink(flow, stage, task, kind).collect()}
        for kind in ("table", "file"):
            copied = sink(flow, "serving", "copy", kind).collect()
            assert {r["mark"] for r in copied} == marks
    assert sink(flow, "standard", "mark", "table").count() == 42


# --- task code -------------------------------------------------------------------


def test_python_text(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "python_text")
    lines = [
        "from pyspark.sql import functions as F",
        "def double(c):",
        "    return F.col(c) * 2",
        "output_df = spark.table('stg_sales').select('id', double('amount').alias('twice'))",
    ]
    document["standard"] = [code("py", "std_py", "python", lines, "view")]
    document["serving"] = []
    flow = Pipeline(spark, document, work)
    rows = flow.run().relations["std_py"]
    assert rows.agg(F.sum("twice")).first()[0] == 2 * (105 + 105 + 175)
    assert spark.table("__py_code_output__").count() == 21


def test_python_callable(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "python_callable")
    document["standard"][0]["code"] = lambda spark: spark.table("stg_sales").limit(3)
    document["serving"] = []
    flow = Pipeline(spark, document, work)
    assert flow.run().relations["std_fruit_sales"].count() == 3


def test_python_without_a_result(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "python_none")
    document["standard"] = [code("py", "std_py", "python", "x = 1", "view")]
    with pytest.raises(SpecError, match="output_df"):
        Pipeline(spark, document, work).run()


def test_settings_of_a_pipeline_end_with_it(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "settings")
    document["conf"] = {"spark.sql.ansi.enabled": False}
    text = "SELECT id, cast('x' AS int) AS bad FROM stg_sales"
    document["standard"] = [code("bad", "std_bad", "sql", text, "file")]
    document["serving"] = []
    before = spark.conf.get("spark.sql.ansi.enabled")
    flow = Pipeline(spark, document, work)
    flow.run()
    assert flow.output("standard", "bad").where("bad is null").count() == 21
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_batch_task_over_a_stream_is_refused(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(tmp_path, "mixed", "streaming")
    document["standard"][0]["type"] = "batch"
    with pytest.raises(SpecError, match="streaming relation"):
        Pipeline(spark, document, work).run(stage="standard")


# --- preview and try ---------------------------------------------------------------


def test_preview(flow):
    flow.run()
    rows, df = flow.preview("serving", "total", 3)
    assert len(rows) == 3 and df.columns == ["id", "fruit", "total"]
    assert len(flow.preview("staging", "sales")[0]) == 20
    with pytest.raises(SpecError):
        flow.preview("gold", "total")
    task = flow.spec.task("serving", "total")
    top = preview(flow.spark, flow.workspace, task, 2, (F.desc("total"),)).collect()
    assert [r["fruit"] for r in top] == ["Fiji Apple", "Green Apple"]
    assert len(preview_rows(flow.spark, flow.workspace, task, 1)) == 1


def test_preview_leaves_out_nulls(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    (tmp_path / "sales" / "x.csv").write_text("ID,Amount,TS\n9,1,2022-01-10 00:00:00\n")
    flow = Pipeline(spark, fruit.document(tmp_path, "preview_nulls"), work)
    flow.run()
    rows, _ = flow.preview("serving", "total", 100)
    assert {} in rows


def test_preview_of_a_stream_reads_what_it_stored(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    flow = Pipeline(spark, fruit.document(tmp_path, "preview_stream", "streaming"), work)
    flow.run()
    assert len(flow.preview("standard", "join", 100)[0]) == 21
    document = fruit.document(tmp_path, "preview_view", "streaming", sold_sinks=("view",))
    unstored = Pipeline(spark, document, work)
    unstored.run(stage="standard")
    with pytest.raises(SpecError, match="keeps no rows"):
        unstored.preview("standard", "join")


@pytest.mark.parametrize("mode", ["batch", "streaming"])
def test_try_over_document_samples(spark, tmp_path, work, mode):
    flow = Pipeline(spark, fruit.document(tmp_path, f"try_{mode}", mode), work)
    assert flow.try_task("standard", "join").count() == 7
    assert fruit.totals(flow.try_task("serving", "total")) == fruit.SAMPLE_TOTALS
    assert not path_exists(spark, flow.workspace.root)
    with pytest.raises(SpecError):
        flow.try_task("standard", "missing")
    with pytest.raises(SpecError):
        flow.try_task("staging", "sales")


def test_try_leaves_views_alone(spark, tmp_path, work):
    spark.range(3).createOrReplaceTempView("stg_sales")
    flow = Pipeline(spark, fruit.document(tmp_path, "try_views"), work)
    assert flow.try_task("standard", "join").count() == 7
    assert spark.table("stg_sales").columns == ["id"]


def test_scoped_views_drop_what_they_made(spark):
    with scoped_views(spark, {"only_here": spark.range(1)}):
        assert spark.table("only_here").count() == 1
    assert not spark.catalog.tableExists("only_here")


def test_preview_of_a_view_replaced_by_another_pipeline(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    mine = Pipeline(spark, fruit.document(tmp_path, "mine"), work)
    mine.run()
    spark.range(2).createOrReplaceTempView("stg_sales")
    assert len(mine.preview("staging", "sales", 100)[0]) == 21
    # A pipeline that has published nothing reads what is stored.
    spark.catalog.dropTempView("stg_sales")
    again = Pipeline(spark, fruit.document(tmp_path, "mine"), work)
    assert again.output("staging", "sales").count() == 21


def test_preview_before_any_run(spark, tmp_path, work):
    document = fruit.document(tmp_path, "never_run", sold_sinks=("view",))
    spark.catalog.dropTempView("std_fruit_sales")
    with pytest.raises(SpecError, match="has not run"):
        Pipeline(spark, document, work).preview("standard", "join")


# --- storage -----------------------------------------------------------------------


def test_clean_drops_tables_and_files(flow, spark):
    flow.run()
    assert spark.catalog.databaseExists(flow.workspace.schema)
    flow.clean()
    assert not spark.catalog.databaseExists(flow.workspace.schema)
    assert not path_exists(spark, flow.workspace.root)
    flow.run()
    assert fruit.totals(sink(flow, "serving", "total", "table")) == fruit.FILE_TOTALS


def test_landing_does_not_replace_files(flow):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        flow.land_samples()


def test_scratch_is_below_the_shared_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one != two and one.startswith(shared_root(spark))


def test_sinks_of_a_stream_have_their_own_checkpoints(spark, tmp_path, work):
    fruit.write_files(tmp_path)
    document = fruit.document(
        tmp_path, "two_sinks", "streaming", sold_sinks=("file", "table", "view")
    )
    flow = Pipeline(spark, document, work)
    flow.run(stage="standard")
    assert sink(flow, "standard", "join", "file").count() == 21
    assert sink(flow, "standard", "join", "table").count() == 21
