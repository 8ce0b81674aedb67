import json

import pytest

import fruit
from tierflow import SpecError, load_pipeline, parse_pipeline


def minimal(**changes):
    task = {
        "name": "a",
        "input": {"type": "filestore", "format": "csv", "path": "/x", "read-type": "Batch"},
        "output": {"target": "stg_a", "type": ["view"]},
        "schema": fruit.SALES_SCHEMA,
    }
    return {"name": "p", "staging": [task | changes]}


def test_lists_of_tasks(tmp_path):
    spec = parse_pipeline(fruit.document(tmp_path, "p", "streaming"))
    assert [t.name for t in spec.tasks()] == ["sales", "price", "join", "total"]
    assert [t.streaming for t in spec.tasks()] == [True, False, True, True]
    assert spec.task("standard", "join").code.text == "\n".join(fruit.JOIN)
    assert spec.staging[0].source.schema.fieldNames() == ["ID", "Amount", "TS"]


def test_tasks_keyed_by_name_with_keys_at_their_root():
    spec = parse_pipeline(
        {
            "name": "p",
            "staging": {
                "raw": {
                    "format": "csv",
                    "target": "raw_rows",
                    "location": "landing/",
                    "output": ["table"],
                    "type": "batch",
                    "schema": fruit.SALES_SCHEMA,
                }
            },
            "standard": {
                "std": {
                    "sql": ["SELECT *", "FROM raw_rows"],
                    "target": "std_rows",
                    "type": "batch",
                    "output": ["table"],
                }
            },
        }
    )
    raw, std = spec.staging[0], spec.standard[0]
    assert (raw.name, raw.sink.target, raw.sink.kinds) == ("raw", "raw_rows", ("table",))
    assert raw.source.kind == "filestore"
    assert (raw.source.format, raw.source.path) == ("csv", "landing/")
    assert raw.source.read_type == "batch"
    assert std.code.lang == "sql"
    assert std.code.text == "SELECT *\nFROM raw_rows"


def test_source_keys_at_the_task_root():
    spec = parse_pipeline(
        {
            "name": "p",
            "staging": [
                {
                    "name": "t",
                    "input": {"type": "jdbc"},
                    "jdbc_url": "jdbc:x",
                    "table_name": "orders",
                    "output": {"target": "stg", "type": ["view"]},
                }
            ],
        }
    )
    source = spec.staging[0].source
    assert source.setting("jdbc_url") == "jdbc:x"
    assert source.setting("table_name") == "orders"


def test_read_type_is_case_insensitive():
    assert parse_pipeline(minimal()).staging[0].source.read_type == "batch"


@pytest.mark.parametrize(
    "document",
    [
        {"staging": []},
        minimal(name=None),
        minimal(output={"target": "x", "type": ["queue"]}),
        minimal(output={"target": "x", "type": []}),
        minimal(output={"type": ["view"]}),
        minimal(output={"target": "x", "type": ["file"], "mode": "merge"}),
        minimal(input={"type": "filestore", "read-type": "sometimes"}),
        minimal(input={"format": "csv"}),
        {"name": "p", "standard": [{"name": "s", "output": {"target": "x", "type": ["view"]}}]},
        {
            "name": "p",
            "standard": [
                {
                    "name": "s",
                    "code": {"lang": "scala", "scala": "1"},
                    "output": {"target": "x", "type": ["view"]},
                }
            ],
        },
        {
            "name": "p",
            "standard": [
                {
                    "name": "s",
                    "code": {"lang": "sql"},
                    "output": {"target": "x", "type": ["view"]},
                }
            ],
        },
    ],
)
def test_bad_documents_are_refused(document):
    with pytest.raises(SpecError):
        parse_pipeline(document)


def test_unknown_stage_and_task():
    spec = parse_pipeline(minimal())
    with pytest.raises(SpecError):
        spec.layer("gold")
    with pytest.raises(SpecError):
        spec.task("staging", "missing")


def test_load_from_path(spark, tmp_path):
    path = tmp_path / "pipeline.json"
    path.write_text(json.dumps(minimal(), indent=2))
    assert load_pipeline(spark, str(path)).name == "p"


def test_schema_as_json_text():
    text = json.dumps(fruit.SALES_SCHEMA)
    source = parse_pipeline(minimal(schema=text)).staging[0].source
    assert source.schema.fieldNames() == ["ID", "Amount", "TS"]
    with pytest.raises(SpecError, match="schema"):
        parse_pipeline(minimal(schema="ID int"))
