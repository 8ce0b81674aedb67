"""Messages that cannot be decoded are kept with their body and why."""

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from tierflow import Pipeline
from tierflow.sources import decode_or_explain, decoded_part, undecoded_part
from tierflow.spec import SpecError

PAYLOAD = StructType([StructField("k", IntegerType(), False), StructField("v", StringType())])
BODIES = {
    '{"k": 1, "v": "a"}': (1, "a", None),
    '{"k": 2}': (2, None, None),
    '{"k": 3, "more": 1}': (3, None, None),
    '{"v": "a"}': (None, None, "lacks k"),
    '{"k": "x"}': (None, None, "not JSON of the declared schema"),
    '{"k": 1': (None, None, "not JSON of the declared schema"),
    "plain": (None, None, "not JSON of the declared schema"),
    "null": (None, None, "not JSON of the declared schema"),
    "": (None, None, "no object"),
}


def test_every_body_is_decoded_or_explained(spark):
    df = spark.createDataFrame([(b,) for b in [*BODIES, None]], "body string")
    rows = decode_or_explain(df, "body", PAYLOAD)
    got = {r["_body"]: (r.k, r.v, r["_error"]) for r in rows.collect()}
    assert got == {**BODIES, None: (None, None, "no body")}
    good, bad = decoded_part(rows), undecoded_part(rows, PAYLOAD)
    assert good.columns == ["k", "v"] and bad.columns == ["_body", "_error"]
    assert good.count() + bad.count() == len(BODIES) + 1 and good.count() == 3


def document(work, **output):
    source = {
        "type": "messages", "format": "parquet", "path": f"{work}/in", "envelope": "id int, body string",
        "keep": ["id"], "quarantine": True,
    }
    return {
        "name": "messages",
        "staging": [
            {"name": "m", "input": source, "schema": PAYLOAD.jsonValue(), "output": {"target": "stg_m", "type": ["file", "view"], **output}}
        ],
        "standard": [
            {"name": "twice", "type": "streaming", "code": {"lang": "sql", "sql": "SELECT id, k * 2 AS k FROM stg_m"}, "output": {"target": "std_m", "type": ["file"]}}
        ],
    }


def test_later_layers_read_what_was_decoded(spark, work):
    flow = Pipeline(spark, document(work), working_dir=work)
    seen = 0
    for bodies in (['{"k": 1}', "bad"], ['{"k": 2}', '{"v": "no key"}', None]):
        rows = [(seen + n, body) for n, body in enumerate(bodies)]
        seen += len(rows)
        spark.createDataFrame(rows, "id int, body string").coalesce(1).write.mode("append").parquet(f"{work}/in")
        flow.run()
    flow.run()
    assert sorted(map(tuple, flow.output("standard", "twice").collect())) == [(0, 2), (2, 4)]
    assert sorted((r.id, r["_error"]) for r in flow.quarantine("m").collect()) == [
        (1, "not JSON of the declared schema"), (3, "lacks k"), (4, "no body"),
    ]
    assert flow.output("staging", "m").columns == ["id", "k", "v"]


def test_refusals(spark, work):
    with pytest.raises(SpecError, match="quarantine"):
        Pipeline(spark, document(work, type=["table", "view"]))
    flow = Pipeline(spark, document(work), working_dir=work)
    with pytest.raises(SpecError, match="no task"):
        flow.quarantine("other")
    clash = StructType([StructField("_body", StringType())])
    with pytest.raises(SpecError, match="own"):
        decode_or_explain(spark.createDataFrame([("x",)], "body string"), "body", clash)
