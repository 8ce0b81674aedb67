"""Incremental files that move to an archive once they are read."""

import os
import time

from tierflow import Pipeline


def names(folder):
    return sorted(n for _, _, files in os.walk(folder) for n in files if n.startswith("part-"))


def test_files_read_move_to_the_archive(spark, work):
    schema = spark.createDataFrame([], "n bigint").schema
    source = {"type": "incremental_files", "format": "parquet", "path": f"{work}/in", "archive": f"{work}/archive"}
    task = {"name": "in", "input": source, "schema": schema.jsonValue(), "output": {"target": "stg_in", "type": ["file"]}}
    flow = Pipeline(spark, {"name": "archived", "staging": [task]}, working_dir=f"{work}/app")
    came = []
    for batch in range(4):
        spark.range(batch * 10, batch * 10 + 10, 1, 3).selectExpr("id AS n").write.mode("append").parquet(f"{work}/in")
        came = sorted({*came, *names(f"{work}/in")})
        flow.run()
        # moved in the background, after the batch that follows
        for _ in range(50):
            if len(names(f"{work}/in")) <= 6:
                break
            time.sleep(0.2)
        assert len(names(f"{work}/in")) <= 6
    flow.run()
    assert sorted(r.n for r in flow.output("staging", "in").collect()) == list(range(40))
    left, moved = names(f"{work}/in"), names(f"{work}/archive")
    assert sorted(left + moved) == came and len(moved) >= 6
