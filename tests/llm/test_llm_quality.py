import brute
import pytest
from tierflow.llm.quality import kth_largest, resample

DOCS = "doc_id bigint, text string"


def chosen(spark, docs, labels, **more):
    found = resample(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        **more,
    )
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in found.collect())


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    local = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id for r in resample(local, labels).collect()}
    assert got == {doc for doc, _ in brute.resampled(rows, marks)}


def test_keeps_good_and_rejects_bad(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = labels.where("doc_id % 2 = 1")
    kept = resample(docs, labels.where("doc_id % 2 = 0")).select("doc_id")
    good, bad = held_out.where("quality = 1"), held_out.where("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count()
    assert bad.join(kept, "doc_id").count() <= 0.25 * bad.count()


def test_odd_rows(spark):
    good = "the of and to in a is that for it"
    docs = [(n, good + f" {n}") for n in range(20)]
    long = " ".join(text for _, text in docs) * 500
    docs += [(None, good), (100, None), (101, ""), (102, long), (103, "!! " * 50), (103, "!! " * 50)]
    labels = [(n, 1, 0) for n in range(20)] + [(103, 0, 0), (103, 1, 0), (None, 1, 0), (7, None, 0)]
    got = chosen(spark, docs, labels, share=0.85)
    assert not any(doc == 103 for _, doc, _ in got)
    assert (False, 0, good) in got and (True, 100, "") in got and len(got) == 23


def test_nothing_known_keeps_all(spark):
    docs = [(1, "a b"), (1, "a b"), (None, None)]
    assert len(chosen(spark, docs, [])) == 3
    assert chosen(spark, [], [(1, 1, 0)]) == []


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id bigint, text string, score string, rank_key int")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    (row,) = resample(docs, labels).collect()
    assert isinstance(row.score, float) and row.text == "a b"


@pytest.mark.parametrize("k", [1, 2, 5, 6])
def test_kth_largest(spark, k):
    values = [5, -3, 5, 2**62, -(2**63), 0]
    keys = spark.createDataFrame([(v,) for v in values], "rank_key bigint")
    assert kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(keys, 7) is None
