import brute
import corpus_pipeline
import pytest
from test_llm_similar import firsts
from tierflow.llm.queries import MIX_BLOCK_ROWS, MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some of the given documents with odd rows among them."""
    given = "/root/testdata/sf0.001"
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in spark.read.parquet(f"{given}/documents.parquet").select(COLUMNS).collect()]
    rows += [(10_000 + n, t, "en", s, 0) for n, (t, s) in enumerate([(None, "src1"), ("", None), ("a\nb\na\nb", "odd")])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, rows


def test_run_equals_brute_force(spark, corpus):
    folder, rows = corpus
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    sources = {r[0]: r[3] for r in rows}
    docs = brute.resampled([(r[0], r[1]) for r in rows], labels)
    docs = [(d, t) for (d, _), t in zip(docs, brute.without_lines(docs))]
    stays = set(firsts(docs))
    docs = [(d, t) for d, t in sorted(docs) if d in stays]
    docs = [(d, t) for d, t in docs if not brute.contaminated(t, items)[0]]
    mixed = brute.mixed([(d, sources[d]) for d, _ in docs], MIX_WEIGHTS, MIX_BLOCK_ROWS)
    texts = dict(docs)
    expected = sorted((d, texts[d] or "", *rest) for (d, _), *rest in mixed)
    got = corpus_pipeline.run(spark, folder).collect()
    names = ("mix_source", "block", "row_in_block", "position")
    assert sorted((r.doc_id, r.text or "", *(r[n] for n in names)) for r in got) == expected
    assert 50 < len(got) < len(rows)


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes, name


def test_stages_take_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
