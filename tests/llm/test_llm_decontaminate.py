import brute
from tierflow.llm.decontaminate import decontaminate

ITEM = "What is the capital of Norway, and when was it founded by the king? Ööd"
ITEMS = [(7, ITEM), (8, "Short Item!"), (9, None), (9, ""), (None, "nameless thing here"), (7, ITEM)]
DOCS = [
    (1, f"Before -- {ITEM.upper().replace('ÖÖD', 'Ööd')} after."),
    (2, "a short   item, twice: SHORT\nitem"),
    (3, "what is the capital of norway"),
    (4, None),
    (5, ""),
    (6, "a nameless thing here"),
    (7, "word " * 30_000 + ITEM),
    (7, "word " * 30_000 + ITEM),
    (None, "xshort item shorty"),
]


def judged(spark, docs=DOCS, items=ITEMS, **more):
    return decontaminate(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        **more,
    ).collect()


def test_equals_brute_force(spark):
    rows = judged(spark)
    assert len(rows) == len(DOCS)
    for row in rows:
        hit, found = brute.contaminated(row.text, ITEMS)
        assert (row.n_words, row.n_hit) == (len(brute.normal(row.text)), len(hit))
        assert set(row["items"]) == {str(f) for f in found if f is not None}


def test_many_automata_give_the_same(spark):
    one = sorted((r.doc_id or 0, r.n_hit, r["items"], r.spans) for r in judged(spark))
    many = sorted((r.doc_id or 0, r.n_hit, r["items"], r.spans) for r in judged(spark, automaton_chars=80))
    assert one == many


def test_spans_are_of_the_original_text(spark):
    rows = {r.doc_id: r for r in judged(spark)}
    (span,) = rows[1].spans
    assert rows[1].text[span.start : span.end].lower().startswith("what is the")
    assert rows[1].text[span.start : span.end].endswith("Ööd")
    assert [rows[2].text[s.start : s.end] for s in rows[2].spans] == ["short   item", "SHORT\nitem"]


def test_empty_tables(spark):
    assert judged(spark, docs=[]) == []
    assert [r.n_hit for r in judged(spark, items=[])] == [0] * len(DOCS)


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(2, "short item", "x", [1])], "doc_id bigint, text string, n_hit string, other array<int>")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    (row,) = decontaminate(docs, items).collect()
    assert row.n_hit == 2 and row.other == [1]
