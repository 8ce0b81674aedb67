import random

import brute
from pyspark.sql import functions as F
from tierflow.llm import substrings
from tierflow.llm.substrings import remove_repeats

DOCS = "doc_id bigint, text string"


def kept(spark, docs, **more):
    out = remove_repeats(spark.createDataFrame(docs, DOCS), **more)
    return [(r.doc_id, r.n_words, r.n_removed, r.kept, r.factors) for r in out.collect()]


def passages(seed, docs=120, size=6):
    """Documents glued together from a few passages, repeats and noise."""
    rng = random.Random(seed)
    noise = [f"w{n}" for n in range(60)]
    pool = [[rng.choice(noise) for _ in range(rng.randint(3, 40))] for _ in range(15)]
    out = []
    for doc in range(docs):
        words = []
        for _ in range(rng.randint(0, size)):
            words += rng.choice(pool) if rng.random() < 0.6 else rng.choices(noise, k=rng.randint(1, 12))
        out.append((doc, rng.choice([" ", "\n", " \t "]).join(words)))
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    docs = passages(1) + [(500, "w1 " * 100), (501, "x " * 30), (502, None), (503, ""), (504, "é\u00a0ü w1")]
    for window, anchor in ((7, 3), (20, 8)):
        expected = brute.without_repeats(docs, window)
        # small units: repeats are found in a task and between tasks
        for unit in (50, 1 << 20):
            for doc, n_words, n_removed, text, _ in kept(spark, docs, window=window, anchor=anchor, unit_words=unit):
                assert text == " ".join(expected[doc]), (doc, window, unit)
                assert n_removed == n_words - len(expected[doc])


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    common = " ".join(f"c{n}" for n in range(9))
    docs = [(n, f"{common} u{n} {common} v{n % 7} {common}") for n in range(300)]
    monkeypatch.setattr(substrings, "CROWDED_SHARE", 0.001)
    expected = brute.without_repeats(docs, 20)
    assert {d: t for d, _, _, t, _ in kept(spark, docs)} == {d: " ".join(w) for d, w in expected.items()}


def test_factors_are_copies_of_earlier_words(spark):
    docs = passages(4)
    words = {doc: brute.words_of(text) for doc, text in docs}
    for doc, _, n_removed, _, factors in kept(spark, docs, window=7, anchor=3):
        covered = set()
        for f in factors:
            assert f.n_words >= 7 and (f.ref_doc, f.ref_start) < (doc, f.start)
            mine = words[doc][f.start : f.start + f.n_words]
            assert mine == words[f.ref_doc][f.ref_start : f.ref_start + f.n_words]
            covered.update(range(f.start, f.start + f.n_words))
        assert len(covered) == n_removed


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{n}" for n in range(25))
    docs = [(2, long), (2, long), (2, long + " z"), (None, long + " y"), (None, long + " y"), (3, long * 1), (4, None)]
    rows = kept(spark, docs)
    # the null id comes first; each later text loses what it shares with it
    got = sorted((str(d), t) for d, _, _, t, _ in rows)
    assert got == sorted(
        [("None", long + " y"), ("None", long + " y"), ("2", ""), ("2", ""), ("2", "z"), ("3", ""), ("4", "")]
    )


def test_long_text_empty_table_and_clashes(spark):
    body = " ".join(f"w{n % 50_000}" for n in range(150_000))
    ((_, n_words, n_removed, text, _),) = kept(spark, [(1, body)])
    assert (n_words, n_removed, text) == (150_000, 100_000, " ".join(f"w{n}" for n in range(50_000)))
    assert kept(spark, []) == []
    df = spark.createDataFrame([(1, "a b")], DOCS).withColumn("kept", F.lit(5)).withColumn("doc", F.lit("d"))
    (row,) = remove_repeats(df).collect()
    assert row.kept == "a b" and row.doc == "d"


def test_texts_of_one_id_are_told_apart_by_the_whole_hash(spark, monkeypatch):
    whole = substrings.F.xxhash64
    # a hash whose upper 31 bits say nothing
    weak = lambda *columns: whole(*columns).bitwiseAND(substrings.F.lit((1 << 33) - 1))
    monkeypatch.setattr(substrings.F, "xxhash64", weak)
    bodies = [" ".join(f"t{n}w{k}" for k in range(30)) for n in range(200)]
    docs = [(None, body) for body in bodies] + [(n, f"own{n} {body}") for n, body in enumerate(bodies)]
    for unit in (200, 1 << 19):
        rows = kept(spark, docs, unit_words=unit)
        assert sorted(t for d, _, _, t, _ in rows if d is None) == sorted(bodies)
        assert {d: t for d, _, _, t, _ in rows if d is not None} == {n: f"own{n}" for n in range(200)}
