import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tierflow.llm import divergence as module
from tierflow.llm.divergence import SCALE, divergence, furtherness, share, terms

SCHEMA = "text string, lang string, source string"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def by_brute(docs, least_docs=3, most_terms=200):
    docs = [tuple(value or "" for value in doc) for doc in docs]
    found = [(lang, source, re.findall(TERM, text.translate(LOWER))) for text, lang, source in docs]
    out = set()
    for lang in {lang for lang, _, _ in found}:
        mine = [(source, words) for name, source, words in found if name == lang]
        times = Counter(term for _, words in mine for term in set(words))
        kept = [term for term, n in times.items() if n >= least_docs]
        counts = defaultdict(Counter)
        for source, words in mine:
            counts[source].update(words)
            counts[None].update(words)

        def shares(counter):
            size = sum(counter[t] for t in kept) + len(kept)
            return {t: 1 + SCALE * (counter[t] + 1) // size for t in kept}

        p = {source: shares(counter) for source, counter in [(s, counts[s]) for s in {None, *(s for s, _ in mine)}]}
        for source in {s for s, _ in mine}:
            pairs = [
                (-sum((p[source][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o)
                for o in p
                if o not in (None, source)
            ]
            own = [
                (-((p[source][t] - p[None][t]) ** 2 // p[None][t]), t)
                for t in kept
                if counts[source][t] and p[source][t] > p[None][t]
            ]
            key = lambda x: (x[0], x[1].encode())
            for part, rows in (("pair", sorted(pairs, key=key)), ("term", sorted(own, key=key)[:most_terms])):
                out |= {(lang, source, part, item, -v, n) for n, (v, item) in enumerate(rows, 1)}
    return out


def some(rng, rows=150, sources=7):
    words = [f"{a}{b}" for a in ("ka", "Be", "öl", "é", "Z", "中") for b in ("", "x", "Yy", "ß")]
    out = []
    for _ in range(rows):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", "1", "\n"]) for _ in range(rng.randint(0, 30)))
        out.append((text, rng.choice(["en", "de", None]), rng.choice([f"s{n}" for n in range(sources)] + [None])))
    return out + rng.choices(out, k=60)


def rows_of(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    docs = some(random.Random(2))
    monkeypatch.setattr(module, "broadcast_fits", lambda df: small)
    monkeypatch.setattr(module, "UNIT_BYTES", 2_000)
    monkeypatch.setattr(module, "HELD_TERMS", 20)
    monkeypatch.setattr(module, "CELLS", 12)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert rows_of(divergence(df, most_terms=9)) == by_brute(docs, most_terms=9)


def test_a_hot_text_and_a_language_without_kept_terms(spark):
    docs = [("The same words", "en", f"s{n % 3}") for n in range(600)] + [("once only", "fr", "a"), ("123", "fr", "b")]
    docs += [(None, None, None), ("", "", ""), ("long " * 100_000, "en", "s0")]
    got = rows_of(divergence(spark.createDataFrame(docs, SCHEMA)))
    assert got == by_brute(docs)
    assert {r for r in got if r[0] == "fr"} == {("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)}


def test_equal_texts_are_split_once(monkeypatch):
    calls = []
    monkeypatch.setattr(module, "terms", lambda body: calls.append(body) or terms(body))
    import pyarrow as pa

    rows = [("en", "a", "x y"), ("en", "b", "x y"), ("de", "a", "x y"), ("en", "a", "x y")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    units = list(module._units([batch]))
    counts = pa.Table.from_batches(list(module._counted(units))).to_pylist()
    assert sorted(calls) == [b"x y", b"x y"]
    got = {(c["lang"], c["source"], c["term"]): (c["docs"], c["n"]) for c in counts}
    assert got[("en", "a", "x")] == (2, 2) and got[("en", "b", "y")] == (1, 1) and got[("de", "a", "x")] == (1, 1)


def test_texts_of_one_hash_are_told_apart():
    import pyarrow as pa

    schema = ["lang", "print", "body", "sources", "times"]
    columns = [["en"] * 3, [b"1"] * 3, [b"a b", b"c", b"a b"], [["s"], ["s"], ["s", "t"]], [[1], [1], [2, 5]]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema)
    assert [(body, dict(has)) for _, body, has in module._texts([batch])] == [
        (b"a b", {"s": 3, "t": 5}),
        (b"c", {"s": 1}),
    ]


def test_shares_are_exact_for_great_counts(spark):
    rows = [(0, 1), (10**13, 10**13 + 7), (3 * 10**12, 10**16 + 1), (10**15, 10**15 + 1)]
    df = spark.createDataFrame(rows, "n bigint, size bigint").select("n", "size", share(F.col("n"), F.col("size")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + SCALE * (n + 1) // size for n, size in rows]
    far = spark.range(1).select(furtherness(F.lit(10**9 + 1).cast("bigint"), F.lit(1).cast("bigint")).alias("f"))
    assert far.first().f == 10**18


def test_other_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a b", "en", "s")] * 3, SCHEMA).withColumns({"n": F.lit(1), "term": F.lit("x"), "value": F.lit(2)})
    assert rows_of(divergence(df)) == set()
    assert divergence(df.limit(0)).count() == 0
