import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tierflow.llm import rules
from tierflow.llm.rules import COUNTS, bucket, judged, measured

SCHEMA = "doc_id bigint, text string, lang string, source string"
WORDS = [f"w{n}" for n in range(3_000)]


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
    )


def prose(rng, size=120, symbols=0.0):
    return " ".join(rng.choice(WORDS) + ("#" if rng.random() < symbols else "") for _ in range(size))


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a b", "a b c a b c", "x " * 500, "a\u00a0b \U0001f600 #\n\n \na\na", "\v\f\r a"]
    for _ in range(60):
        few = rng.sample(WORDS, rng.randint(1, 40))
        between = [" ", "\n", "  ", "\t", "\n\n"]
        texts.append("".join(rng.choice(few) + rng.choice(between) for _ in range(rng.randint(1, 300))))
    texts.append(prose(rng, 60_000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in measured(df).collect():
        got = tuple(r[name] for name in COUNTS)
        assert got == counts_of(texts[r.doc_id]), texts[r.doc_id][:80]
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_buckets_are_narrow(spark):
    rows = spark.range(5_000).select("id", bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id <= r.b + r.b // 32 for r in rows)
    assert [r.b for r in rows[:64]] == list(range(64))
    assert len({r.b for r in rows}) < 300


def many(rng):
    """A source of prose, one where symbols are usual, junk in both, and small sources."""
    docs, junk = [], set()
    for n in range(1_200):
        source = ("prose", "code")[n % 2]
        usual = 0.0 if source == "prose" else 0.4 + rng.random() * 0.2
        if rng.random() < 0.2:
            junk.add(n)
            usual = 1.0 if source == "prose" else 6.0
        text = prose(rng, symbols=usual) if usual <= 1 else prose(rng).replace(" ", "###### ")
        docs.append((n, text, "en", source))
    docs += [(2_000 + n, prose(rng), "en", f"small{n}") for n in range(20)]
    docs += [(3_000 + n, prose(rng), None, None) for n in range(20)]
    return docs, junk


@pytest.mark.parametrize("fits", [True, False])
def test_cutoffs_follow_the_source(spark, monkeypatch, fits):
    monkeypatch.setattr(rules, "broadcast_fits", lambda df: fits)
    docs, junk = many(random.Random(6))
    got = {r.doc_id: r.kept for r in judged(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(got) == len(docs)
    assert {doc for doc, kept in got.items() if not kept} == junk


def test_what_fails_by_itself_is_never_kept(spark):
    rows = [(1, "word " * 60, "en", "a"), (2, "few words", "en", "a"), (3, None, None, None), (4, "", "en", None)]
    rows += [(5, prose(random.Random(1)), "en", "a")] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in judged(df).collect())
    assert got == [(1, True, False), (2, True, False), (3, True, False), (4, True, False), (5, False, True), (5, False, True)]
    assert judged(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    rows = judged(spark.createDataFrame([(1, "a b", "en", "a")], SCHEMA))
    plans = rows._jdf.queryExecution().executedPlan().toString()
    plans += measured(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plans for word in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))
