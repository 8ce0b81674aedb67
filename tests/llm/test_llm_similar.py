import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tierflow.llm import similar
from tierflow.llm.similar import bands, first_of_similar, shingles, similarity

DOCS = "doc_id bigint, text string"


def shingle_set(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def firsts(docs, least=0.8):
    """Smallest ids of the groups of rows (doc_id, text), ids distinct."""
    docs = sorted(docs)
    sets, root = [shingle_set(text) for _, text in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) >= least * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [doc for place, (doc, _) in enumerate(docs) if find(place) == place]


def copies(seed, groups=25):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 300))]
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                changed[rng.randrange(len(words))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(changed)))
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a c")]


def test_what_stays_equals_brute_force(spark, monkeypatch):
    docs = copies(1)
    expected = firsts(docs)
    assert 40 < len(expected) < len(docs) - 40
    for block in (512, 3):
        monkeypatch.setattr(similar, "BLOCK_TEXTS", block)
        kept = first_of_similar(spark.createDataFrame(docs, DOCS)).collect()
        assert sorted(r.doc_id for r in kept) == expected


def test_the_stage_drops_copies_that_differ_in_more_than_four_bits(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    # 0.83 of the shingles of 1 and 177 are the same, their fingerprints differ in 9 bits
    assert 1 in kept and 177 not in kept
    assert sorted(kept) == firsts([(r.doc_id, r.text) for r in docs.collect()])


def test_similar_sets_share_a_band():
    rng = random.Random(7)
    for size in (10, 100, 1000):
        for _ in range(300):
            words = [str(rng.random()).encode() for _ in range(size)]
            own = shingles(words, 1)
            same = -(-size * 8 // 9)
            other = rng.sample(own.tolist(), same) + [rng.getrandbits(64) for _ in range(size - same)]
            other = np.unique(np.array(other, np.uint64))
            assert similarity(own, other) >= 0.8
            assert set(bands(own).tolist()) & set(bands(other).tolist())


def test_one_row_of_each_group_stays(spark):
    docs = [(3, "a b c"), (1, "a b c"), (1, "a b c"), (1, "x y z w v"), (None, "a b c"), (None, "only"), (9, None), (8, "")]
    df = spark.createDataFrame(docs, DOCS).withColumn("lang", F.lit("en")).withColumn("bands", F.lit("mine"))
    kept = first_of_similar(df)
    assert kept.columns == df.columns
    rows = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert rows == [("1", "a b c"), ("1", "x y z w v"), ("8", ""), ("None", "only")]
    assert first_of_similar(df.limit(0)).count() == 0


def test_templated_texts_are_told_apart_fast(spark):
    """Texts that share 0.44 of their shingles meet by their bands but are no copies."""
    import time

    rng = random.Random(3)
    # of 100 words 72 are the same: some 61 of 96 shingles
    common = [f"c{n}" for n in range(66)]
    docs = [(n, " ".join(common + [f"u{n}-{i}" for i in range(38)])) for n in range(4_000)]
    sets = [shingle_set(text) for _, text in rng.sample(docs, 2)]
    assert 0.4 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.5
    began = time.time()
    assert first_of_similar(spark.createDataFrame(docs, DOCS)).count() == 4_000
    assert time.time() - began < 100
