import random

import brute
from pyspark.sql import functions as F
from tierflow.llm.components import connected_components
from tierflow.llm.simhash import (
    first_of_groups,
    near_duplicates,
    near_links,
    unary_counts,
    with_fingerprints,
)

DOCS = "doc_id bigint, text string"
TEXTS = ["one two three four five six seven", "One two THREE four five six seven", "a b", "a  b\n", "", None, " \t", "ÄB c d e"]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_equal_brute_force(spark):
    docs = [(n, text) for n, text in enumerate([*TEXTS, "long " * 3 + "text words " * 80_000])]
    rows = with_fingerprints(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {n: signed(brute.simhash(t)) for n, t in docs}


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(signed(v),) for v in values], "x bigint")
    codes = [r.u % (1 << 64) for r in df.select(unary_counts(F.col("x")).alias("u")).collect()]

    def counts(v):
        return [(v >> i & 3).bit_count() for i in range(0, 64, 2)]

    for a, b, ca, cb in zip(values, values[1:], codes, codes[1:]):
        manhattan = sum(abs(x - y) for x, y in zip(counts(a), counts(b)))
        assert (ca ^ cb).bit_count() == manhattan <= (a ^ b).bit_count()


def linked(spark, values, **more):
    prints = spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fingerprint bigint")
    links = near_links(prints, **more).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= more.get("max_distance", 4) for r in links)
    return links


def classes(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        a, b = sorted((find(r.a % (1 << 64)), find(r.b % (1 << 64))))
        root[b] = a
    return [find(v) for v in values]


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    values = [0, MASK64, 1, 15]
    for _ in range(60):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(4):
            near = base
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << bit
            values.append(near)
    values = sorted(set(values))
    expected = [values[i] for i in brute.groups(values)]
    assert classes(values, linked(spark, values)) == expected
    expected = [values[i] for i in brute.groups(values, 2)]
    assert classes(values, linked(spark, values, max_distance=2)) == expected


def test_a_crowded_cell_is_cut_and_gives_few_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    near = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})[:900]
    values = sorted({*near, *(rng.getrandbits(64) for _ in range(300))})
    links = linked(spark, values)
    assert classes(values, links) == [values[i] for i in brute.groups(values)]
    assert len(links) < 40 * len(values)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    nodes = list(range(400))
    rng.shuffle(nodes)
    links = list(zip(nodes[:100], nodes[1:100]))  # a path
    links += [(nodes[100], n) for n in nodes[101:200]]  # a star
    links += [(nodes[200], nodes[200]), (nodes[300], nodes[301]), (nodes[301], nodes[300])]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    root = {r.node: r.root for r in found.collect()}
    assert len({root[n] for n in nodes[:100]}) == 1 == len({root[n] for n in nodes[100:200]})
    assert root[nodes[300]] == root[nodes[301]]
    assert len(set(root.values())) == 3 and nodes[200] not in root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = rows[:400] + [(10_000 + n, text) for n, text in enumerate(TEXTS)] + rows[:1] + [(None, rows[1][1]), (None, "alone")]
    found = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = [brute.simhash(text) for _, text in rows]
    first = brute.groups(prints)
    names = {}
    for (doc, _), group in zip(rows, first):
        if doc is not None:
            names[group] = min(doc, names.get(group, doc))
    expected = sorted((str(doc), signed(p), str(names.get(g))) for (doc, _), p, g in zip(rows, prints, first))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def test_one_row_of_each_group_stays(spark):
    docs = [(3, "a b c"), (1, "a b c"), (1, "a b c"), (1, "x y z w v"), (None, "a b c"), (None, "only"), (9, None), (8, "")]
    df = spark.createDataFrame(docs, DOCS).withColumn("lang", F.lit("en")).withColumn("fingerprint", F.lit("mine"))
    kept = first_of_groups(df)
    assert kept.columns == df.columns
    rows = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert rows == [("1", "a b c"), ("1", "x y z w v"), ("8", ""), ("None", "only")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0 and first_of_groups(empty).count() == 0


MASK64 = (1 << 64) - 1
