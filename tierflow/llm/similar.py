"""Near copies by exact similarity: candidates of two kinds, each pair checked.

Texts are sets of shingles of ``SHINGLE_WORDS`` words, A-Z lower-cased.  Two texts
are near copies if their sets have a Jaccard similarity of ``SIMILARITY`` or more;
groups are what near copies connect.

Candidates: fingerprints within ``MAX_DISTANCE`` bits, from the grid join, and texts
that share a band, ``BAND_ROWS`` minima of ``BANDS`` times as many hash functions.
A pair at similarity s shares no band with chance ``(1 - s**4)**24``: 3e-6 at 0.8.
A wider fingerprint radius would do it too, but near 16 bits, where a grid no longer
narrows anything down.

What candidates connect meets in a task, so candidates only decide who meets.  There a
pair is compared by its whole sets, if their sizes allow it and the bytes of their minima
agree in 0.6 at least: at a similarity of 0.8 that fails with a chance of some 1e-6.  A group of more than ``BLOCK_TEXTS`` texts is cut into blocks, and
each pair of blocks is a task of its own.  Of the links a spanning forest is kept.
Equal texts cost one row, and a task sends on a band it has seen but once.

A text of fewer words is one shingle; null, empty and blank texts are one text.  Texts
of any length are taken whole.  An empty table gives no rows; columns of any names stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from tierflow.operators import broadcast_fits

from .common import append_columns, encoded, group_stream, parts, stored
from .components import connected_components
from .simhash import MAX_DISTANCE, fingerprint, near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 4
#: Texts of one block of a large group: a pair of blocks is compared in one task.
BLOCK_TEXTS = 512
#: Texts whose bands a task remembers.
UNIT_TEXTS = 20_000
#: Pairs whose sketches agree in so much less are not compared: five standard deviations.
SKETCH_MARGIN = 0.2
#: Shingles multiplied at a time.
SLICE = 4_096

_LAST_DOC = (1 << 63) - 1
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    made = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, made), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        np.minimum(low, (hashes[at : at + SLICE, None] * _FACTORS).min(axis=0), out=low)
    return low


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band; texts that agree in all minima of a band have its key in common."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in minima(hashes).reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; that of empty ones is one."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _signed(batch):
    contents, prints, keys = [], [], []
    for body in encoded(batch.column("text")):
        words = body.lower().split()
        contents.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
        prints.append(fingerprint(words, SHINGLE_WORDS))
        keys.append(bands(shingles(words)).view(np.int64))
    long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
    return {"content": long(contents), "fingerprint": long(prints), "bands": keys}


def _band_rows(batches):
    """Bands that are new to a unit, with the fingerprint; others as a link to the first."""
    seen: dict[int, int] = {}
    count = 0
    for batch in batches:
        rows = []
        for node, keys in zip(batch.column("fingerprint").to_pylist(), batch.column("bands").to_pylist()):
            if count % UNIT_TEXTS == 0:
                seen = {}
            count += 1
            links = set()
            for key in keys:
                first = seen.setdefault(key, node)
                # a known band needs no meeting: any place will do for its link
                if first == node:
                    rows.append((key, node, None))
                elif first not in links:
                    links.add(first)
                    rows.append((node, node, first))
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b"])


def _band_links(batches):
    """Links of rows sorted by key: each to the one before with its key."""
    last_key, last_node = None, None
    for batch in batches:
        found = []
        for key, a, b in zip(*(batch.column(name).to_pylist() for name in ("key", "a", "b"))):
            if b is not None:
                found.append((a, b))
                continue
            if key == last_key and a != last_node:
                found.append((a, last_node))
            last_key, last_node = key, a
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def candidate_links(contents: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints, for ``contents`` (fingerprint, bands)."""
    tasks = parts(contents.sparkSession)
    rows = contents.select("fingerprint", "bands").mapInArrow(_band_rows, "key bigint, a bigint, b bigint")
    met = rows.repartition(tasks, "key").sortWithinPartitions("key")
    prints = stored(contents.select("fingerprint").distinct(), "fingerprints")
    return met.mapInArrow(_band_links, "a bigint, b bigint").union(near_links(prints, MAX_DISTANCE))


def _shingled(batch):
    return {"body": [shingles(body.lower().split()).tobytes() for body in encoded(batch.column("text"))]}


def _similar(least: float):
    def run(rows: pa.Table):
        nodes = rows.column("content").to_pylist()
        sets = [np.frombuffer(body, np.uint64) for body in rows.column("body").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        # a byte of each minimum: how many agree tells the similarity to within 0.041
        sketches = np.array([minima(s).astype(np.uint8) for s in sets]).reshape(len(sets), -1)
        agreeing = (least - SKETCH_MARGIN) * sketches.shape[1]
        left, todo, found = np.arange(1, len(nodes)), [0], []
        while len(left):
            if not todo:
                todo.append(int(left[0]))
                left = left[1:]
            at = todo.pop()
            # sets of too different sizes cannot be similar
            fits = np.minimum(sizes[left], sizes[at]) >= least * np.maximum(sizes[left], sizes[at])
            some = np.flatnonzero(fits)
            agree = np.count_nonzero(sketches[left[some]] == sketches[at], axis=1)
            some = some[agree >= agreeing]
            near = np.array([i for i in some if similarity(sets[at], sets[left[i]]) >= least], int)
            reached = left[near]
            found += [(nodes[at], nodes[i]) for i in reached]
            todo.extend(reached.tolist())
            left = np.delete(left, near)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def similar_links(texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of contents at least so similar, for ``texts`` (root, content, body, blocks)."""
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    others = F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))
    dealt = (
        texts.withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array(F.lit(0)))))
        .select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "content", "body")
    )
    keys = ["root", "low", "high"]
    dealt = dealt.repartition(parts(texts.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda b: group_stream(b, keys, _similar(least)), "a bigint, b bigint")


def first_of_similar(
    docs: DataFrame, least: float = SIMILARITY, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of each group of near copies.

    Null ids come last; of one id with several texts the one with the smallest
    hash stays, of repeated rows one.
    """
    keys = {
        "__llm_doc": F.coalesce(F.col(doc).cast("bigint"), F.lit(_LAST_DOC)),
        "__llm_variant": F.xxhash64(F.col(text)),
    }
    keyed = docs.withColumns(keys)
    narrow = keyed.select("__llm_doc", "__llm_variant", F.col(text).alias("text"))
    made = {"content": "bigint", "fingerprint": "bigint", "bands": "array<bigint>"}
    place = F.struct("__llm_doc", "__llm_variant")
    contents = stored(
        append_columns(narrow, made, _signed)
        .groupBy("content")
        .agg(F.min(place).alias("place"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")),
        "contents",
    )
    roots = connected_components(candidate_links(contents)).withColumnRenamed("node", "fingerprint")
    root = F.coalesce("root", "fingerprint").alias("root")
    members = stored(contents.join(roots, "fingerprint", "left").select(root, "content", "place"), "members")
    blocks = F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks")
    groups = members.groupBy("root").agg(blocks, F.count("*").alias("n")).where("n > 1").drop("n")
    # stored, so that the join does not share the partitioning of the count and a large group can be split
    groups = stored(groups, "groups")
    if broadcast_fits(groups):
        groups = F.broadcast(groups)
    met = members.join(groups, "root").select("root", "content", "blocks", "place.*")
    texts = narrow.join(met, ["__llm_doc", "__llm_variant"]).dropDuplicates(["content"])
    bodies = append_columns(texts, {"body": "binary"}, _shingled).select("root", "content", "blocks", "body")
    linked = connected_components(similar_links(bodies, least)).withColumnRenamed("node", "content")
    group = F.coalesce(linked["root"], members["content"]).alias("group")
    firsts = members.join(linked, "content", "left").groupBy(group).agg(F.min("place").alias("place"))
    kept = keyed.join(firsts.select("place.*"), ["__llm_doc", "__llm_variant"], "left_semi")
    return kept.dropDuplicates(["__llm_doc", "__llm_variant"]).select(docs.columns)
