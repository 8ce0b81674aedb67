"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A fingerprint is mapped to the number of set bits in each of its segments.  The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints, as a differing bit moves one count by one.  Counts are kept in
unary, segment by segment, so a vector is again 64 bits and the Manhattan
distance of two vectors the number of bits in which they differ.

Grid: the segments are dealt to ``max_distance + 2`` groups.  Vectors within
``max_distance`` differ in at most that many groups, so at least two groups
agree; a cell is the counts of two groups, and every fingerprint stands in the
cells of all pairs of groups.  Within a cell, pairs pass the Manhattan bound and
are then compared bit by bit.

Only distinct fingerprints take part, so copies cost one row.  A cell with more
rows than a shuffle partition has on average is cut into blocks, and each pair
of blocks is a task of its own.  Of the links of a cell a spanning forest is
kept: components are the same, and a group of near copies gives as many links as
it has members, not their square.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import append_columns, encoded, group_stream, parts, stored
from .components import connected_components

MAX_DISTANCE = 4
SHINGLE_WORDS = 4
HASH_SEED = 42
SEGMENT_BITS = 2
#: Rows of one block of a crowded cell: a pair of blocks compares at most its square.
BLOCK_ROWS = 65_536
#: Groups of at most this many rows are compared by shifting, larger ones row by row.
SMALL_GROUP = 24
#: Shingles hashed before their bits are summed.
SHINGLE_SLICE = 65_536

_LAST_DOC = (1 << 63) - 1


def with_fingerprints(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    text: str = "text",
    column: str = "fingerprint",
) -> DataFrame:
    """``docs`` with the 64-bit SimHash of each text as a signed long.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    runs of ``shingle_words`` words, repeats counted; fewer words are one
    shingle.  A null, empty or blank text has fingerprint zero.
    """

    def compute(batch):
        made = [fingerprint(body.lower().split(), shingle_words) for body in encoded(batch.column(text))]
        return {column: pa.array(np.array(made, np.uint64).view(np.int64))}

    return append_columns(docs, {column: "bigint"}, compute, text)


def fingerprint(words: list[bytes], size: int = SHINGLE_WORDS) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLE_SLICE):
        hashes = np.array(
            [
                digest(joined[a:b], HASH_SEED)
                for a, b in zip(first[at : at + SHINGLE_SLICE], last[at : at + SHINGLE_SLICE])
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(sums * 2 > len(first), bitorder="little")
    return int(chosen.view("<u8")[0])


def unary_counts(bits: Column) -> Column:
    """Each pair of bits sorted: the number of set bits of a segment, in unary."""
    odd = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned(bits, 1).bitwiseAND(odd), bits.bitwiseAND(odd)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def group_masks(groups: int) -> list[int]:
    """Bit masks of the segment groups, of sizes that differ by one segment at most."""
    segments = 64 // SEGMENT_BITS
    edges = [segments * g // groups * SEGMENT_BITS for g in range(groups + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]


def near_links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) that connect what ``max_distance`` differing bits connect.

    ``prints`` has one row per distinct ``fingerprint``.
    """
    spark = prints.sparkSession
    masks = [a | b for a, b in combinations(group_masks(max_distance + 2), 2)]
    places = [
        F.struct(
            F.lit(number).alias("pair"),
            F.col("counts").bitwiseAND(F.lit(_signed(mask))).alias("cell"),
        )
        for number, mask in enumerate(masks)
    ]
    cells = (
        prints.select("fingerprint", unary_counts(F.col("fingerprint")).alias("counts"))
        .select("fingerprint", "counts", F.explode(F.array(*places)).alias("place"))
        .select("place.*", "fingerprint", "counts")
    )
    # a crowded cell has more rows than a partition has on average, so there are
    # fewer of them than partitions, and their list is small enough to broadcast
    tasks = parts(spark)
    usual = max(1, prints.count() * len(masks) // tasks)
    sizes = cells.groupBy("pair", "cell").count().where(F.col("count") > usual)
    blocks = F.greatest(
        F.ceil(2 * F.sqrt(F.col("count") / usual)), F.ceil(F.col("count") / BLOCK_ROWS)
    )
    crowded = sizes.select("pair", "cell", blocks.cast("int").alias("blocks"))
    dealt = cells.join(F.broadcast(crowded), ["pair", "cell"], "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(
        F.when(
            F.col("blocks").isNotNull(),
            F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")),
        ).otherwise(F.array(F.lit(0)))
    )
    dealt = (
        dealt.withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", other)
        .select(
            "pair",
            "cell",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "fingerprint",
            "counts",
        )
    )
    keys = ["pair", "cell", "low", "high"]
    dealt = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches):
        yield from group_stream(batches, keys, lambda t: _cell_links(t, keys, max_distance))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _cell_links(rows: pa.Table, keys: list[str], limit: int):
    column = lambda name: rows.column(name).to_numpy()
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = column(key)
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, rows.num_rows))
    prints, counts = column("fingerprint").view(np.uint64), column("counts").view(np.uint64)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)[small]
    left, right = [], []
    few, few_counts = prints[small], counts[small]
    for shift in range(1, SMALL_GROUP):
        pairs = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(pairs):
            break
        near = np.bitwise_count(few_counts[pairs] ^ few_counts[pairs + shift]) <= limit
        pairs = pairs[near]
        pairs = pairs[np.bitwise_count(few[pairs] ^ few[pairs + shift]) <= limit]
        left.append(few[pairs])
        right.append(few[pairs + shift])
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        for a, b in _forest(prints[start : start + size], counts[start : start + size], limit):
            left.append(a)
            right.append(b)
    if left:
        a, b = (np.concatenate(side).view(np.int64) for side in (left, right))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"]
            )


def _forest(prints: np.ndarray, counts: np.ndarray, limit: int):
    """Links of a breadth-first search: who is reached is not compared again."""
    left = np.arange(1, len(prints))
    todo = [0]
    while len(left):
        if not todo:
            todo.append(left[0])
            left = left[1:]
        at = todo.pop()
        near = np.flatnonzero(np.bitwise_count(counts[left] ^ counts[at]) <= limit)
        near = near[np.bitwise_count(prints[left[near]] ^ prints[at]) <= limit]
        if len(near):
            reached = left[near]
            yield np.full(len(near), prints[at]), prints[reached]
            todo.extend(reached.tolist())
            left = np.delete(left, near)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(
    docs: DataFrame,
    max_distance: int = MAX_DISTANCE,
    shingle_words: int = SHINGLE_WORDS,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint``, ``component_id``.

    The component is named by the smallest id reachable over fingerprints that
    differ in at most ``max_distance`` bits.  A null id is never the smallest
    unless all ids of the component are null; then the component is null.
    Repeated rows are each returned.  An empty table gives no rows.
    """
    narrow = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(
        with_fingerprints(narrow, shingle_words).select("doc_id", "fingerprint"), "fingerprints"
    )
    lowest = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("lowest")), "lowest")
    rooted = lowest.join(linked_roots(lowest, max_distance), "fingerprint")
    named = rooted.groupBy("root").agg(F.min("lowest").alias("named"))
    linked = rooted.join(named, "root").select("fingerprint", "named")
    components = lowest.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("named", "lowest").alias("component_id")
    )
    # stored, so that the join below stands alone and a hot fingerprint can be split
    components = stored(components, "components")
    return prints.join(components, "fingerprint").select("doc_id", "fingerprint", "component_id")


def linked_roots(prints: DataFrame, max_distance: int) -> DataFrame:
    """``fingerprint`` and ``root`` of those fingerprints that have a link."""
    roots = connected_components(near_links(prints, max_distance))
    return roots.withColumnRenamed("node", "fingerprint")


def first_of_groups(
    docs: DataFrame,
    max_distance: int = MAX_DISTANCE,
    shingle_words: int = SHINGLE_WORDS,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of each component.

    Null ids come last; of one id with several texts the one with the smallest
    hash stays, of repeated rows one.
    """
    keys = {
        "__llm_doc": F.coalesce(F.col(doc).cast("bigint"), F.lit(_LAST_DOC)),
        "__llm_variant": F.xxhash64(F.col(text)),
    }
    keyed = docs.withColumns(keys)
    narrow = keyed.select("__llm_doc", "__llm_variant", F.col(text).alias("text"))
    place = F.struct("__llm_doc", "__llm_variant").alias("place")
    prints = with_fingerprints(narrow, shingle_words).select("fingerprint", place)
    lowest = stored(prints.groupBy("fingerprint").agg(F.min("place").alias("place")), "lowest")
    rooted = lowest.join(linked_roots(lowest, max_distance), "fingerprint", "left")
    group = F.coalesce("root", "fingerprint").alias("group")
    firsts = rooted.groupBy(group).agg(F.min("place").alias("place")).select("place.*")
    kept = keyed.join(firsts, ["__llm_doc", "__llm_variant"], "left_semi")
    return kept.dropDuplicates(["__llm_doc", "__llm_variant"]).select(docs.columns)
