"""Substring deduplication by hashes of word windows.

A document word goes if some window of ``WINDOW_WORDS`` words that covers it also
starts earlier: in a smaller document, or further ahead in the same one.

Every window is addressed by its anchor, the smallest hash among its runs of
``ANCHOR_WORDS`` words.  Equal windows have equal anchors, so the corpus is
indexed as reference blocks by anchor hash: a shuffle partition is a block, and
holds all windows of its anchors.  Neighbouring windows mostly share an anchor
and travel as one row, with 48 bits of each window's own hash behind the 64 bits
of the anchor.  In a block every window is looked up, those at the ends of a
match too, and refers to the earliest place that has the same hashes.  Runs of
found windows decide what goes.  ``factors`` are made from them, matches that go
on at the same distance in the same reference as one, and decide nothing.

Before the shuffle a task drops what it has seen itself: of equal windows in a
unit of ``UNIT_WORDS`` words only the first travels, the rest are known to
repeat.  A passage in a third of all documents so gives a row per unit.  Anchors
with a large share of all rows in front of different words, found in a 1/16
sample of the documents, are addressed window by window instead; the sample
decides where rows go, never what is found.

In a unit windows are compared by 64 bits of hash, between units by 64 bits of
the anchor's and 48 of their own: windows of one anchor are told apart by 48
bits.  Words are hashed with XXH64 and not compared again.

Nulls: a null text has no words, a null id comes before all others.  Rows with
one id and one text are one document, each returned alike; rows with one id and
different texts are different documents, in an arbitrary but fixed order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import append_columns, encoded, forget, group_stream, parts, slices, stored

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
#: Words a task parses together; a longer document is a unit of its own.
UNIT_WORDS = 1 << 19
#: Buckets of keys for each shuffle partition: one is opened at a time.
BUCKETS = 64
#: One document in so many is counted to find crowded anchors.
SAMPLE = 16
#: An anchor is crowded if it has more rows than this share of a usual partition.
CROWDED_SHARE = 0.25

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NO_DOC = -(1 << 63)
_ROW = "bucket bigint, body binary"
_WINDOWS, _KNOWN = 0, 1
_PRINT_BYTES = 6
_MATCH = "doc bigint, variant bigint, place int, size int, ref_doc bigint, ref_place int"


def _mixed(values: np.ndarray, by: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(by)
    return values ^ (values >> np.uint64(29))


class Unit:
    """Documents parsed together: hashes of their words and of all their windows."""

    def __init__(self, docs: list[tuple[int, int, bytes]], window: int, anchor: int):
        docs = sorted({(doc, variant): body for doc, variant, body in docs}.items())
        hashes, lengths = [], []
        for _, body in docs:
            words = body.split()
            if len(words) >= window:
                hashes.append(
                    np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                )
            lengths.append(len(words) if len(words) >= window else 0)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        ends = np.cumsum(np.array(lengths, np.int64))
        owner = np.repeat(np.arange(len(docs)), lengths)
        ids = np.array([key[0] for key, _ in docs], np.int64)
        variants = np.array([key[1] for key, _ in docs], np.int64)
        count = max(0, len(words) - window + 1)
        inside = np.arange(count) + window <= ends[owner[:count]]
        powers = np.multiply.accumulate(np.full(len(words) + 1, _BASE, np.uint64))
        undo = np.multiply.accumulate(np.full(len(words) + 1, _INVERSE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])
        grams = _mixed((sums[anchor:] - sums[:-anchor]) * undo[: len(sums) - anchor], 0xD6E8FEB86659FD93)
        self.at = np.flatnonzero(inside)
        prints = _mixed((sums[window:] - sums[:-window]) * undo[: len(sums) - window], 0xA0761D6478BD642F)
        self.prints = prints[self.at] if count else prints[:0]
        best, offset = grams[:count].copy(), np.zeros(count, np.int64)
        for j in range(1, window - anchor + 1):
            other = grams[j : j + count]
            lower = other < best
            best[lower] = other[lower]
            offset[lower] = j
        self.anchors = best[self.at]
        self.anchor_at = (offset + np.arange(count))[self.at]
        self.owner = owner[self.at]
        begin = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
        self.doc = ids[self.owner] if len(ids) else ids
        self.variant = variants[self.owner] if len(ids) else ids
        self.place = self.at - begin[self.owner] if len(ids) else ids
        #: Only where ids repeat do variants travel.
        self.varied = bool(variants.any())

    def seen(self) -> np.ndarray:
        """For each window the first equal one of the unit."""
        order = np.argsort(self.prints, kind="stable")
        ranked = self.prints[order]
        first = np.ones(len(order), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        source = np.empty(len(order), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        return source


def _spans(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def _units(batches, unit_words: int):
    held, size = [], 0
    for piece in slices(batches, "text"):
        for row in zip(
            piece.column("doc").to_pylist(),
            piece.column("variant").to_pylist(),
            encoded(piece.column("text")),
        ):
            held.append(row)
            size += len(row[2]) // 6 + 1
            if size >= unit_words:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(batches, window: int, anchor: int, unit_words: int, buckets: int, crowded: np.ndarray):
    """Known repeats of a unit, and its windows in a row for each bucket of keys."""
    for docs in _units(batches, unit_words):
        unit = Unit(docs, window, anchor)
        source = unit.seen()
        again = np.flatnonzero(source != np.arange(len(source)))
        if len(again):
            goes_on = (np.diff(again) == 1) & (np.diff(source[again]) == 1)
            goes_on &= (np.diff(unit.owner[again]) == 0) & (np.diff(unit.owner[source[again]]) == 0)
            starts, sizes = _spans(np.concatenate([[True], ~goes_on]))
            at, ref = again[starts], source[again][starts]
            columns = [unit.doc[at], unit.place[at], sizes, unit.doc[ref], unit.place[ref]]
            columns += [unit.variant[at]] if unit.varied else []
            # any bucket will do for these
            yield _batch([int(unit.prints[0] % np.uint64(buckets))], [_packed(_KNOWN, columns)])
        keys, at, sizes, prints = _addressed(unit, source, crowded)
        if not len(keys):
            continue
        places = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        keys, at, sizes, places = keys[order], at[order], sizes[order], places[order]
        # equal parts of the range of keys, so a bucket is a stretch of the order
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = [*np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        names, bodies, low = [], [], 0
        for high in edges:
            mine = slice(low, high)
            columns = [keys[mine].view(np.int64), unit.doc[at[mine]], unit.place[at[mine]], sizes[mine]]
            columns += [unit.variant[at[mine]]] if unit.varied else []
            step = np.arange(sizes[mine].sum()) - np.repeat(np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
            tail = prints[np.repeat(places[mine], sizes[mine]) + step]
            names.append(int(bucket[low]))
            bodies.append(_packed(_WINDOWS, columns) + tail.tobytes())
            low = high
        yield _batch(names, bodies)


def _addressed(unit: Unit, source: np.ndarray, crowded: np.ndarray):
    """Keys, first windows and sizes of runs of new windows, and all their prints."""
    new = np.flatnonzero(source == np.arange(len(source)))
    alone = np.isin(unit.anchors[new], crowded)
    breaks = np.ones(len(new), bool)
    breaks[1:] = (np.diff(new) != 1) | (np.diff(unit.anchor_at[new]) != 0)
    breaks[1:] |= np.diff(unit.owner[new]) != 0
    starts, sizes = _spans(breaks | alone)
    at = new[starts]
    keys = np.where(alone[starts], _mixed(unit.anchors[at] ^ unit.prints[at], _BASE), unit.anchors[at])
    prints = unit.prints[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PRINT_BYTES]
    return keys, at, sizes, prints


def _batch(names: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(names, pa.int64()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "body"])


def _packed(kind: int, columns: list[np.ndarray]) -> bytes:
    """Columns of longs, byte by byte: the bytes that are alike stand together."""
    rows = len(columns[0])
    planes = [np.array([kind, rows, len(columns)], "<i8").tobytes()]
    for column in columns:
        planes.append(column.astype("<i8").view(np.uint8).reshape(rows, 8).T.tobytes())
    return b"".join(planes)


def _unpacked(body: bytes) -> tuple[int, list[np.ndarray], np.ndarray]:
    kind, rows, count = np.frombuffer(body, "<i8", 3).tolist()
    end = 24 + 8 * rows * count
    planes = np.frombuffer(body, np.uint8, end - 24, 24).reshape(count, 8, rows)
    columns = [np.ascontiguousarray(plane.T).view("<i8").ravel() for plane in planes]
    return kind, columns, np.frombuffer(body, np.uint8, -1, end)


def _key_counts(batches, window: int, anchor: int, unit_words: int):
    none = np.zeros(0, np.uint64)
    for docs in _units(batches, unit_words):
        unit = Unit(docs, window, anchor)
        keys, counts = np.unique(_addressed(unit, unit.seen(), none)[0], return_counts=True)
        arrays = [pa.array(keys.view(np.int64)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "n"])


def _matches(rows: pa.Table):
    """Windows of a bucket that have an earlier equal, as runs."""
    found, prints = [], []
    for body in rows.column("body").to_pylist():
        kind, columns, tail = _unpacked(body)
        if kind == _KNOWN:
            yield _match_batch(_with_variant(columns, 5))
        else:
            found.append(_with_variant(columns, 4))
            prints.append(tail)
    if not found:
        return
    keys, docs, places, sizes, variants = (np.concatenate(parts) for parts in zip(*found))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    shared = np.zeros(len(ranked), bool)
    shared[1:] = ranked[1:] == ranked[:-1]
    shared[:-1] |= shared[1:].copy()
    open_ = np.sort(order[shared])
    if not len(open_):
        return
    tails = np.concatenate(prints).reshape(-1, _PRINT_BYTES)
    first = (np.cumsum(sizes) - sizes)[open_]
    sizes = sizes[open_]
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, docs, places = keys[open_][row], docs[open_][row], places[open_][row] + step
    variants = variants[open_][row]
    prints = np.zeros((len(row), 8), np.uint8)
    prints[:, :_PRINT_BYTES] = tails[first[row] + step]
    prints = prints.view("<u8").ravel()
    order = np.lexsort((places, variants, docs, prints, keys))
    first = np.ones(len(order), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]) | (prints[order][1:] != prints[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    source = np.empty(len(order), np.int64)
    source[order] = head
    repeat = (docs[source] != docs) | (places[source] != places) | (variants[source] != variants)
    again = np.flatnonzero(repeat)
    if not len(again):
        return
    ref = source[again]
    goes_on = (np.diff(again) == 1) & (np.diff(row[again]) == 0)
    goes_on &= (np.diff(docs[ref]) == 0) & (np.diff(variants[ref]) == 0) & (np.diff(places[ref]) == 1)
    starts, counts = _spans(np.concatenate([[True], ~goes_on]))
    at, ref = again[starts], ref[starts]
    yield _match_batch([docs[at], places[at], counts, docs[ref], places[ref], variants[at]])


def _with_variant(columns: list[np.ndarray], count: int) -> list[np.ndarray]:
    return columns if len(columns) > count else [*columns, np.zeros(len(columns[0]), np.int64)]


def _match_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    doc, place, size, ref_doc, ref_place, variant = columns
    columns = [doc, variant, place, size, ref_doc, ref_place]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    arrays = [pa.array(np.ascontiguousarray(c)).cast(kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "variant", "place", "size", "ref_doc", "ref_place"])


def repeated_runs(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    anchor: int = ANCHOR_WORDS,
    unit_words: int = UNIT_WORDS,
) -> DataFrame:
    """Runs of windows with an earlier equal, for ``docs`` (doc, variant, text)."""
    spark = docs.sparkSession
    tasks = parts(spark)
    shape = (window, anchor, unit_words)
    sample = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(lambda b: _key_counts(b, *shape), "key bigint, n bigint")
    counts = counts.groupBy("key").agg(F.sum("n").alias("count"))
    hot = np.array(sorted(_crowded(counts, tasks)), np.int64).view(np.uint64)
    buckets = tasks * BUCKETS
    indexed = docs.mapInArrow(lambda b: _rows(b, *shape, buckets, hot), _ROW)
    indexed = indexed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return indexed.mapInArrow(lambda b: group_stream(b, ["bucket"], _matches), _MATCH)


def _crowded(counts: DataFrame, tasks: int) -> list[int]:
    """Keys with over a share of a partition's rows: at most ``tasks`` / share of them."""
    counts = stored(counts, "anchors")
    total = counts.agg(F.sum("count")).first()[0] or 0
    over = max(SAMPLE, total * CROWDED_SHARE / tasks)
    keys = [row.key for row in counts.where(F.col("count") > over).collect()]
    forget(counts)
    return keys


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW_WORDS,
    anchor: int = ANCHOR_WORDS,
    doc: str = "doc_id",
    text: str = "text",
    unit_words: int = UNIT_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` and ``factors``.

    ``kept`` are the words left, joined by a space.  A factor is a stretch of
    words (``start``, ``n_words``) copied from word ``ref_start`` of ``ref_doc``.
    """
    keyed = docs.withColumns(
        {
            "__llm_doc": F.coalesce(F.col(doc).cast("bigint"), F.lit(_NO_DOC)),
            "__llm_variant": F.xxhash64(F.col(text)),
        }
    )
    # the variant tells texts of one id apart: where there are none, it need not travel
    texts = keyed.groupBy("__llm_doc").agg(F.min("__llm_variant").alias("a"), F.max("__llm_variant").alias("b"))
    if texts.where("a < b").isEmpty():
        keyed = keyed.withColumn("__llm_variant", F.lit(0).cast("bigint"))
    runs = repeated_runs(
        keyed.select(
            F.col("__llm_doc").alias("doc"), F.col("__llm_variant").alias("variant"), F.col(text).alias("text")
        ),
        window,
        anchor,
        unit_words,
    )
    ref_doc = F.when(F.col("ref_doc") != _NO_DOC, F.col("ref_doc"))
    listed = runs.groupBy(
        F.col("doc").alias("__llm_doc"), F.col("variant").alias("__llm_variant")
    ).agg(
        F.collect_list(
            F.struct(
                F.col("place").alias("start"),
                F.col("size").alias("size"),
                ref_doc.alias("ref_doc"),
                F.col("ref_place").alias("ref_start"),
            )
        ).alias("__llm_runs")
    )
    found = keyed.join(listed, ["__llm_doc", "__llm_variant"], "left")
    results = {
        "n_words": "bigint",
        "n_removed": "bigint",
        "kept": "string",
        "factors": "array<struct<start:int,n_words:int,ref_doc:bigint,ref_start:int>>",
    }
    out = append_columns(found, results, _cut(window, text), text)
    return out.drop("__llm_doc", "__llm_variant", "__llm_runs")


def _cut(window: int, text: str):
    def run(batch):
        n_words, n_removed, kept, factors = [], [], [], []
        for body, runs in zip(encoded(batch.column(text)), batch.column("__llm_runs").to_pylist()):
            words = body.split()
            n_words.append(len(words))
            if not runs:
                n_removed.append(0)
                kept.append(b" ".join(words).decode())
                factors.append([])
                continue
            parse: list[dict] = []
            stay = np.ones(len(words), bool)
            for one in sorted(runs, key=lambda r: r["start"]):
                end = one["start"] + one["size"] + window - 1
                stay[one["start"] : end] = False
                last = parse[-1] if parse else None
                same = last and (last["ref_doc"], last["ref_start"] - last["start"]) == (
                    one["ref_doc"],
                    one["ref_start"] - one["start"],
                )
                if same and one["start"] <= last["start"] + last["n_words"] - window + 1:
                    last["n_words"] = max(last["n_words"], end - last["start"])
                else:
                    parse.append(
                        {
                            "start": one["start"],
                            "n_words": end - one["start"],
                            "ref_doc": one["ref_doc"],
                            "ref_start": one["ref_start"],
                        }
                    )
            n_removed.append(int((~stay).sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]).decode())
            factors.append(parse)
        return {"n_words": n_words, "n_removed": n_removed, "kept": kept, "factors": factors}

    return run
