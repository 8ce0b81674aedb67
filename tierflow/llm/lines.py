"""Line deduplication over content-defined chunks of lines.

A line is hashed, and a rolling hash over the last ``ROLL_LINES`` line hashes
ends a chunk wherever it is divisible by ``DIVISOR``.  Ends so depend on the
lines around them alone: a passage put into another document falls into the same
chunks, whatever stands before it.  A chunk with at least ``MIN_LINES`` lines
that are not blank is removed wherever the same bytes stand earlier, in a
smaller document or further ahead in the same one.  Single lines stay.

Chunks meet by hash and are compared byte by byte.  A task first drops what it
has seen itself, so a chunk in a third of all documents gives a row per
``UNIT_BYTES`` of text; what meets under one hash is read in order, and only the
different texts of that hash are held.

Nulls: a null text stays null and has no lines, a null id comes before all
others.  An empty text is one blank line.  Rows with one id and one text are one
document, each returned alike; rows with one id and different texts are
different documents.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import append_columns, encoded, parts, slices

ROLL_LINES = 2
DIVISOR = 3
MIN_LINES = 2
#: Text a task looks through before it sends chunks on.
UNIT_BYTES = 32 << 20

_FACTOR = 31
_NO_DOC = -(1 << 63)
_ROW = "key bigint, doc bigint, variant bigint, chunk int, body binary"


def line_chunks(text: bytes) -> list[list[bytes]]:
    """The lines of a text, in chunks."""
    chunks: list[list[bytes]] = [[]]
    recent = [0] * ROLL_LINES
    for line in text.split(b"\n"):
        if chunks[-1] and _ends(recent):
            chunks.append([])
        chunks[-1].append(line)
        recent = [*recent[1:], int.from_bytes(hashlib.md5(line).digest()[:4], "big")]
    return chunks


def _ends(recent: list[int]) -> bool:
    rolled = 0
    for value in recent:
        rolled = rolled * _FACTOR + value
    return rolled % DIVISOR == 0


def removable(chunk: list[bytes]) -> bool:
    return sum(1 for line in chunk if line.strip()) >= MIN_LINES


def _units(batches):
    held, size = [], 0
    for piece in slices(batches, "text"):
        for row in zip(
            piece.column("doc").to_pylist(),
            piece.column("variant").to_pylist(),
            encoded(piece.column("text")),
        ):
            held.append(row)
            size += len(row[2])
            if size >= UNIT_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(batches):
    """Chunks that are new to a unit with their bytes, known repeats without."""
    for docs in _units(batches):
        seen: dict[bytes, None] = {}
        rows: list[tuple] = []
        for (doc, variant), body in sorted({(d, v): b for d, v, b in docs}.items()):
            for number, chunk in enumerate(line_chunks(body)):
                if not removable(chunk):
                    continue
                joined = b"\n".join(chunk)
                key = xxhash.xxh3_64_intdigest(joined) - (1 << 63)
                rows.append((key, doc, variant, number, None if joined in seen else joined))
                seen[joined] = None
        yield from _batches(rows, _ROW_TYPES)


_ROW_TYPES = {
    "key": pa.int64(),
    "doc": pa.int64(),
    "variant": pa.int64(),
    "chunk": pa.int32(),
    "body": pa.binary(),
}


def _batches(rows: list[tuple], types: dict[str, pa.DataType], size: int = 2_000):
    for at in range(0, len(rows), size):
        columns = zip(*rows[at : at + size])
        arrays = [pa.array(c, kind) for c, kind in zip(columns, types.values())]
        yield pa.RecordBatch.from_arrays(arrays, names=list(types))


def _repeats(batches):
    """Places of chunks whose bytes stand earlier; rows come sorted by key and place."""
    types = {name: _ROW_TYPES[name] for name in ("doc", "variant", "chunk")}
    current, seen = None, {}
    for batch in batches:
        found = []
        for key, doc, variant, chunk, body in zip(
            *(batch.column(name).to_pylist() for name in _ROW_TYPES)
        ):
            if key != current:
                current, seen = key, {}
            place = (doc, variant, chunk)
            if body is None or seen.setdefault(body, place) != place:
                found.append(place)
        yield from _batches(found, types)


def drop_repeated_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut, and with ``n_lines`` and ``n_removed``.

    ``n_lines`` counts the lines before the cut.  Columns of these names are
    replaced, all others stay.
    """
    tasks = parts(docs.sparkSession)
    keyed = docs.withColumns(
        {
            "__llm_doc": F.coalesce(F.col(doc).cast("bigint"), F.lit(_NO_DOC)),
            "__llm_variant": F.xxhash64(F.col(text)),
        }
    )
    chunks = keyed.select(
        F.col("__llm_doc").alias("doc"), F.col("__llm_variant").alias("variant"), F.col(text).alias("text")
    ).mapInArrow(_rows, _ROW)
    # a known repeat needs no meeting: it goes wherever its document goes
    known = chunks.withColumn(
        "meet", F.when(F.col("body").isNull(), F.xxhash64("doc", "chunk")).otherwise(F.col("key"))
    )
    met = known.repartition(tasks, "meet").sortWithinPartitions("key", "doc", "variant", "chunk")
    repeats = met.select("key", "doc", "variant", "chunk", "body").mapInArrow(
        _repeats, "doc bigint, variant bigint, chunk int"
    )
    listed = repeats.groupBy(
        F.col("doc").alias("__llm_doc"), F.col("variant").alias("__llm_variant")
    ).agg(F.collect_set("chunk").alias("__llm_gone"))
    found = keyed.join(listed, ["__llm_doc", "__llm_variant"], "left")
    results = {text: "string", "n_lines": "bigint", "n_removed": "bigint"}
    order = [*docs.columns, *(name for name in ("n_lines", "n_removed") if name not in docs.columns)]
    return append_columns(found, results, _cut(text), text).select(order)


def _cut(text: str):
    def run(batch):
        texts, n_lines, n_removed = [], [], []
        for known, body, gone in zip(
            batch.column(text).is_valid().to_pylist(),
            encoded(batch.column(text)),
            batch.column("__llm_gone").to_pylist(),
        ):
            lines = body.count(b"\n") + 1 if known else 0
            n_lines.append(lines)
            if not gone:
                texts.append(body.decode() if known else None)
                n_removed.append(0)
                continue
            out = set(gone)
            kept = [line for n, c in enumerate(line_chunks(body)) if n not in out for line in c]
            texts.append(b"\n".join(kept).decode())
            n_removed.append(lines - len(kept))
        return {text: texts, "n_lines": n_lines, "n_removed": n_removed}

    return run
