"""Benchmark decontamination with an Aho-Corasick automaton over item windows.

Items and texts are normalised alike: A-Z lower-cased, words are runs of ASCII
letters and digits and of any character beyond ASCII, joined by one space.  A
pattern is a window of consecutive item words (a shorter item is one pattern),
with a space at either end so that it matches whole words only.  Each text is
scanned once per automaton; normalising maps bytes to bytes one to one, so a hit
word's place in the original text is known.

One automaton holds the patterns up to ``AUTOMATON_CHARS`` characters, measured
before anything is collected; more patterns are dealt by hash to further
automata of that size, which scan one after the other without a shuffle.

Nulls: a null text has no words, a null item text no windows; windows of an item
without an id count as hits, the item is not listed.  Empty tables, repeated
rows and ids: each row is judged alone, an item id listed once.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import append_columns, encoded, stored

WINDOW_WORDS = 10
#: Pattern characters of one automaton: about 45 bytes each where it is built and used.
AUTOMATON_CHARS = 4_000_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def item_windows(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """One row per distinct window, with the ids of the items that hold it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.string()).to_pylist()
            windows, owners = [], []
            for name, body in zip(ids, encoded(batch.column(1))):
                words = normal_words(body)
                for start in range(max(1, len(words) - window + 1) if words else 0):
                    windows.append(b" ".join(words[start : start + window]).decode())
                    owners.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.string()), pa.array(owners, pa.string())],
                names=["pattern", "item"],
            )

    rows = benchmark.select(item, text).mapInArrow(run, "pattern string, item string")
    return rows.groupBy("pattern").agg(F.collect_set("item").alias("items"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    ``items`` are the ids, as strings in order, of items with a window in the
    text; ``spans`` the hit stretches as start and end character of the original
    text.  Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    patterns = stored(item_windows(benchmark, window, item, item_text), "patterns")
    weight = F.sum(F.length("pattern") + 2 + F.size("items") * 8)
    total = patterns.agg(weight).first()[0] or 0
    shards = max(1, -(-int(total) // automaton_chars))
    states = {"__llm_start": "array<int>", "__llm_end": "array<int>", "__llm_found": "array<string>"}
    for shard in range(shards):
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
        automaton = ahocorasick.Automaton()
        for number, row in enumerate(mine.collect()):
            words = row.pattern.count(" ") + 1
            automaton.add_word(f" {row.pattern} ", (number, words, tuple(row["items"])))
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)
        docs = append_columns(docs, states, _scan(shared, text, shard == 0), text)
    results = {
        "n_words": "bigint",
        "n_hit": "bigint",
        "items": "array<string>",
        "spans": "array<struct<start:int,end:int>>",
    }
    return append_columns(docs, results, _summary(text), text).drop(*states)


def _scan(shared, text: str, first: bool):
    def run(batch):
        automaton = shared.value
        texts = encoded(batch.column(text))
        if first:
            starts, ends, found = ([[] for _ in texts] for _ in range(3))
        else:
            starts, ends, found = (
                batch.column(name).to_pylist() for name in ("__llm_start", "__llm_end", "__llm_found")
            )
        for row, body in enumerate(texts if len(automaton) else ()):
            normal = f" {' '.join([w.decode() for w in normal_words(body)])} "
            hits = list(automaton.iter(normal))
            if not hits:
                continue
            spaces = np.cumsum(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
            seen = {}
            for place, (number, words, items) in hits:
                last = int(spaces[place]) - 2
                starts[row].append(last - words + 1)
                ends[row].append(last + 1)
                seen[number] = items
            found[row] = sorted({*found[row], *(i for items in seen.values() for i in items)})
        return {"__llm_start": starts, "__llm_end": ends, "__llm_found": found}

    return run


def _summary(text: str):
    def run(batch):
        n_words, n_hit, spans = [], [], []
        for body, starts, ends in zip(
            encoded(batch.column(text)),
            batch.column("__llm_start").to_pylist(),
            batch.column("__llm_end").to_pylist(),
        ):
            runs = _merged(sorted(zip(starts, ends)))
            n_hit.append(sum(end - start for start, end in runs))
            if runs:
                places = [m.span() for m in _WORD.finditer(body.translate(_WORD_BYTES))]
                n_words.append(len(places))
                spans.append(
                    [
                        {
                            "start": len(body[: places[start][0]].decode()),
                            "end": len(body[: places[end - 1][1]].decode()),
                        }
                        for start, end in runs
                    ]
                )
            else:
                n_words.append(len(normal_words(body)))
                spans.append([])
        found = batch.column("__llm_found")
        return {"n_words": n_words, "n_hit": n_hit, "items": found, "spans": spans}

    return run


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in runs:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out
