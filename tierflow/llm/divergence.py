"""How far the sources of a language differ in their words, over texts collapsed first.

Equal texts of a language become one, with the number of times each source has it:
a task first collapses what it reads, a unit of ``UNIT_BYTES`` of text at a time, then
texts meet by a 128-bit hash and are compared in full.  So a text in a third of all
rows travels once a unit, and every text is split into terms once.  Its terms add the
multiplicities of the text to the documents, and multiplicity times occurrences to
the counts, of each source that has it.

Terms in at least ``LEAST_DOCS`` documents of a language are kept.  A group (language
and source) gives a term with count c the share p = 1 + floor(10^9 (c + 1) / (N + V)),
N being the group's counts of kept terms and V their number, a language likewise with
the counts of all its sources.  The divergence of p from q is floor((p - q)^2 / q).

``divergence`` gives each group the terms it has more often than its language, the
``MOST_TERMS`` furthest off, and every other source of the language with the sum over
all kept terms.  That sum is not taken term by term: a term neither source has always
adds the same, a term that one has depends on its count only and is summed from the
numbers of terms by share, and only terms that both have are looked at in pairs, as
matrices of the sources of one term.  All numbers are whole and exact.

Null texts, languages and sources are empty ones.  A group without terms is a group.
Repeated rows count as often as they are there; ties in rank go by the item's UTF-8
bytes.  An empty table gives no rows.  Other columns, whatever their names, are not read.
Texts of any length are split whole; one text and its terms are held at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from tierflow.operators import broadcast_fits

from .common import encoded, group_stream, parts, slices, stored

LEAST_DOCS, MOST_TERMS, SCALE = 3, 200, 1_000_000_000
#: Different texts a task holds before it sends them on, in bytes.
UNIT_BYTES = 32 << 20
#: Counts a task adds up before it sends them on.
HELD_TERMS = 500_000
#: Numbers of a matrix over pairs of sources at a time.
CELLS = 1 << 20
SALTS = 32

_LOW = (1 << 64) - 1
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms(body: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return body.translate(_LETTERS).split()


# --- texts to counts ---------------------------------------------------------------


def _units(batches) -> Iterator[pa.RecordBatch]:
    """Each different text of a unit once, with its sources and how often each has it."""
    held: dict[tuple[str, bytes], Counter] = {}
    size = 0

    def sent():
        keys = list(held)
        for at in range(0, len(keys), 1_000):
            part = keys[at : at + 1_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in part], pa.string()),
                    pa.array([xxhash.xxh3_128_digest(body) for _, body in part], pa.binary()),
                    pa.array([body for _, body in part], pa.binary()),
                    pa.array([list(held[key]) for key in part], pa.list_(pa.string())),
                    pa.array([list(held[key].values()) for key in part], pa.list_(pa.int64())),
                ],
                names=["lang", "print", "body", "sources", "times"],
            )

    for piece in slices(batches, "text"):
        columns = (piece.column("lang").to_pylist(), piece.column("source").to_pylist(), encoded(piece.column("text")))
        for lang, source, body in zip(*columns):
            key = lang, body
            if key not in held:
                held[key] = Counter()
                size += len(body) + 200
            held[key][source] += 1
        if size > UNIT_BYTES:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def _texts(batches) -> Iterator[tuple[str, bytes, Counter]]:
    """Different texts and their sources, from rows sorted by language and hash."""
    last, same = None, {}
    for batch in batches:
        for piece in slices([batch], "body"):
            names = ("lang", "print", "body", "sources", "times")
            for lang, mark, body, sources, times in zip(*(piece.column(n).to_pylist() for n in names)):
                if (lang, mark) != last:
                    yield from ((last[0], text, has) for text, has in same.items())
                    last, same = (lang, mark), {}
                has = same.setdefault(body, Counter())
                for source, n in zip(sources, times):
                    has[source] += n
    yield from ((last[0], text, has) for text, has in same.items())


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences (lang, source, term, docs, n), added up a while."""
    # both numbers of a term in one: documents above the lower 64 bits
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def sent():
        for (lang, source), sums in held.items():
            words = list(sums)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                both = [sums[term] for term in part]
                arrays = [
                    pa.repeat(pa.scalar(lang, pa.string()), len(part)),
                    pa.repeat(pa.scalar(source, pa.string()), len(part)),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([value >> 64 for value in both], pa.int64()),
                    pa.array([value & _LOW for value in both], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "docs", "n"])

    for lang, body, has in _texts(batches):
        found = Counter(terms(body))
        for source, times in has.items():
            sums = held.setdefault((lang, source), {})
            size -= len(sums)
            document = times << 64
            for term, n in found.items():
                sums[term] = sums.get(term, 0) + document + times * n
            size += len(sums)
        if size > HELD_TERMS:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def counted(docs: DataFrame) -> DataFrame:
    """Counts (lang, source, term, docs, n) of rows (lang, source, text) without nulls."""
    tasks = parts(docs.sparkSession)
    schema = "lang string, print binary, body binary, sources array<string>, times array<bigint>"
    units = docs.mapInArrow(_units, schema).repartition(tasks, "lang", "print")
    rows = units.sortWithinPartitions("lang", "print").mapInArrow(
        _counted, "lang string, source string, term string, docs bigint, n bigint"
    )
    return rows.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


# --- shares ---------------------------------------------------------------------------


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / size), in decimals of 38 digits."""
    whole = (count.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, size.cast("decimal(20,0)")) + 1


def furtherness(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be hot: ``small`` is sent whole if it measures small, else salted."""
    if broadcast_fits(small):
        return df.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Groups (lang, source, id, terms, size, lang_size, none): sizes are N + V, none the share of a count of 0."""
    per_group = (
        kept.select("lang", F.explode("has").alias("has"))
        .groupBy("lang", F.col("has.source").alias("source"))
        .agg(F.sum("has.n").alias("total"))
    )
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = docs.select("lang", "source").distinct()
    joined = every.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    sized = joined.select(
        "lang",
        "source",
        zero("terms").alias("terms"),
        (zero("total") + zero("terms")).alias("size"),
        (zero("lang_total") + zero("terms")).alias("lang_size"),
    )
    none = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"))).otherwise(F.lit(1)).alias("none")
    return sized.select("*", none, F.monotonically_increasing_id().alias("id"))


# --- pairs ----------------------------------------------------------------------------


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs_of_terms(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """What terms that two groups have add to the sum of each, beyond what they add alone."""
    change = np.zeros(rows.num_rows, bool)
    for key in ("lang", "term"):
        column = rows.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change)])
    lengths = np.diff(np.append(starts, rows.num_rows))
    ids, local = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    p, none = rows.column("p").to_numpy(), rows.column("none").to_numpy()
    for k in np.unique(lengths[lengths > 1]).tolist():
        at = starts[lengths == k][:, None] + np.arange(k)
        # rows of a matrix at a time, so that a term of very many sources fits, too
        wide = max(1, min(k, CELLS // k))
        deep = max(1, CELLS // (k * wide))
        for top in range(0, len(at), deep):
            for left in range(0, k, wide):
                own, other = at[top : top + deep, left : left + wide, None], at[top : top + deep, None, :]
                more = _far(p[own], p[other]) - _far(p[own], none[other])
                more += _far(none[own], none[other]) - _far(none[own], p[other])
                keys, place = np.unique(local[own] * len(ids) + local[other], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place.ravel(), more.ravel())
                a, b = np.divmod(keys, len(ids))
                some = a != b
                arrays = [pa.array(ids[a[some]]), pa.array(ids[b[some]]), pa.array(sums[some])]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "value"])


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs (a, b, value) of group ids with the sum over all kept terms."""
    tasks = parts(groups.sparkSession)
    shared = cells.where("sources > 1").select("lang", "term", "id", "p", "none")
    met = shared.repartition(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    both = met.mapInArrow(
        lambda batches: group_stream(batches, ["lang", "term"], _pairs_of_terms), "a bigint, b bigint, value bigint"
    )
    other = groups.select("lang", F.col("id").alias("other"), F.col("none").alias("other_none"))
    by_share = cells.groupBy("lang", "id", "none", "p").agg(F.count("*").alias("n"))
    one = join_small(by_share, other, ["lang"]).where("id <> other")
    far = lambda p, q: furtherness(F.col(p), F.col(q))
    own = F.col("n") * (far("p", "other_none") - far("none", "other_none"))
    theirs = F.col("n") * (far("other_none", "p") - far("other_none", "none"))
    alone = one.select(
        F.inline(
            F.array(
                F.struct(F.col("id").alias("a"), F.col("other").alias("b"), own.alias("value")),
                F.struct(F.col("other").alias("a"), F.col("id").alias("b"), theirs.alias("value")),
            )
        )
    )
    neither = join_small(groups.select("lang", "id", "none", "terms"), other, ["lang"]).where("id <> other")
    least = neither.select(
        F.col("id").alias("a"), F.col("other").alias("b"), (F.col("terms") * far("none", "other_none")).alias("value")
    )
    summed = F.sum(F.col("value").cast("decimal(20,0)")).cast("bigint").alias("value")
    return both.unionByName(alone).unionByName(least).groupBy("a", "b").agg(summed)


# --- the operator -----------------------------------------------------------------------


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): other sources (``pair``) and own terms (``term``)."""
    told = lambda name, new: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(new)
    rows = docs.select(told(lang, "lang"), told(source, "source"), told(text, "text"))
    has = F.collect_list(F.struct("source", "n")).alias("has")
    by_term = counted(rows).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), has)
    kept = stored(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    groups = stored(_groups(rows, kept), "term-groups")
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.size("has").alias("sources"), F.inline("has"))
    sized = join_small(each, groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size")).alias("p"), share(F.col("lang_n"), F.col("lang_size")).alias("q")
    cells = sized.select("lang", "source", "id", "term", "sources", "none", p, q)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    above = cells.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), furtherness(F.col("p"), F.col("q")).alias("value")
    )
    top = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    named = lambda side, name: groups.select(F.col("id").alias(side), "lang", F.col("source").alias(name))
    pairs = join_small(_pairs(groups, cells), named("a", "source"), ["a"])
    pairs = join_small(pairs, named("b", "item").drop("lang"), ["b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return top.unionByName(pairs.withColumn("rank", F.row_number().over(ranked)))
