"""Quality rules whose cutoffs come from the data, per language and source.

``measured`` counts words, symbols, repeated lines and repeated three-word windows of
whole texts; a null text has none.  A text fails by itself (``base_failed``) with
fewer than 50 words, or if over half of them stand in windows found twice or more.

The other cutoffs adapt.  Of every text that did not fail four rates are put in
buckets of at most a 32nd of their value; a sketch is the number of texts in each
bucket, and sketches of any parts of the data are merged by adding.  For each
(language, source) the median m and the lower quartile q are read off, and a rate
may be up to ``SPREAD`` times ``max(m - q, least)`` above m, the length of words also
as much below.  Lower quartile and median do not move while less than half of a
source is junk, and ``least`` keeps a source whose texts are all alike whole.
A source with fewer than ``LEAST_DOCS`` sketched texts in a language takes the merged
sketch of its language, a language with fewer that of all texts.

Only built-in functions run.  Texts are read once; their counts are stored, and the
sketch and the filter read those.  A sketch is combined before it is shuffled, has at
most some thousand buckets a group and is read off in a window of those; a hot source
costs no more than another.  Cutoffs are sent to all tasks if they measure small, else
joined on a salted key.

Null languages and sources are groups of their own.  Repeated rows are judged alike,
each as a row.  An empty table gives no rows.  Columns of the input with the names of
the new ones give way; one row stays one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from tierflow.operators import broadcast_fits

from .common import stored

# What fails a text by itself.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
WORD, WHITE, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r", "#*$%&|<>"
#: Times the distance of median and lower quartile that a rate may be off the median.
SPREAD = 4
#: Texts a (language, source) needs for cutoffs of its own.
LEAST_DOCS = 200
#: Buckets of values with so many bits are exact, wider ones keep that many leading bits.
BITS = 6
SALTS = 32

#: Rates of a text and the least distance that counts as spread.
RATES = {
    "symbol_rate": ("1000 * n_symbols div n_words", "25"),
    "repeat_rate": ("1000 * n_repeat_words div n_words", "75"),
    "line_rate": ("1000 * n_dup_lines div greatest(n_lines, 1)", "75"),
    "word_length": ("100 * word_chars div n_words", "high div 20"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda word, i: F.concat_ws(" ", word, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(windows: Column) -> Column:
    """Words in windows that are there twice or more: sorted, equal ones are neighbours."""

    def places(ordered: Column) -> Column:
        again = lambda x, i: F.when(
            (F.get(ordered, i - 1)["w"] == x["w"]) | (F.get(ordered, i + 1)["w"] == x["w"]), x["i"]
        )
        return F.array_compact(F.transform(ordered, again))

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    words = F.transform(_let(ordered, places), lambda i: F.array(i, i + 1, i + 2))
    return F.size(F.array_distinct(F.flatten(words)))


def _repeated(words: Column) -> Column:
    return _let(
        _windows(words),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text, ``n_lines`` (with a word) and ``base_failed``."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda characters: F.char_length(F.translate(body, characters, ""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    of_words = _let(
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        lambda words: F.struct(F.size(words).alias("n"), _repeated(words).alias("again")),
    )
    of_lines = _let(
        lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("once"))
    )
    new = {
        "n_words": F.col("__words")["n"],
        "word_chars": without(WHITE),
        "n_symbols": F.char_length(body) - without(SYMBOLS),
        "n_dup_lines": F.col("__lines")["n"] - F.col("__lines")["once"],
        "n_repeat_words": F.col("__words")["again"],
        "n_lines": F.col("__lines")["n"],
    }
    kept = [name for name in docs.columns if name.lower() not in {*new, "base_failed"}]
    counted = docs.withColumns({"__words": of_words, "__lines": of_lines})
    counted = counted.select(*kept, *[c.cast("bigint").alias(name) for name, c in new.items()])
    short = F.col("n_words") < LEAST_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    return counted.withColumn("base_failed", short | repeats)


def bucket(value: Column) -> Column:
    """The least value of a value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketched(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches (keys, rate, bucket, texts) of texts that did not fail."""
    rates = F.create_map(*[x for name, (rate, _) in RATES.items() for x in (F.lit(name), F.expr(rate))])
    some = counts.where("NOT base_failed").select(*keys, F.explode(rates).alias("rate", "value"))
    return some.groupBy(*keys, "rate", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("texts"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up to coarser keys."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("texts").alias("texts"))


def cutoffs(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``keys`` the texts, and bounds (rate to low and high) of what is kept."""
    ordered = Window.partitionBy(*keys, "rate").orderBy("bucket")
    whole = Window.partitionBy(*keys, "rate")
    ranked = sketches.withColumns({"upto": F.sum("texts").over(ordered), "all": F.sum("texts").over(whole)})
    # a bucket ends below the next value with its leading bits
    wide = F.when(F.length(F.bin("bucket")) > BITS, F.expr(f"shiftleft(1L, length(bin(bucket)) - {BITS})"))
    last = F.col("bucket") + F.coalesce(wide, F.lit(1)) - 1
    read = ranked.groupBy(*keys, "rate").agg(
        F.max("all").alias("texts"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("quarter"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bucket"))).alias("low"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), last)).alias("high"),
    )
    least = F.coalesce(*[F.when(F.col("rate") == name, F.expr(least)) for name, (_, least) in RATES.items()])
    room = F.greatest(F.col("high") - F.col("quarter"), least) * SPREAD
    below = F.when(F.col("rate") == "word_length", F.col("low") - room)
    bounds = read.withColumns({"from": below, "to": F.col("high") + room})
    entry = F.struct("from", "to")
    return bounds.groupBy(*keys).agg(
        F.max("texts").alias("texts"),
        *[F.max(F.when(F.col("rate") == name, entry)).alias(name) for name in RATES],
    )


def thresholds(sketches: DataFrame, lang: str, source: str, least_docs: int) -> DataFrame:
    """The cutoffs that hold for each language and source of ``sketches``."""
    own = cutoffs(sketches, [lang, source])
    by_lang = cutoffs(merged(sketches, [lang]), [lang])
    # one row, which meets every language by a key that all share, zero by computation: an equality join
    shared = F.col("texts") * 0
    of_all = cutoffs(merged(sketches.withColumn("__all", shared), ["__all"]), ["__all"])
    o, b, a = own.alias("o"), by_lang.withColumn("__all", shared).alias("b"), of_all.alias("a")
    met = b.join(a, F.col("b.__all") == F.col("a.__all")).select(
        F.col(f"b.{lang}").alias("__lang"),
        *[
            F.when(F.col("b.texts") >= least_docs, F.col(f"b.{n}")).otherwise(F.col(f"a.{n}")).alias(f"wide_{n}")
            for n in RATES
        ],
    )
    joined = o.join(met, F.col(f"o.{lang}").eqNullSafe(F.col("__lang")))
    return joined.select(
        F.col(f"o.{lang}").alias("__lang"),
        F.col(f"o.{source}").alias("__source"),
        *[
            F.when(F.col("o.texts") >= least_docs, F.col(f"o.{n}")).otherwise(F.col(f"wide_{n}")).alias(f"__{n}")
            for n in RATES
        ],
    )


def judged(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """The columns ``keep``, ``lang`` and ``source`` of all rows, the counts, ``base_failed`` and ``kept``."""
    names = list(dict.fromkeys([*keep, lang, source]))
    counts = stored(measured(docs.select(*names, text), text).drop(text), "rule-counts")
    sketches = stored(sketched(counts, [lang, source]), "rule-sketches")
    limits = thresholds(sketches, lang, source, least_docs)
    on = F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source"))
    if broadcast_fits(limits):
        joined = counts.join(F.broadcast(limits), on, "left")
    else:
        salt = F.pmod(F.xxhash64(*counts.columns, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        salted = limits.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on &= F.col("__salt") == F.col("__copy")
        joined = counts.withColumn("__salt", salt).join(salted, on, "left")
    passes = ~F.col("base_failed")
    for name, (rate, _) in RATES.items():
        value = F.when(~F.col("base_failed"), F.expr(rate))
        fits = (value <= F.col(f"__{name}.to")) & (value >= F.coalesce(f"__{name}.from", F.lit(0)))
        passes &= F.coalesce(fits, F.lit(True))
    return joined.select(*names, *COUNTS, "n_lines", "base_failed", passes.alias("kept"))
