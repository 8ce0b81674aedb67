"""Mixing sources to target weights by Pfair scheduling of their blocks.

Rows of a source are put in the order of a hash of their id and cut into blocks.
Weights are whole numbers: a round takes ``weights[s]`` blocks of source ``s``,
fewer only where the source ends.  Within a round of L blocks, of which m are of
one source, block j of that source is released at slot floor(j L / m) and due by
slot ceil((j + 1) L / m); the released block with the earliest deadline goes
first.  All deadlines are met, so after every slot each source has had its share
of the round to within less than one block, and at the end of a round exactly.
When a source has ended, rounds go on with the rest, in the same proportions.
Nothing is repeated or left out.

Rounds with the same numbers of blocks have the same order, so at most two
schedules per source and one more are worked out, however many rows there are:
by a fold over the slots of a round, in SQL.  A row finds its block by counting:
rows per hash bucket are summed to offsets, and rows are numbered within their
bucket only.  No task sees a whole source.

Sources that are not named by ``weights``, null among them, together are the
source named by ``other``.  Rows of one id stand side by side in the order of a hash of
all their columns; rows that are equal in all are interchangeable.  A null id
counts as the text of no characters.  An empty table gives no rows.  Columns of
the input with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from tierflow.operators import broadcast_fits

BLOCK_ROWS = 16
OTHER = "(other)"
#: Bounds of the plan: blocks of a round and sources, so schedules stay small.
MOST_BLOCKS, MOST_SOURCES = 1024, 64

#: Rows of a bucket, and times the usual number, from which its ids are looked at one by one.
HOT_ROWS, HOT_TIMES = 1_000_000, 8

# Hash buckets of a source: two levels of so many, as hexadecimal digits.
_DIGITS = 2


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    block_rows: int = BLOCK_ROWS,
    other: int = 1,
    doc: str = "doc_id",
    source: str = "source",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``docs`` with ``mix_source``, ``block``, ``row_in_block`` and ``position``.

    ``block`` counts all blocks in mixed order, ``position`` orders the rows.
    """
    total = sum(weights.values()) + other
    if min([other, *weights.values()]) < 1 or total > MOST_BLOCKS or len(weights) >= MOST_SOURCES:
        raise ValueError(
            f"weights must be whole and positive, of at most {MOST_BLOCKS} blocks a round "
            f"and {MOST_SOURCES} sources"
        )
    shares = {**weights, OTHER: other}
    names = list(shares)
    made = ["mix_source", "block", "row_in_block", "position"]
    kept = [name for name in docs.columns if name.lower() not in made]
    number = F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(x) for n, name in enumerate(weights) for x in (name, n)])
            if weights
            else F.create_map(F.lit(OTHER), F.lit(0)),
            F.coalesce(F.col(source).cast("string"), F.lit(OTHER)),
        ),
        F.lit(len(weights)),
    )
    rows = docs.select(
        *kept,
        number.alias("__llm_source"),
        F.md5(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")).alias("__llm_hash"),
    ).withColumn("__llm_high", F.substring("__llm_hash", 1, _DIGITS)).withColumn(
        "__llm_low", F.substring("__llm_hash", 1 + _DIGITS, _DIGITS)
    )
    # only columns that can be hashed: maps cannot
    whole = F.xxhash64(*[n for n in kept if not docs.schema[n].dataType.typeName() == "map"])
    rows = rows.withColumn("__llm_row_hash", whole)
    buckets = rows.groupBy(*_BUCKET).agg(F.count("*").alias("__llm_n"))
    # one count per source, MOST_SOURCES at most
    sums = buckets.groupBy("__llm_source").agg(F.sum("__llm_n").alias("n"), F.count("*").alias("buckets")).collect()
    found = {r["__llm_source"]: r["n"] for r in sums}
    usual = {r["__llm_source"]: r["n"] / r["buckets"] for r in sums}
    rows = _with_hot_ids(rows, buckets, usual, hot_rows, doc)
    counts = rows.groupBy(*_CELL).agg(F.count("*").alias("__llm_n"))
    offsets = _offsets(counts)
    blocks = [-(-found.get(n, 0) // block_rows) for n in range(len(names))]
    plan, starts = _schedules(docs.sparkSession, list(shares.values()), blocks)

    order = ["__llm_hash", F.col(doc), "__llm_row_hash"]
    within = F.row_number().over(Window.partitionBy(*_CELL).orderBy(*order))
    share = _pick(F.col("__llm_source"), list(shares.values()))
    numbered = (
        rows.join(offsets, _CELL)
        .withColumn("__llm_row", F.col("__llm_offset") + within - 1)
        .withColumn("__llm_block", F.expr(f"__llm_row div {block_rows}"))
        .withColumn("__llm_share", share)
        .withColumn("__llm_round", F.expr("__llm_block div __llm_share"))
        .withColumn("__llm_turn", F.expr("cast(__llm_block % __llm_share as int)"))
        .withColumn("__llm_start", _last_start(F.col("__llm_round"), starts))
    )
    block = (
        F.col("__llm_base")
        + (F.col("__llm_round") - F.col("__llm_start")) * F.col("__llm_length")
        + F.col("__llm_slot")
    )
    return (
        numbered.join(F.broadcast(plan), ["__llm_start", "__llm_source", "__llm_turn"])
        .withColumn("mix_source", _pick(F.col("__llm_source"), names))
        .withColumn("block", block)
        .withColumn("row_in_block", F.expr(f"cast(__llm_row % {block_rows} as int)"))
        .withColumn("position", F.col("block") * block_rows + F.col("row_in_block"))
        .select(*kept, *made)
    )


_BUCKET = ["__llm_source", "__llm_high", "__llm_low"]
# Of a bucket with a hot id each id is a cell, and the hot id one for each leading byte of its rows' hash.
_CELL = [*_BUCKET, "__llm_id", "__llm_part"]


def _with_hot_ids(rows: DataFrame, buckets: DataFrame, usual: dict[int, float], hot_rows: int, doc: str) -> DataFrame:
    """Rows with their cell; only buckets with far more rows than is usual have several.

    Cells of a bucket follow each other in the order of its rows, so counting goes on
    as before; the list of such buckets has a row per ``hot_rows`` rows at most.
    """
    most = _pick(F.col("__llm_source"), [max(hot_rows, HOT_TIMES * usual.get(n, 0.0)) for n in range(max(usual, default=0) + 1)])
    crowded = buckets.where(F.col("__llm_n") > most).select(*_BUCKET)
    if not usual or not crowded.head(1):
        return rows.withColumns({"__llm_id": F.lit(""), "__llm_part": F.lit(0)})
    listed = F.broadcast(crowded) if broadcast_fits(crowded) else crowded
    ids = rows.join(listed, _BUCKET, "left_semi").groupBy("__llm_source", "__llm_hash").agg(F.count("*").alias("n"))
    hot = ids.where(F.col("n") > hot_rows).select("__llm_source", "__llm_hash", F.lit(True).alias("__llm_hot"))
    hot = F.broadcast(hot) if broadcast_fits(hot) else hot
    marked = rows.join(listed.withColumn("__llm_crowded", F.lit(True)), _BUCKET, "left")
    marked = marked.join(hot, ["__llm_source", "__llm_hash"], "left")
    # a null id and the text of no characters are one id, the null first
    part = F.shiftright("__llm_row_hash", 56).cast("int") + F.when(F.col(doc).isNull(), 0).otherwise(256)
    return marked.withColumns(
        {
            "__llm_id": F.when(F.col("__llm_crowded"), F.col("__llm_hash")).otherwise(""),
            "__llm_part": F.when(F.col("__llm_hot"), part).otherwise(0),
        }
    ).drop("__llm_crowded", "__llm_hot")


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _last_start(round_: Column, starts: list[int]) -> Column:
    later = F.lit(starts[0]).cast("bigint")
    for start in starts[1:]:
        later = F.when(round_ >= start, F.lit(start).cast("bigint")).otherwise(later)
    return later


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows of a source before each bucket, added up in two levels of 256."""
    high = counts.groupBy("__llm_source", "__llm_high").agg(F.sum("__llm_n").alias("__llm_sum"))
    across = Window.partitionBy("__llm_source").orderBy("__llm_high").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy("__llm_source", "__llm_high").orderBy(*_CELL[2:]).rowsBetween(Window.unboundedPreceding, -1)
    )
    base = high.select(
        "__llm_source", "__llm_high", F.coalesce(F.sum("__llm_sum").over(across), F.lit(0)).alias("__llm_base")
    )
    low = counts.withColumn("__llm_before", F.coalesce(F.sum("__llm_n").over(inside), F.lit(0)))
    return low.join(base, ["__llm_source", "__llm_high"]).select(
        *_CELL, (F.col("__llm_base") + F.col("__llm_before")).alias("__llm_offset")
    )


def _schedules(spark: SparkSession, shares: list[int], blocks: list[int]):
    """Order of blocks in every kind of round, and the rounds where a kind starts.

    Rows: the round it starts with, source, turn of the source in the round, slot,
    blocks of the round, blocks before the first such round.
    """
    full = [n // share for n, share in zip(blocks, shares)]
    last = max([-(-n // share) for n, share in zip(blocks, shares)])
    starts = sorted({0, *full, *(n + 1 for n in full)} & set(range(max(1, last))))
    kinds = []
    for start in starts:
        mine = [min(s, max(0, n - start * s)) for n, s in zip(blocks, shares)]
        before = sum(min(n, start * s) for n, s in zip(blocks, shares))
        counts = ",".join(map(str, mine))
        kinds.append(f"named_struct('s', {start}L, 'b', {before}L, 'm', array({counts}))")
    sources = len(shares)
    # the released block with the earliest deadline, the first source on a tie
    due = f"""
      array_min(filter(transform(sequence(0, {sources - 1}), i -> if(
          state.done[i] < m[i] and (state.done[i] * n) div m[i] <= t,
          named_struct('due', ((state.done[i] + 1) * n + m[i] - 1) div m[i], 'i', i), null)),
        x -> x is not null)).i"""
    fold = f"""
      aggregate(sequence(0, n - 1),
        named_struct('done', array_repeat(0, {sources}), 'order', cast(array() as array<struct<i:int,j:int>>)),
        (state, t) -> aggregate(array({due}), state, (s, next) -> named_struct(
          'done', transform(s.done, (d, i) -> if(i = next, d + 1, d)),
          'order', concat(s.order, array(named_struct('i', next, 'j', s.done[next]))))),
        state -> state.order)"""
    kinds_df = spark.sql(f"SELECT inline(array({','.join(kinds)})) AS (s, b, m)")
    plan = (
        kinds_df.withColumn("n", F.expr("aggregate(m, 0, (a, x) -> a + x)"))
        .where("n > 0")
        .withColumn("order", F.expr(fold))
        .selectExpr("s", "b", "n", "posexplode(order) AS (slot, one)")
        .selectExpr(
            "s AS __llm_start",
            "one.i AS __llm_source",
            "one.j AS __llm_turn",
            "slot AS __llm_slot",
            "n AS __llm_length",
            "b AS __llm_base",
        )
    )
    return plan, starts
