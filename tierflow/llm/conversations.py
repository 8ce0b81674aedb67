"""Repair of conversations: the cheapest edits that make turns alternate, as an audit.

Rows of a conversation go in the order of their turn, nulls first; of one turn by
role, then by the first 32 characters and a hash of the text, and equal rows are
interchangeable.  A null role or text is one space.  A row's first fault counts:
blank (nothing but white space), duplicate (role and text stood earlier),
truncated (the last character that is not white space is none of ``.!?``).

Edits: Keep costs nothing, Rerole to user or assistant 2, Delete 3, Insert of an
empty user or assistant message 2, anywhere; blank and duplicate rows must be
deleted, truncated ones that are not add 1.  What is left reads, by the first
letters of the roles, ``(s?(ua)+)?``; an empty role fits nowhere and is reroled or
deleted.  Of the cheapest edits those with the ASCII-least initials are taken.

A dynamic programme over four states (nothing yet, system, user, assistant) keeps
one audit a state.  Audits are linked nodes that share their prefixes; a node
points to its ancestors 1, 2, 4, ... letters back and carries a rolling hash of
its letters.  Ties are settled at the first letter after the longest common
prefix, found by the hashes; that the prefixes are equal is then checked letter by
letter up to the node they share, and where it is a collision the letters decide.
The letters tell the cost, so no audit of one cost is the beginning of another:
audits of blocks can be put together in any grouping.

That splits a conversation of more than ``LONG_ROWS`` rows: its rows are dealt by
ranges of their order and numbered, a block of ``LONG_ROWS`` is worked out from
each state it may begin in, and the blocks are joined in order, with four audits
held.  Rows seen before are found by grouping hashes (SHA-256) of role and text.
The digest of a long conversation's text is taken as its rows stream by; SHA-256
has no other way, and a batch of rows is held.

Ids of any type, null among them, are conversations; all are returned.  Of ids
without rows (``absent``) counts are zero and the audit is empty.  An empty table
gives no rows.  Other columns of the input, whatever their names, are not read.
Gaps beyond a long are the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tierflow.operators import broadcast_fits

from .common import group_stream, parts, stored

#: Rows of a conversation one task works on; longer ones are cut into blocks.
LONG_ROWS = 20_000

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = 1, 2, 3
WHITE, ENDS = " \t\n\v\f\r", ".!?"
LEGAL = {"su", "ua", "au"}
# States: nothing yet, last was system, user, assistant; what leads to each.
STATES, FINAL = range(4), (0, 3)
SYSTEM, USER, ASSISTANT = 1, 2, 3
BEFORE = {SYSTEM: (0,), USER: (0, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
SYMBOLS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

_MODULUS, _BASE = (1 << 61) - 1, 911_382_323
_LONG = (1 << 63) - 1
_AUDIT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


# --- audits as linked nodes ----------------------------------------------------


class Edits:
    """The end of an audit: its last letter, and the nodes before it."""

    __slots__ = ("letter", "depth", "print", "up")

    def __init__(self, letter: str, up: list[Edits], print_: int):
        self.letter, self.up, self.print = letter, up, print_
        self.depth = up[0].depth + 1 if up else 0

    def add(self, letter: str) -> Edits:
        up, step = [self], 0
        while step < len(up[step].up):
            up.append(up[step].up[step])
            step += 1
        return Edits(letter, up, (self.print * _BASE + ord(letter)) % _MODULUS)

    def back_to(self, depth: int) -> Edits:
        node, left = self, self.depth - depth
        while left:
            step = left.bit_length() - 1
            node, left = node.up[step], left - (1 << step)
        return node

    def __str__(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def nothing() -> Edits:
    return Edits("", [], 1)


def _equal(a: Edits, b: Edits) -> bool:
    """Letter by letter, up to the node they share; both are as long."""
    while a is not b:
        if a.letter != b.letter:
            return False
        if not a.up:
            return True
        a, b = a.up[0], b.up[0]
    return True


def less(a: Edits, b: Edits) -> bool:
    """Whether the letters of ``a`` come before those of ``b``."""
    short = min(a.depth, b.depth)
    x, y = a.back_to(short), b.back_to(short)
    if x is y or x.print == y.print:
        return a.depth < b.depth if _equal(x, y) else str(a) < str(b)
    for step in reversed(range(len(x.up))):
        if step < len(x.up) and x.up[step].print != y.up[step].print:
            x, y = x.up[step], y.up[step]
    if not _equal(x.up[0], y.up[0]):
        return str(a) < str(b)
    return x.letter < y.letter


# --- the programme ---------------------------------------------------------------


def _least(candidates: list[tuple[int, Edits, str]]) -> tuple[int, Edits] | None:
    """The cheapest of (cost, audit, letter to add), the least of equal ones."""
    if not candidates:
        return None
    cost = min(c[0] for c in candidates)
    ends = [node.add(letter) if letter else node for c, node, letter in candidates if c == cost]
    best = ends[0]
    for end in ends[1:]:
        if less(end, best):
            best = end
    return cost, best


def inserted(states: dict) -> dict:
    """States that inserting reaches, too; a third insert leads back to where it began."""
    for state in (USER, ASSISTANT):
        ways = [(cost + INSERT, node, "I") for s in BEFORE[state] if s in states for cost, node in [states[s]]]
        if state in states:
            ways.append((*states[state], ""))
        if ways:
            states[state] = _least(ways)
    return states


def after_row(states: dict, initial: str, fault: int) -> dict:
    """Each state's best audit after one more row and inserts behind it."""
    out = {}
    for state in STATES:
        ways = [(states[state][0] + DELETE, states[state][1], "D")] if state in states else []
        if fault not in (BLANK_ROW, DUPLICATE_ROW) and state:
            extra = TRUNCATED if fault == TRUNCATED_ROW else 0
            for before in BEFORE[state]:
                if before in states:
                    cost, node = states[before]
                    if SYMBOLS.get(initial) == state:
                        ways.append((cost + extra, node, "K"))
                    if state != SYSTEM:
                        ways.append((cost + extra + REROLE, node, "R"))
        if ways:
            out[state] = _least(ways)
    return inserted(out)


def fault_of(text: str, seen: bool) -> int:
    last = text.rstrip(WHITE)[-1:]
    if not last:
        return BLANK_ROW
    if seen:
        return DUPLICATE_ROW
    return 0 if last in ENDS else TRUNCATED_ROW


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) an audit leaves of rows, one by one."""
    rows, last = iter(rows), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def digest(messages: Iterable[tuple[str, str]]) -> str:
    """SHA-256 of ``role:text`` lines, fed one by one."""
    made, between = hashlib.sha256(), b""
    for role, text in messages:
        made.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return made.hexdigest()


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, _LONG)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _whole(group: pa.Table) -> Iterator[dict]:
    """The audit of one conversation, all its rows at hand."""
    live = group.filter(pc.invert(group.column("absent")))
    rows = list(zip(live.column("role").to_pylist(), live.column("text").to_pylist()))
    turns = {turn for turn in live.column("turn").to_pylist() if turn is not None}
    seen, counts, states = set(), [0] * 4, inserted({0: (0, nothing())})
    for role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        counts[fault] += 1
        states = after_row(states, role[:1], fault)
    cost, end = _least([(*states[s], "") for s in FINAL if s in states])
    audit = str(end)
    yield {
        "conv": group.column("conv")[0].as_py(),
        "gaps": _gaps(min(turns, default=None), max(turns, default=None), len(turns)),
        "blank": counts[BLANK_ROW],
        "duplicate": counts[DUPLICATE_ROW],
        "truncated": counts[TRUNCATED_ROW],
        "illegal": _illegal([role[:1] for role, _ in rows]),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": digest(repaired(audit, rows)),
    }


# --- long conversations ------------------------------------------------------------

_BLOCK = (
    "conv string, block bigint, first string, last string, illegal bigint, blank bigint, "
    "duplicate bigint, truncated bigint, ways array<struct<i:int,o:int,cost:bigint,audit:string>>"
)
_JOINED = "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _block(group: pa.Table) -> Iterator[dict]:
    """What one block of a conversation makes of each state it may begin in."""
    columns = ("role", "text", "seen")
    counts, edits, initials = [0] * 4, [], []
    for role, text, seen in zip(*(group.column(c).to_pylist() for c in columns)):
        edits.append((role[:1], fault_of(text, seen)))
        counts[edits[-1][1]] += 1
        initials.append(role[:1])
    ways = []
    for begin in STATES:
        states = {begin: (0, nothing())}
        for initial, fault in edits:
            states = after_row(states, initial, fault)
        ways += [{"i": begin, "o": o, "cost": c, "audit": str(n)} for o, (c, n) in states.items()]
    yield {
        "conv": group.column("conv")[0].as_py(),
        "block": group.column("block")[0].as_py(),
        "first": initials[0],
        "last": initials[-1],
        "illegal": _illegal(initials),
        "blank": counts[BLANK_ROW],
        "duplicate": counts[DUPLICATE_ROW],
        "truncated": counts[TRUNCATED_ROW],
        "ways": ways,
    }


def _join_blocks(batches) -> Iterator[dict]:
    """Blocks sorted by conversation and block, one at a time, to audits."""
    blocks = (block for batch in batches for block in batch.to_pylist())
    for conv, group in groupby(blocks, key=lambda block: block["conv"]):
        states = {s: (cost, str(node)) for s, (cost, node) in inserted({0: (0, nothing())}).items()}
        sums, last = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None
        for block in group:
            out = {}
            for way in block["ways"]:
                if way["i"] in states:
                    cost, audit = states[way["i"]]
                    made = cost + way["cost"], audit + way["audit"]
                    out[way["o"]] = min(out.get(way["o"], made), made)
            states = out
            for name in sums:
                sums[name] += block[name]
            if last is not None:
                sums["illegal"] += last + block["first"] not in LEGAL
            last = block["last"]
        cost, audit = min(states[s] for s in FINAL if s in states)
        yield {"conv": conv, "cost": cost, "audit": audit, **sums}


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [
        F.col("turn").asc_nulls_first(),
        F.col("role"),
        F.substring("text", 1, 32),
        F.xxhash64("text"),
    ]


def _long_audits(rows: DataFrame, long_rows: int) -> DataFrame:
    tasks = parts(rows.sparkSession)
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv"), *_order(), F.col("salt")]
    content = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    # numbers rise through the partitions, and so through each conversation
    numbered = (
        salted.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("n"))
        .withColumn("content", content)
    )
    numbered = stored(numbered, "long-conversations")
    firsts = numbered.groupBy("conv", "content").agg(F.min("n").alias("n"))
    marked = numbered.join(firsts.select("n", F.lit(False).alias("again")), "n", "left")
    marked = marked.withColumn("seen", F.coalesce("again", F.lit(True)))
    marked = marked.withColumn("block", F.floor(F.col("n") / long_rows))
    keys = ["conv", "block"]
    dealt = marked.select(*keys, "n", "role", "text", "seen").repartition(tasks, *keys).sortWithinPartitions(*keys, "n")
    blocks = _grouped(dealt, keys, _BLOCK, _block)
    joined = _mapped(blocks.repartition(tasks, "conv").sortWithinPartitions(*keys), _JOINED, _join_blocks)
    audits = stored(joined, "long-audits")
    lines = numbered.select("conv", "n", "role", "text").unionByName(
        audits.select("conv", F.lit(-1).cast("bigint").alias("n"), F.lit("").alias("role"), F.col("audit").alias("text"))
    )
    streamed = lines.repartition(tasks, "conv").sortWithinPartitions("conv", "n")
    digests = _mapped(streamed, "conv string, repaired_sha256 string", _digests)
    turns = numbered.groupBy("conv", "turn").agg(F.lit(1).alias("one")).where("turn IS NOT NULL").groupBy("conv")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("*")
    gaps = turns.agg(F.least(span, F.lit(_LONG)).cast("bigint").alias("gaps"))
    whole = audits.join(digests, "conv").join(gaps, "conv", "left")
    return whole.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint")))


def _edited(batches) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    """Conversations and what is left of them, from rows that follow their audit."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(name).to_pylist() for name in ("conv", "role", "text")))
    )
    for conv, group in groupby(rows, key=lambda row: row[0]):
        audit = next(group)[2]
        yield conv, repaired(audit, ((role, text) for _, role, text in group))


def _digests(batches) -> Iterator[dict]:
    for conv, left in _edited(batches):
        yield {"conv": conv, "repaired_sha256": digest(left)}


def _laid_out(batches) -> Iterator[dict]:
    for conv, left in _edited(batches):
        for place, (role, text) in enumerate(left):
            yield {"conv": conv, "place": place, "role": role, "text": text}


# --- the operator --------------------------------------------------------------------


def _mapped(df: DataFrame, columns: str, make: Callable) -> DataFrame:
    """``make``, from batches to rows, over each partition; rows go on a thousand at a time."""
    schema = _parse_datatype_string(columns)
    arrow = to_arrow_schema(schema)

    def run(batches):
        rows = make(batches)
        while held := list(islice(rows, 1_000)):
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)


def _grouped(df: DataFrame, keys: list[str], columns: str, make: Callable) -> DataFrame:
    """``make`` over each group of rows that are sorted by ``keys``, one group at hand."""

    def split(rows: pa.Table):
        change = np.zeros(rows.num_rows, bool)
        for key in keys:
            column = rows.column(key).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
        for start, stop in zip(starts, starts[1:]):
            yield from make(rows.slice(start, stop - start))

    return _mapped(df, columns, lambda batches: group_stream(batches, keys, split))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    space = F.lit(" ")
    return df.select(
        _key(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
        (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"),
    )


def _key(conv: str) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def audits(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    absent: str | None = None,
    long_rows: int = LONG_ROWS,
) -> DataFrame:
    """One row a conversation: faults, cost and letters of its repair, digest of the result.

    Rows marked by the column ``absent`` only name their conversation.
    """
    spark, rows = df.sparkSession, _rows(df, conv, turn, role, text, absent)
    counts = df.groupBy(_key(conv).alias("conv")).agg(F.count("*").alias("rows"))
    longs = counts.where(F.col("rows") > long_rows).select("conv")
    whole, made = rows, []
    if longs.head(1):
        longs = stored(longs, "long-ids")
        # a row per ``long_rows`` rows of the input, sent whole only if measured to be small
        listed = F.broadcast(longs) if broadcast_fits(longs) else longs
        whole = rows.join(listed, "conv", "left_anti")
        made.append(_long_audits(rows.join(listed, "conv", "left_semi").where("NOT absent"), long_rows))
        gone = longs.join(made[0], "conv", "left_anti")
        whole = whole.unionByName(
            gone.selectExpr("conv", "CAST(NULL AS bigint) AS turn", "'' AS role", "'' AS text", "true AS absent")
        )
    dealt = whole.repartition(parts(spark), "conv").sortWithinPartitions("conv", *_order())
    one = _grouped(dealt, ["conv"], f"conv string, {_AUDIT}", _whole)
    for more in made:
        one = one.unionByName(more)
    kind = df.schema[conv].dataType
    identity = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias(conv)
    return one.select(identity, *[f.name for f in _parse_datatype_string(_AUDIT)])


def messages(
    df: DataFrame,
    audited: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    absent: str | None = None,
) -> DataFrame:
    """The repaired conversations of ``audits``: rows (conv, place, role, text), places from 0."""
    rows = _rows(df, conv, turn, role, text, absent).where("NOT absent").drop("absent").withColumn("lead", F.lit(1))
    leads = audited.select(
        _key(conv).alias("conv"),
        F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"),
        F.col("audit").alias("text"),
        F.lit(0).alias("lead"),
    )
    both = rows.unionByName(leads).repartition(parts(df.sparkSession), "conv")
    both = both.sortWithinPartitions("conv", "lead", *_order())

    made = _mapped(both, "conv string, place bigint, role string, text string", _laid_out)
    kind = df.schema[conv].dataType
    identity = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias(conv)
    return made.select(identity, "place", "role", "text")


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, absent) with faults put in by a hash of id and turn.

    Of 20 equally likely values 0 drops the row (it stays as ``absent``), 1 empties
    its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")) % 20
    hurt = df.select(conv, turn, told(role).alias(role), told(text).alias(text), kind.alias("__kind"))
    copies = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select(
        conv,
        turn,
        F.when(F.col("__kind") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("__kind") == 1, "")
        .when(F.col("__kind") == 2, F.translate(text, ENDS, ""))
        .otherwise(F.col(text))
        .alias(text),
        (F.col("__kind") == 0).alias("absent"),
        "__kind",
    ).withColumn("__copy", copies).drop("__copy", "__kind")
