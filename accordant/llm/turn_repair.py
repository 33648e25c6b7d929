"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation is empty, or an optional system turn followed by pairs of
a user's and an assistant's.  The cheapest edits that give one are found by
depth-first branch and bound over the turns: an explicit stack, a lower bound for
every rest of the conversation, the best result so far as (cost, audit), and a
table per node that drops prefixes no better than one seen there.

Turns are put in one order over all conversations and dealt into blocks of a fixed
number of rows.  A conversation of several blocks has each solved by itself, for
every way to enter and to leave it, and the blocks are then chained, so that a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from accordant.llm.common import keep, shuffle_width

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WHITE = " \t\n\x0b\x0c\r"
ROWS_PER_BLOCK = 128
ROWS_AT_ONCE = 4096

#: What an edit costs; a truncated turn that stays adds ``CUT_OFF``.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_OFF = 5

# Where a repaired conversation stands: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
COMPLETE = (START, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
#: The state after each initial that may come next.
FOLLOWS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
#: What a turn made or renamed by an edit must be.
NEXT = "uuau"

Solution = tuple[int, str]


def lower_bounds(rows: str) -> tuple[list[int], list[int]]:
    """For each rest of the rows, what its edits cost at least: before anything stands, and after.

    Each row counts with its cheapest edit.  Two turns that cost nothing, have
    the same initial and only faulty rows between them, cost at least one more;
    no turn is counted in two such pairs.
    """
    begun, first = [0] * (len(rows) + 1), [0] * (len(rows) + 1)
    free, opening = "", False
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        cost = 2 if row in "xSUAO" else 0 if row in "ua" else 1
        if cost == 0:
            cost, free = (1, "") if row == free else (0, row)
        elif cost == 1:
            free = ""
        opening = opening or row == "s"
        begun[i] = begun[i + 1] + cost
        first[i] = begun[i] - opening
    return first, begun


def greedy(rows: str, state: int, ends: Sequence[int]) -> tuple[str, int]:
    """Some edits and the state they end in: what is faulty goes, what fits stays, the rest is renamed.

    Turns are added until the end is one of ``ends``, if adding gets there.
    """
    audit = ""
    for row in rows:
        if row in "xSUAO":
            audit += "D"
        elif row in FOLLOWS[state]:
            audit, state = audit + "K", FOLLOWS[state][row]
        else:
            audit, state = audit + "R", FOLLOWS[state][NEXT[state]]
    while state not in ends and max(ends) >= AFTER_U:
        audit, state = audit + "I", FOLLOWS[state][NEXT[state]]
    return audit, state


def price(rows: str, audit: str) -> int:
    """What an audit costs on these rows."""
    left = iter(rows)
    return sum(COSTS[e] + (CUT_OFF if e != "I" and next(left) in "SUAO" and e != "D" else 0) for e in audit)


def search(rows: str, state: int = START, ends: Sequence[int] = COMPLETE) -> Solution | None:
    """The cheapest edits, and of those the first in ASCII order; None where there are none.

    ``rows`` has a letter per turn: ``s u a o`` for its initial (o: any other), in
    upper case for a truncated turn, ``x`` for one that must go.  Edits are tried
    in ASCII order, so prefixes reach a node in that order and a node is entered
    again only at a lower cost, which keeps the work within rows times cost.
    """
    first, begun = lower_bounds(rows)
    audit, end = greedy(rows, state, ends)
    best: Solution | None = (price(rows, audit), audit) if end in ends else None
    seen: dict[tuple[int, int], Solution] = {}
    stack: list[tuple[int, int, int, str]] = [(0, state, 0, "")]
    while stack:
        i, at, cost, audit = stack.pop()
        if min(at, AFTER_U) > max(ends):  # no way back to an earlier state
            continue
        if best is not None:
            least = cost + (begun if at else first)[i]
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        if (i, at) in seen and seen[i, at] <= (cost, audit):
            continue
        seen[i, at] = cost, audit
        if i == len(rows) and at in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        onward = FOLLOWS[at][NEXT[at]]
        branches = [(i, onward, cost + COSTS["I"], audit + "I")]
        if i < len(rows):
            row = rows[i]
            branches.insert(0, (i + 1, at, cost + COSTS["D"], audit + "D"))
            if row != "x":
                stays = cost + (CUT_OFF if row.isupper() else 0)
                if row.lower() in FOLLOWS[at]:
                    branches.append((i + 1, FOLLOWS[at][row.lower()], stays + COSTS["K"], audit + "K"))
                branches.append((i + 1, onward, stays + COSTS["R"], audit + "R"))
        stack += reversed(branches)
    return best


def steps(rows: str, audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """Each edit with the row it is about and the role it gives; None where there is none."""
    i = 0
    for edit in audit:
        role = ROLES[NEXT[state]] if edit in "RI" else None
        if edit in "RI":
            state = FOLLOWS[state][NEXT[state]]
        elif edit == "K":
            state = FOLLOWS[state][rows[i].lower()]
        yield edit, None if edit == "I" else i, role
        i += edit != "I"


# --- tables ---------------------------------------------------------------------------


def marked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, fault, code`` of every row; null roles and texts become one space."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    ).withColumn("mark", F.md5("text"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy("turn"))
    shown = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.withColumn(
        "fault",
        F.when(shown == "", BLANK).when(seen > 1, DUPLICATE).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED),
    )
    gone = F.col("fault").isin(BLANK, DUPLICATE)
    return rows.withColumn("code", F.when(gone, "x").when(F.col("fault") == TRUNCATED, F.upper(code)).otherwise(code))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows sorted over all tasks by conversation and turn, each with its ``place``."""
    order = ["conv", "turn", "role", "mark"]
    spread = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return keep(spread.withColumn("place", F.monotonically_increasing_id()), "turns")


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def _streamed(df: DataFrame, shape: StructType, make: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Map each partition's rows, as tuples, to rows of another shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(make(rows), to_arrow_schema(shape))

    return df.mapInArrow(run, shape)


def _shape(conv: StructField, *fields: tuple[str, object]) -> StructType:
    return StructType([StructField("conv", conv.dataType), *(StructField(n, t) for n, t in fields)])


def solved(ordered: DataFrame, rows_per_block: int) -> DataFrame:
    """``conv, block, step, edit, place, new_role``: the edits of every conversation.

    Rows here carry one letter per turn and no text.
    """
    conv = ordered.schema["conv"]
    bits = rows_per_block.bit_length() - 1
    letters = F.array_sort(F.collect_list(F.struct("place", "code")))
    blocks = ordered.groupBy("conv", F.shiftright("place", bits).alias("block")).agg(letters.alias("l"), F.min("place").alias("first"))
    blocks = blocks.select("conv", "block", "first", F.array_join(F.col("l.code"), "").alias("rows"))
    blocks = blocks.withColumn("blocks", F.count("*").over(Window.partitionBy("conv")))

    def solve(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, block, first, codes, n in rows:
            if n == 1:
                cost, audit = search(codes)
                yield conv_id, block, first, codes, n, START, AFTER_A, cost, audit
                continue
            for state in STATES:
                for end in STATES:
                    if found := search(codes, state, (end,)):
                        yield conv_id, block, first, codes, n, state, end, *found

    long, text, int_ = LongType(), StringType(), IntegerType()
    ways = _streamed(
        blocks.select("conv", "block", "first", "rows", "blocks"),
        _shape(conv, ("block", long), ("first", long), ("rows", text), ("blocks", long), ("state", int_), ("end", int_), ("cost", long), ("audit", text)),
        solve,
    )
    one = ways.where("blocks = 1").select("conv", "block", "first", "rows", "state", "audit")
    several = ways.where("blocks > 1").repartition("conv").sortWithinPartitions("conv", "block", "state", "end")

    def chain(rows: Iterator[tuple]) -> Iterator[tuple]:
        """The best way through the blocks of each conversation."""
        for conv_id, of_conv in groupby(rows, lambda r: r[0]):
            # Per state: cost and audit so far, and the way there as nested pairs.
            reached: dict[int, tuple] = {START: (0, "", None)}
            for block, of_block in groupby(of_conv, lambda r: r[1]):
                after: dict[int, tuple] = {}
                for _, _, first, codes, _, state, end, cost, audit in of_block:
                    if state in reached:
                        so_far = reached[state]
                        way = so_far[0] + cost, so_far[1] + audit
                        if end not in after or way < after[end][:2]:
                            after[end] = *way, (so_far[2], (conv_id, block, first, codes, state, audit))
                reached = after
            link = min((reached[s] for s in COMPLETE if s in reached), key=lambda w: w[:2])[2]
            while link:
                link, row = link
                yield row

    chained = _streamed(several, _shape(conv, ("block", long), ("first", long), ("rows", text), ("state", int_), ("audit", text)), chain)

    def expand(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, block, first, codes, state, audit in rows:
            for step, (edit, i, role) in enumerate(steps(codes, audit, state)):
                yield conv_id, block, step, edit, None if i is None else first + i, role

    shape = _shape(conv, ("block", long), ("step", int_), ("edit", text), ("place", long), ("new_role", text))
    return _streamed(one.union(chained), shape, expand)


def repair(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """One row per edit: ``conv, block, step, edit, fault, turn, role, text, new_role, new_text``.

    Edits of a conversation follow each other by ``(block, step)``: K keeps a
    turn, R gives it another role, D deletes it (``new_role`` and ``new_text``
    are null), I inserts an empty one (``turn, role, text`` are null).  Turns go
    by number, nulls first; rows with the same number by role and by a digest of
    the text, so equal rows are neighbours.  A null role or text is one space,
    that is, blank.  A null conversation id is an id like any other.  An empty
    table gives an empty one; other columns are left out.
    """
    if rows_per_block & (rows_per_block - 1):
        raise ValueError("rows_per_block must be a power of two")
    ordered = in_order(marked(turns, conv_col, turn_col, role_col, text_col))
    edits = keep(solved(ordered, rows_per_block), "edits")
    rows = ordered.select("place", "fault", "turn", "role", "text")
    about = edits.where("place is not null").join(rows.hint("merge"), "place")
    stays = F.col("edit") != "D"
    about = about.select(
        "conv", "block", "step", "edit", "fault", "turn", "role", "text",
        F.when(stays, F.coalesce("new_role", "role")).alias("new_role"), F.when(stays, F.col("text")).alias("new_text"),
    )
    made = edits.where("place is null").select(
        "conv", "block", "step", "edit", F.lit(None).cast("string").alias("fault"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "new_role", F.lit("").alias("new_text"),
    )
    return about.union(made)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summary(edits: DataFrame) -> DataFrame:
    """Per conversation: faults, cost, ``audit`` and a digest of its repaired turns.

    Sorted edits run through each task; of a conversation only its counts, the
    audit and the state of the digest are held.
    """
    conv = edits.schema["conv"]
    shape = _shape(conv, *((n, LongType()) for n in SUMMARY), ("audit", StringType()), ("repaired_sha256", StringType()))
    order = ["conv", "block", "step"]
    source = edits.repartition("conv").sortWithinPartitions(*order).select("conv", "edit", "fault", F.col("turn").cast("long"), "role", "new_role", "new_text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, of_conv in groupby(rows, lambda r: r[0]):
            count = dict.fromkeys(SUMMARY, 0)
            low = high = before = None
            numbers, audit, digest, empty = 0, [], hashlib.sha256(), True
            for _, edit, fault, turn, role, new_role, new_text in of_conv:
                audit.append(edit)
                count["cost"] += COSTS[edit] + (CUT_OFF if fault == TRUNCATED and edit != "D" else 0)
                if edit != "I":
                    if fault:
                        count[fault] += 1
                    count["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
                    before = role[:1]
                    if turn is not None:
                        numbers += turn != high
                        low, high = turn if low is None else low, turn
                if edit != "D":
                    digest.update(f"{'' if empty else '\n'}{new_role}:{new_text}".encode())
                    empty = False
            if numbers:
                count["gaps"] = high - low + 1 - numbers
            yield conv_id, *count.values(), "".join(audit), digest.hexdigest()

    return _streamed(source, shape, run)


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of their ids: one in twenty each is dropped,
    emptied, stripped of ``.!?``, repeated, or given to the user.

    Null roles and texts become one space, and so does a null id within the hash.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.encode(F.concat_ws(":", *part), "UTF-8")) % 20).alias("h"),
    ).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies: Column = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")
