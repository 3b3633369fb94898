"""Repair of the structure of conversations by the cheapest edits.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``.  Edits: Keep a row (free; 1 if it is truncated), Rerole it to
user or assistant (2; 3 if truncated), Delete it (3; required for blank rows
and duplicates), Insert an empty row of user or assistant anywhere (2).  Of all
edits of least cost the audit, the initials of the edits in order, is the
ASCII-least.

One integer is the weight of a way: its high digits are the cost, its low
digits the audit's letters from the left, in a fixed width and with zeros
behind the end, so a shorter audit sorts before its continuations.  The least
integer over a graph of rows and states (nothing yet, after a system row, after
a user row, after an assistant row) decides all, ties included.

Long conversations are cut into blocks of rows, so that no integer grows with
them.  At a block's border each state keeps its cost and its *rank* among the
audits that continue from there; the rank is the weight's last digit.  This
loses nothing: within a block all audits hold as many letters of rows and end
in one, so none is the beginning of another.  The audit alone fixes the repaired
roles, because only one role can follow in each state.

Rows are ordered by turn (nulls first), then role, then md5 of the text;
identical rows cannot be told apart, so ties have one result.  A null in any
column counts as one space (a null ``turn`` stays the first).  An empty role has
no initial and is never kept, like any role that starts with another letter.
Repeated rows are duplicates.  Rows of a null ``conv_id`` are one conversation.
Only the columns named here are read.

Spark deals rows by conversation and sorts them; tasks read the sorted rows as a
stream.  Plans read narrow rows without texts and hold some bytes a row of one
conversation; repairs hold one audit and one batch.  Which row is the first of
its role and text comes from a pre-aggregated table whose rows are sorted in
among the others, so neither a set of seen texts nor a join is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What keeping a row of an initial leads to, by state; -1: not allowed.
KEEPS = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: The state after a row whose role may be chosen; there is one such role in each state.
FREE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Rows of a block.  Results do not depend on it.
BLOCK = 64

#: Faults of rows; a row counts for the first that it has.
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)


class Weights:
    """Integers cost | letters | rank for audits of at most ``width`` letters."""

    def __init__(self, width: int):
        self.top = 3 * width  # 3 bits a letter, and 3 for the rank
        self.cost = self.top + 3
        self.low = (1 << self.cost) - 1
        self.digit = {x: (i + 1) << self.top for i, x in enumerate(LETTERS)}
        self.rank = 7

    def start(self, cost: int, rank: int) -> int:
        return cost << self.cost | rank

    def before(self, weight: int, letter: str, cost: int) -> int:
        """The way of ``weight`` with one more edit in front."""
        letters = (weight & self.low) >> 3
        return ((weight >> self.cost) + cost << self.cost) | self.digit[letter] | (letters >> 3) << 3 | weight & self.rank

    def letters(self, weight: int) -> str:
        found, at = [], self.top
        while at > 0 and (digit := weight >> at & 7):
            found.append(LETTERS[digit - 1])
            at -= 3
        return "".join(found)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _with_inserts(weights: Weights, here: list[int | None]) -> list[int | None]:
    """Up to two inserted rows before ``here``: more would come back to a state already passed."""
    found = here
    for _ in range(2):
        found = [
            _least(x, None if (y := found[FREE[q]]) is None else weights.before(y, "I", INSERT))
            for q, x in enumerate(here)
        ]
    return found


def _block(rows: list[tuple[str, int]], ends: list[tuple[int, int] | None], last: bool):
    """(cost, rank) and letters of each state before ``rows``, given those of ``ends`` behind them."""
    weights = Weights(3 * len(rows) + 2)
    after = [None if e is None else weights.start(*e) for e in ends]
    if last:
        after = _with_inserts(weights, after)
    for initial, fault in reversed(rows):
        extra, keeps, here = int(fault == TRUNCATED), KEEPS.get(initial), []
        for q in range(4):
            best = None if after[q] is None else weights.before(after[q], "D", DELETE)
            if fault not in (BLANK, DUPLICATE):
                if keeps and keeps[q] >= 0 and (x := after[keeps[q]]) is not None:
                    best = _least(best, weights.before(x, "K", KEEP + extra))
                if (x := after[FREE[q]]) is not None:
                    best = _least(best, weights.before(x, "R", REROLE + extra))
            here.append(best)
        after = _with_inserts(weights, here)
    order = sorted({w & weights.low for w in after if w is not None})
    place = {x: i for i, x in enumerate(order)}
    states = [None if w is None else (w >> weights.cost, place[w & weights.low]) for w in after]
    return states, [None if w is None else weights.letters(w) for w in after]


def step(state: int, letter: str, initial: str) -> int:
    """The state after one edit."""
    return state if letter == "D" else KEEPS[initial][state] if letter == "K" else FREE[state]


def cheapest(rows: list[tuple[str, int]], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of rows (initial of the role, fault)."""
    states: list[tuple[int, int] | None] = [(0, 0), None, None, (0, 0)]
    cuts = range(0, len(rows), block) if rows else [0]
    audits = []
    for i, at in enumerate(reversed(cuts)):
        states, letters = _block(rows[at : at + block], states, last=i == 0)
        audits.append(letters)
    parts, state, row = [], NOTHING, 0
    for letters in reversed(audits):
        parts.append(letters[state])
        for x in letters[state]:
            state = step(state, x, rows[row][0] if x != "I" else "")
            row += x != "I"
    return states[NOTHING][0], "".join(parts)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the contract's damage by crc32(conv_id:turn) % 20; nulls are one space."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    found = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    bare = F.regexp_replace("text", "[.!?]", "")
    return found.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, bare).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, copies with nulls as one space."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
        copies.cast("int").alias("copies"),
    )


def _streamed(parts: list[DataFrame], order: list) -> DataFrame:
    """Rows of all parts, dealt by conversation and sorted in each task."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _lists(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names])


#: One object for all rows that are alike.
_ALIKE: dict[tuple[str, int], tuple[str, int]] = {}


class _Conversation:
    """Counts of one conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.faults = conv_id, [], [0, 0, 0, 0]
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn, initial, fault) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        row = (initial, fault)
        self.rows.append(_ALIKE.setdefault(row, row) if initial in KEEPS else row)
        self.faults[fault] += 1

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[:SOUND], self.illegal, *cheapest(self.rows))


def reports(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id and ``REPORT``; also for the ids of ``conversations`` that have no turns left."""
    rows = _turns(turns)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(SOUND).cast("int")
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", F.lit(2).alias("kind"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies"
    )
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("first")
    )
    firsts = firsts.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(1).alias("kind"))
    ids = (turns if conversations is None else conversations).select("conv_id").distinct().withColumn("kind", F.lit(0))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), "kind"]
    id_type = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(REPORT)])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, out, now, opened = to_arrow_schema(schema), [], None, False
        names = ["conv_id", "turn", "kind", "initial", "fault", "copies"]

        def flush():
            columns = list(zip(*out)) or [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            for conv_id, turn, kind, initial, fault, copies in _lists(batch, names):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.report())
                    now = _Conversation(conv_id)
                if kind == 1:
                    opened = True
                elif kind == 2:
                    for _ in range(copies):
                        now.add(turn, initial, fault if opened or fault == BLANK else DUPLICATE)
                        opened = False
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if now is not None:
            out.append(now.report())
        yield flush()

    return _streamed([narrow, firsts, ids], order).select("conv_id", "turn", "kind", "initial", "fault", "copies").mapInArrow(plan, schema)


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, by the audits of ``found`` (see ``reports``).

    Columns conv_id, report, place, edit, role, text.  Each conversation begins
    with one row of place 0 that holds its report and no role; the repaired rows
    follow from 1.  In a task, a conversation's rows follow each other in order,
    so ``digests`` needs no further shuffle.
    """
    fields = [x.name for x in T.StructType.fromDDL(REPORT)]
    heads = found.select("conv_id", F.struct(*fields).alias("report"), F.lit(0).alias("kind"))
    rows = _turns(turns).withColumn("kind", F.lit(1))
    order = ["kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    schema = T.StructType(
        [
            T.StructField("conv_id", turns.schema["conv_id"].dataType),
            T.StructField("report", T.StructType.fromDDL(REPORT)),
            *T.StructType.fromDDL("place long, edit string, role string, text string"),
        ]
    )

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        conv, audit, at, place, state = None, "", 0, 0, NOTHING
        for batch in batches:
            out = []

            def inserted():
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    state, at, place = FREE[state], at + 1, place + 1
                    out.append((conv, None, place, "I", ROLES[state], ""))

            for conv_id, kind, report, role, text, copies in _lists(batch, ["conv_id", "kind", "report", "role", "text", "copies"]):
                if kind == 0:
                    conv, audit, at, place, state = conv_id, report["audit"], 0, 0, NOTHING
                    out.append((conv, report, 0, None, None, None))
                    inserted()
                    continue
                for _ in range(copies):
                    letter, at = audit[at], at + 1
                    state = step(state, letter, role[:1])
                    if letter != "D":
                        place += 1
                        out.append((conv, None, place, letter, ROLES[state] if letter == "R" else role, text))
                    inserted()
            columns = list(zip(*out)) or [()] * len(out_schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out_schema)], schema=out_schema)

    streamed = _streamed([heads, rows], order).select("conv_id", "kind", "report", "role", "text", "copies")
    return streamed.mapInArrow(edits, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, the report's columns, repaired_sha256 over ``role:text`` lines, of ``repair``'s rows in their order."""
    fields = [x.name for x in T.StructType.fromDDL(REPORT)]
    schema = T.StructType(
        [repaired.schema["conv_id"], *T.StructType.fromDDL(REPORT), *T.StructType.fromDDL("repaired_sha256 string")]
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, out, head, state = to_arrow_schema(schema), [], None, None
        for batch in batches:
            for conv_id, report, place, role, text in _lists(batch, ["conv_id", "report", "place", "role", "text"]):
                if place == 0:
                    if head is not None:
                        out.append((*head, state.hexdigest()))
                    head, state = (conv_id, *[report[x] for x in fields]), hashlib.sha256()
                else:
                    state.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            columns = list(zip(*out)) or [()] * len(out_schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out_schema)], schema=out_schema)
            out = []
        if head is not None:
            columns = list(zip((*head, state.hexdigest())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out_schema)], schema=out_schema)

    return repaired.mapInArrow(hashed, schema)
