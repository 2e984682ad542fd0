"""Conversation repair by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  The
repair grammar is in Chomsky normal form.  Its nonterminals ``X[p, q]`` stand for
rows that lead from state ``p`` of the pattern to state ``q``:

* ``X[p, q] -> X[p, r] X[r, q]`` joins two neighbouring spans,
* ``X[p, q] -> row`` keeps, reroles or deletes one row,
* ``X[p, q] -> nothing`` inserts rows; its closure is part of every cell.

The cell of a span holds, for every nonterminal, the least (cost, audit).  Cells are
filled bottom-up by span length: rows, pairs, fours and so on.  As the
nonterminals name both ends of a span, every split of it gives the same cell, so one
split per length is enough and the work grows with the length, not its cube.
Audits of one cost, span and nonterminal are never prefixes of each other (each
further letter is an insertion, which costs), so the least audit of a span is the least
pair of the least audits of its parts.

Spark sorts the rows, without their texts, by conversation and turn, cut into ranges
that may divide a conversation.  Tasks emit a cell per span of at most
``SPAN_ROWS`` rows, and spans of one conversation are joined in rounds of
``_FANOUT`` neighbours.  The texts then pass once by their audit to be hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from trailframe.llm.common import BLANKS, hot_join
from trailframe.session import write_through

# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

SPAN_ROWS = 1 << 16
_FANOUT = 16
_MEMO = 8

# States of the pattern: at the start, after s, after u, after a; text may end in the first and last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: Per state, the state that a row with a role of this initial leads to.
_STEP = (
    {"s": _SYSTEM, "u": _USER},
    {"u": _USER},
    {"a": _ASSISTANT},
    {"u": _USER},
)
#: Rows that are inserted or reroled can only be the user's or the assistant's.
_NEXT = ((_USER, "user"), (_USER, "user"), (_ASSISTANT, "assistant"), (_USER, "user"))
_LEGAL = {"su", "ua", "au"}
_DELETED = "x"  # symbol of a row that has to go

Cell = tuple  # 16 entries, (cost, audit) or None, by 4 * p + q


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * 16
    for p in _STATES:
        for r in _STATES:
            left = x[4 * p + r]
            if left is None:
                continue
            for q in _STATES:
                right = y[4 * r + q]
                if right is not None:
                    both = (left[0] + right[0], left[1] + right[1])
                    if out[4 * p + q] is None or both < out[4 * p + q]:
                        out[4 * p + q] = both
    return tuple(out)


def _insertions() -> Cell:
    """The least insertions between any two states."""
    once: list = [(0, "") if p == q else None for p in _STATES for q in _STATES]
    for p, (q, _) in enumerate(_NEXT):
        once[4 * p + q] = (INSERT, "I")
    # Two more insertions lead back to the same state, so no cheapest way has more than two.
    return joined(tuple(once), tuple(once))


NOTHING = _insertions()


@lru_cache(maxsize=None)
def _row_cell(symbol: str) -> Cell:
    """The cell of one row: ``x`` has to go; else the initial, as capital letter if truncated."""
    out: list = [(DELETE, "D") if p == q else None for p in _STATES for q in _STATES]
    if symbol != _DELETED:
        more = TRUNCATED if symbol.isupper() else 0
        for p in _STATES:
            edits = [(_NEXT[p][0], (REROLE + more, "R"))]
            if symbol.lower() in _STEP[p]:
                edits.append((_STEP[p][symbol.lower()], (more, "K")))
            for q, edit in edits:
                if out[4 * p + q] is None or edit < out[4 * p + q]:
                    out[4 * p + q] = edit
    return joined(joined(NOTHING, tuple(out)), NOTHING)


def _up(cells: list[Cell]) -> Cell:
    """Joins neighbours until one span is left."""
    while len(cells) > 1:
        pairs = [joined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[2 * len(pairs) :]
    return cells[0] if cells else NOTHING


@lru_cache(maxsize=1 << 15)
def _short_cell(symbols: str) -> Cell:
    return _up([_row_cell(s) for s in symbols])


def span_cell(symbols: str) -> Cell:
    """The cell of a span; equal short spans are parsed once per worker."""
    return _up([_short_cell(symbols[i : i + _MEMO]) for i in range(0, len(symbols), _MEMO)])


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(c for c in (cell[4 * _START + _START], cell[4 * _START + _ASSISTANT]) if c is not None)


class Repair:
    """Hashes the repaired rows of one conversation as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.empty = audit, 0, _START, True
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update((role + ":" if self.empty else "\n" + role + ":").encode())
        self.hash.update(text.encode())
        self.empty = False

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, role = _NEXT[self.state]
            self._line(role, "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = _STEP[self.state][role[0]]
                self._line(role, text)
            elif edit == "R":
                self.state, role = _NEXT[self.state]
                self._line(role, text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after a damage that depends on conversation and turn.

    Nulls read as one space.  By the remainder of a checksum a row is dropped (no copies),
    loses its text or its sentence ends, is repeated, or becomes the user's.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    return turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def _facts(turns: DataFrame) -> DataFrame:
    """What the parse needs of each row, without its text."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return turns.select(
        "conv_id",
        "turn",
        # Rows without copies only say that the conversation is there.
        F.when(F.col("copies") > 0, _digest()).alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        "copies",
    )


_CELL = "costs array<bigint>, audits array<string>"
_COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")
_SPAN = (
    "conv_id {kind}, part int, span int, alone boolean, min_turn bigint, max_turn bigint, "
    + ", ".join(f"{c} bigint" for c in _COUNTS)
    + ", first_initial string, last_initial string, "
    + _CELL
)


class _Span:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv):
        self.conv, self.symbols, self.cell = conv, [], None
        self.min_turn = self.max_turn = self.first = self.last = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn, initial: str, fault: str | None, copies: int) -> None:
        c = self.counts
        if turn is not None:
            c["n_turns"] += turn != self.max_turn or self.max_turn is None
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
        if self.first is None:
            self.first = initial
        else:
            c["illegal"] += self.last + initial not in _LEGAL
        c["illegal"] += copies - 1  # two equal initials in a row
        self.last = initial
        c["n_rows"] += copies
        if fault is not None:
            c[fault] += copies
        known = initial if initial in ("s", "u", "a") else "o"
        self.symbols += {None: known, "truncated": known.upper()}.get(fault, _DELETED) * copies

    def follow(self, other: _Span) -> None:
        """Appends the span behind this one."""
        a, b = self.counts, other.counts
        illegal = self.first is not None and other.first is not None and self.last + other.first not in _LEGAL
        same = self.max_turn is not None and self.max_turn == other.min_turn
        self.counts = {k: a[k] + b[k] for k in _COUNTS}
        self.counts["illegal"] += illegal
        self.counts["n_turns"] -= same
        self.min_turn = other.min_turn if self.min_turn is None else self.min_turn
        self.max_turn = self.max_turn if other.max_turn is None else other.max_turn
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.cell = joined(self.cell, other.cell)

    def close(self) -> _Span:
        self.cell = span_cell("".join(self.symbols))
        self.symbols = []
        return self

    def row(self, part: int, span: int, alone: bool) -> tuple:
        costs, audits = ([None if c is None else c[k] for c in self.cell] for k in (0, 1))
        counts = [self.counts[c] for c in _COUNTS]
        return (self.conv, part, span, alone, self.min_turn, self.max_turn, *counts, self.first, self.last, costs, audits)

    @classmethod
    def read(cls, r: dict) -> _Span:
        out = cls(r["conv_id"])
        out.min_turn, out.max_turn, out.first, out.last = r["min_turn"], r["max_turn"], r["first_initial"], r["last_initial"]
        out.counts = {k: r[k] for k in _COUNTS}
        out.cell = tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*[c.to_pylist() for c in batch.columns]):
            yield dict(zip(names, values))


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _spans(facts: DataFrame, span_rows: int) -> DataFrame:
    """Cells of the spans of sorted facts; ``alone`` if a span is surely a whole conversation."""
    schema = _SPAN.format(kind=facts.schema["conv_id"].dataType.simpleString())
    arrow = to_arrow_schema(facts.sparkSession.createDataFrame([], schema).schema)

    def runs(rows: Iterator[dict], part: int) -> Iterator[tuple]:
        span, number, first_run, seen = None, 0, True, None
        for r in rows:
            if span is None or span.conv != r["conv_id"]:
                if span is not None:
                    yield span.close().row(part, number, not first_run and not number)
                    first_run = False
                span, number, seen = _Span(r["conv_id"]), 0, None
            # The first copy counts as earlier for the others, as does an equal row of this turn.
            this = (r["turn"], r["digest"])
            later = r["later"] or this == seen
            seen = this
            left = r["copies"]
            fault = "blank" if r["blank"] else "duplicate" if later else "truncated" if r["cut"] else None
            for copies, fault in ((min(left, 1), fault), (left - 1, "blank" if r["blank"] else "duplicate")):
                while copies > 0:
                    if len(span.symbols) >= span_rows:
                        yield span.close().row(part, number, False)
                        span, number = _Span(r["conv_id"]), number + 1
                    some = min(copies, span_rows - len(span.symbols))
                    span.add(r["turn"], r["initial"], fault, some)
                    copies -= some
        if span is not None:
            yield span.close().row(part, number, False)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(runs(_rows(batches), TaskContext.get().partitionId()), arrow)

    order = ["conv_id", "turn", "digest"]
    return facts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cells, schema)


def _merged(spans: DataFrame, level: str) -> DataFrame:
    """Joins up to ``_FANOUT`` spans of a conversation that follow each other by ``level``."""
    arrow = to_arrow_schema(spans.schema)
    schema = spans.schema

    def runs(rows: Iterator[dict]) -> Iterator[tuple]:
        span, at = None, None
        for r in rows:
            here = (r["conv_id"], *((r["part"], r["span"] // _FANOUT) if level == "span" else (r["part"] // _FANOUT, 0)))
            if here == at:
                span.follow(_Span.read(r))
                continue
            if span is not None:
                yield span.row(at[1], at[2], False)
            span, at = _Span.read(r), here
        if span is not None:
            yield span.row(at[1], at[2], False)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(runs(_rows(batches)), arrow, 50)

    group = [F.col("part"), F.floor(F.col("span") / _FANOUT)] if level == "span" else [F.floor(F.col("part") / _FANOUT)]
    dealt = spans.repartition("conv_id", *group).sortWithinPartitions("conv_id", "part", "span")
    return dealt.mapInArrow(join, schema)


def parsed(facts: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One span per conversation, from the facts of its rows."""
    # Equal rows of a turn become one with a number of copies before they are shuffled.
    keys = ["conv_id", "turn", "digest"]
    facts = facts.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("initial", "blank", "cut")], F.sum("copies").alias("copies")
    )
    facts = write_through(facts, "turn-facts")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = facts.groupBy("conv_id", "digest").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
    marked = hot_join(facts, firsts, ["conv_id", "digest"], "n", facts.count())
    marked = marked.withColumn("later", place > F.col("earliest")).drop("earliest")
    spans = write_through(_spans(marked, span_rows), "spans")
    whole, rest = spans.where("alone"), spans.where("not alone")
    for level in ("span", "part"):
        while (rest.agg(F.max(level)).first()[0] or 0) > 0:
            rest = write_through(_merged(rest, level), f"spans-{level}")
    return whole.unionByName(rest)


def repair_conversations(turns: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Faults of each conversation and its cheapest repair.

    ``turns(conv_id, turn, role, text, copies)`` are rows as ``damaged`` gives them; a row
    without copies only names its conversation.  Columns of the result: ``conv_id``,
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    and ``repaired_sha256``.  A conversation is taken by turn, nulls first; rows of one
    turn follow each other by a digest of role and text, so copies are neighbours.
    A null ``conv_id`` is a conversation of its own.  A role that is empty or begins
    with no letter of the pattern cannot be kept.  Without rows all numbers are
    zero, the audit is empty and the hash that of the empty text.  Further columns are
    ignored; an empty table gives no rows.

    The audit is one string per conversation and the hash a function of all its text
    in order, so a conversation's rows pass through one task at the end; that task holds
    the audit and one batch of rows.
    """
    turns = turns.select("conv_id", "turn", "role", "text", "copies")
    whole = parsed(_facts(turns), span_rows)
    start, end = 4 * _START + _START, 4 * _START + _ASSISTANT
    options = [
        F.when(F.col("costs")[k].isNotNull(), F.struct(F.col("costs")[k].alias("cost"), F.col("audits")[k].alias("audit")))
        for k in (start, end)
    ]
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    reports = whole.withColumn("best", F.least(*options)).select(
        "conv_id",
        gaps.cast("bigint").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"),
    )
    reports = write_through(reports, "conversation-reports")
    rows = turns.where("copies > 0").select(
        "conv_id",
        F.lit(1).alias("kind"),
        "turn",
        _digest().alias("digest"),
        "role",
        # Blank rows are deleted whatever they hold.
        F.when(F.rtrim(F.col("text"), F.lit(BLANKS)) != "", F.col("text")).otherwise("").alias("text"),
        "copies",
    )
    stream = rows.unionByName(reports.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    schema = StructType([*reports.schema, StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)
    names = arrow.names[:-1]

    def repaired(rows: Iterator[dict]) -> Iterator[tuple]:
        report, repair = None, None
        for r in rows:
            if r["kind"] == 0:
                if report is not None:
                    yield (*report, repair.digest())
                report, repair = [r[c] for c in names], Repair(r["audit"])
            else:
                repair.row(r["role"], r["text"], r["copies"])
        if report is not None:
            yield (*report, repair.digest())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(repaired(_rows(batches)), arrow)

    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return dealt.mapInArrow(hashed, schema)
