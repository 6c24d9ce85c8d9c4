"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

The grammar of a conversation's role initials is C -> (nothing) | P | s P, P -> u a | P u a. A parse reads the turns in order, and its
heads are the tops of a graph-structured stack: cells (state, cell below) that all heads share. Before each turn, and at the end, a user
or assistant turn may be put in; a turn is kept, given another role, or deleted. Heads with an equal top are merged
by the minimum of (cost, audit), the audit being the edits' initials; since costs are a function of the edits, neither of two audits that meet
in a top is the beginning of the other, and the least one stays the least whatever follows. The audit also fixes the roles: their number is even, or
odd after a system turn, and users and assistants alternate.

Conversations up to LONG_ROWS rows and LONG_BYTES of text meet in one task each, sorted by Spark, a batch of rows at a time. A longer
one is dealt to all tasks: equal rows are counted first, rows are sorted over ranges of turns, each run of up to 1,024 rows is parsed
from every stack that it could begin with, and the runs' results are put together in order, which takes a few heads a run. Its repaired text is
hashed row by row as it streams by: a digest of one long text has to be made in order, but in little memory; the audit, a letter for each row, is the one thing
that is held whole, since it is a value of one row.

Cases: null roles and texts are one space; rows of one turn are ordered by role, then by the digest of role and text, so equal
rows stand together; rows with a null conv_id are a conversation; a role whose first character isn't s, u or a, an empty one too, can't be
kept; a conversation without rows after damage has zeros, an empty audit and the digest of an empty text; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import BATCH_ROWS, Scratch, bounded_batches

#: Costs of the edits; an undeleted truncated turn costs as much as an insertion.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar's SLR tables (state 6 ends u a, state 7 ends P u a; 0, 3 and 4 accept).
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 6, (3, "u"): 5, (4, "u"): 5, (5, "a"): 7}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
#: A conversation with more rows or bytes is parsed in runs.
LONG_ROWS, LONG_BYTES = 4096, 8_000_000
RUN_BITS = 10
ROLES = {"u": "user", "a": "assistant"}
_BLANK = r"^[\x20\x09-\x0D]*\z"


class Cell:
    """A stack: its top state and the stack below it. There is one object for each stack, so that heads share them."""

    _all: dict[tuple, Cell] = {}

    def __init__(self, state: int, below: Cell | None):
        self.state, self.below = state, below
        self.next: dict[str, Cell | None] = {}
        self.number = len(Cell._all)

    @classmethod
    def of(cls, state: int, below: Cell | None) -> Cell:
        key = (state, below and below.number)
        if key not in cls._all:
            cls._all[key] = cls(state, below)
        return cls._all[key]

    def shift(self, symbol: str) -> Cell | None:
        """The stack after a symbol, reduced as far as it goes; None if the grammar has no such symbol here."""
        if symbol not in self.next:
            state, top = SHIFT.get((self.state, symbol)), None
            if state is not None:
                top = Cell.of(state, self)
                while top.state in REDUCE:
                    for _ in range(REDUCE[top.state]):
                        top = top.below
                    top = Cell.of(GOTO[top.state], top)
            self.next[symbol] = top
        return self.next[symbol]


def _every_cell() -> list[Cell]:
    """All stacks that a parse can have between two turns."""
    seen = [Cell.of(0, None)]
    for cell in seen:
        seen += [x for s in "sua" if (x := cell.shift(s)) is not None and x not in seen]
    return seen


CELLS = _every_cell()
Heads = dict[Cell, tuple[int, str]]


def _merge(heads: Heads, cell: Cell | None, cost: int, audit: str) -> bool:
    if cell is None or cell in heads and heads[cell] <= (cost, audit):
        return False
    heads[cell] = (cost, audit)
    return True


def with_inserts(heads: Heads) -> Heads:
    """heads and all that insertions make of them."""
    out, todo = dict(heads), list(heads)
    while todo:
        cell = todo.pop()
        cost, audit = out[cell]
        for role in "ua":
            if _merge(out, after := cell.shift(role), cost + INSERT, audit + "I"):
                todo.append(after)
    return out


def advance(heads: Heads, symbol: str) -> Heads:
    """heads after one turn: x if it must go, else its role's initial (o for others), in upper case if it is truncated."""
    # what is put in before a deleted turn can as well be put in after it, with an audit that sorts first
    out: Heads = {cell: (cost + DELETE, audit + "D") for cell, (cost, audit) in heads.items()}
    if symbol != "x":
        kind, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for cell, (cost, audit) in with_inserts(heads).items():
            _merge(out, cell.shift(kind), cost + more, audit + "K")
            for role in "ua":
                _merge(out, cell.shift(role), cost + REROLE + more, audit + "R")
    return out


def parse(symbols: str, start: Cell) -> Heads:
    heads: Heads = {start: (0, "")}
    for symbol in symbols:
        heads = advance(heads, symbol)
    return heads


@lru_cache(maxsize=1 << 16)
def repair(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(v for cell, v in with_inserts(parse(symbols, CELLS[0])).items() if cell.state in ACCEPT)


def replay(audit: str, turns: Iterator[tuple[str, str]], odd: bool, at: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns that an audit makes of turns; odd: a system turn leads; at: repaired turns before these."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        yield edit, role if edit == "K" else ROLES["ua"[(at - odd) % 2]], text
        at += 1


def _odd(audit: str) -> bool:
    return (len(audit) - audit.count("D")) % 2 == 1


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the turns after a stated damage: what happens to a turn is told by its number; copies 0: dropped."""
    one = F.lit(" ")
    number = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(number == 4, "user").otherwise(role).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(number == 0, 0).when(number == 3, 2).otherwise(1).alias("copies"),
    )


def _flagged(turns: DataFrame) -> DataFrame:
    """turns with blank, truncated, the role's initial and a digest of role and text."""
    text: Column = F.col("text")
    return turns.select(
        "conv_id", "turn", "role", "text", "copies",
        F.sha2(F.concat("role", F.lit(":"), "text"), 256).alias("digest"),
        text.rlike(_BLANK).alias("blank"),
        (~F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z")).alias("truncated"),
        F.left("role", F.lit(1)).alias("initial"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]



def _symbol(initial: str, goes: bool, truncated: bool) -> str:
    if goes:
        return "x"
    kind = initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if truncated else kind


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Conversation:
    """The rows of one conversation that isn't long, as they come by."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.symbols, self.seen, self.numbers = conv_id, [], [], set(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None

    def add(self, r: dict) -> None:
        for _ in range(r["copies"]):
            if r["turn"] is not None:
                self.numbers.add(r["turn"])
            if self.last is not None and not _legal(self.last, r["initial"]):
                self.illegal += 1
            self.last = r["initial"]
            again, cut = r["digest"] in self.seen, False
            self.seen.add(r["digest"])
            if r["blank"]:
                self.blank += 1
            elif again:
                self.duplicate += 1
            elif cut := r["truncated"]:
                self.truncated += 1
            self.turns.append((r["role"], r["text"]))
            self.symbols.append(_symbol(r["initial"], r["blank"] or again, cut))

    def result(self) -> tuple:
        cost, audit = repair("".join(self.symbols))
        gaps = max(self.numbers) - min(self.numbers) + 1 - len(self.numbers) if self.numbers else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def repaired(self, audit: str) -> list[tuple[str, str, str]]:
        return list(replay(audit, iter(self.turns), _odd(audit)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Whether a conversation begins, and the row; rows come sorted by conversation."""
    before: tuple = ()
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["conv_id"],) != before, row
            before = (row["conv_id"],)


_FIGURES = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_LINES = [("position", "long"), ("edit", "string"), ("role", "string"), ("text", "string")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _in_order(df: DataFrame, order: list[Column], columns: list[tuple[str, str]], make) -> DataFrame:
    """What make(conversations' rows in order) yields, as a table of conv_id and `columns`; a conversation is in one task, streamed in batches."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv_type = [], None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        def made() -> pa.RecordBatch:
            types = [conv_type, *[_TYPES[t] for _, t in columns]]
            arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in columns]])

        for row in make(_rows(watched())):
            rows.append(row)
            if len(rows) >= BATCH_ROWS:
                yield made()
                rows = []
        if rows:
            yield made()

    placed = bounded_batches(df).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc(), *order)
    return placed.mapInArrow(run, ", ".join([f"conv_id {kind}", *[f"{n} {t}" for n, t in columns]]))


def _digest(lines: Iterator[tuple[str, str, str]]) -> str:
    out = hashlib.sha256()
    for i, (_, role, text) in enumerate(lines):
        out.update(f"{chr(10) * (i > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
    return out.hexdigest()


def _short(turns: DataFrame, lines: bool) -> DataFrame:
    """The figures and digest of each conversation, or its repaired turns."""

    def of(c: _Conversation) -> Iterator[tuple]:
        figures = c.result()
        out = c.repaired(figures[-1])
        if lines:
            yield from ((c.conv_id, i, *x) for i, x in enumerate(out))
        else:
            yield c.conv_id, *figures, _digest(iter(out))

    def make(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
        held = None
        for new, row in rows:
            if new:
                if held:
                    yield from of(held)
                held = _Conversation(row["conv_id"])
            held.add(row)
        if held:
            yield from of(held)

    return _in_order(turns, _order(), _LINES if lines else _FIGURES, make)


# conversations that are dealt to many tasks

_RUN = [("at", "long"), ("starts", "array<int>"), ("ends", "array<int>"), ("costs", "array<long>"), ("audits", "array<string>"), ("first", "string"), ("last", "string"), ("illegal", "long")]
_PLAN = [("at", "long"), ("letters", "string"), ("before", "long"), ("odd", "boolean"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]
#: From each stack to those in which a conversation may end, by insertions alone.
_CLOSING = [(i, CELLS.index(cell), cost, audit) for i, start in enumerate(CELLS) for cell, (cost, audit) in with_inserts({start: (0, "")}).items() if cell.state in ACCEPT]


def _parsed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of rows parsed from every stack."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            table, illegal, last = [], 0, None
            for row in r["rows"]:
                illegal += (last is not None and not _legal(last, row["initial"])) + (row["copies"] - 1) * (not _legal(row["initial"], row["initial"]))
                last = row["initial"]
            for i, start in enumerate(CELLS):
                heads: Heads = {start: (0, "")}
                for row in r["rows"]:
                    heads, more = advance(heads, row["symbol"]), row["copies"] - 1
                    if more:
                        heads = {cell: (cost + more * DELETE, audit + "D" * more) for cell, (cost, audit) in heads.items()}
                table += [(i, CELLS.index(cell), *v) for cell, v in heads.items()]
            out.append((r["at"], *map(list, zip(*table, strict=True)), r["rows"][0]["initial"], last, illegal))
        arrays = [batch.column("conv_id"), *[pa.array(v, _TYPES[t]) for v, (_, t) in zip(zip(*out, strict=True), _RUN, strict=True)]] if out else []
        if out:
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in _RUN]])


class _Rope:
    """An audit as a chain of runs' audits; ropes share what they begin with."""

    __slots__ = ("before", "piece")

    def __init__(self, before: _Rope | None, piece: str):
        self.before, self.piece = before, piece

    def less(self, other: _Rope) -> bool:
        a, b, x, y = self, other, [], []
        while a is not b:  # both have a piece for each run
            x.append(a.piece)
            y.append(b.piece)
            a, b = a.before, b.before
        return "".join(reversed(x)) < "".join(reversed(y))

    def pieces(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out.append(at.piece)
            at = at.before
        return out[::-1]


def _step(heads: dict[int, tuple[int, _Rope | None]], table) -> dict[int, tuple[int, _Rope | None]]:
    out: dict[int, tuple[int, _Rope | None]] = {}
    for start, end, cost, audit in table:
        if start in heads:
            total, rope = heads[start][0] + cost, _Rope(heads[start][1], audit)
            if end not in out or total < out[end][0] or total == out[end][0] and rope.less(out[end][1]):
                out[end] = (total, rope)
    return out


def _planned(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
    """The runs of each conversation with the letters of the cheapest audit that fall to them."""

    def of(conv_id, heads, places: list[int], illegal: int) -> Iterator[tuple]:
        ends = _step(heads, _CLOSING)
        cost, rope = ends.pop(next(iter(ends)))
        for other, r in ends.values():
            if other < cost or other == cost and r.less(rope):
                cost, rope = other, r
        *pieces, closing = rope.pieces()
        pieces[-1] += closing
        kept = [len(x) - x.count("D") for x in pieces]
        odd, before = sum(kept) % 2 == 1, 0
        for i, (at, letters) in enumerate(zip(places, pieces, strict=True)):
            end = i == len(places) - 1
            yield conv_id, at, letters, before, odd, illegal if end else None, cost if end else None, "".join(pieces) if end else None
            before += kept[i]

    state = None
    for new, r in rows:
        if new:
            if state:
                yield from of(*state)
            state, last = (r["conv_id"], {0: (0, None)}, [], 0), None
        conv_id, heads, places, illegal = state
        illegal += r["illegal"] + (last is not None and not _legal(last, r["first"]))
        heads, last = _step(heads, zip(r["starts"], r["ends"], r["costs"], r["audits"], strict=True)), r["last"]
        places.append(r["at"])
        state = (conv_id, heads, places, illegal)
    if state:
        yield from of(*state)


def _replayed(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of the repaired turns, a row at a time; a row with letters begins a run."""
    for _, first in rows:

        def turns(row: dict = first) -> Iterator[tuple[str, str]]:
            while True:
                for _ in range(row["copies"]):
                    yield row["role"], row["text"]
                row = next(rows)[1]

        for edit in replay(first["letters"], turns(), first["odd"], first["before"]):
            yield first["conv_id"], *edit


def _long(turns: DataFrame, ids: DataFrame, lines: bool, scratch: Scratch, run_bits: int) -> DataFrame:
    """As _short, for the conversations in ids."""
    same = ["conv_id", "turn", "role", "digest"]
    firsts = [F.first(c).alias(c) for c in ("text", "blank", "truncated", "initial")]
    counted = turns.where("copies > 0").groupBy(*same).agg(F.sum("copies").alias("copies"), *firsts)
    order = [F.col("conv_id").asc(), *_order()]
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.stage(placed, "rows")  # `at` is the order of all rows
    fresh = placed.groupBy("conv_id", "digest").agg(F.min("at").alias("fresh_at")).select("fresh_at")
    known = placed.join(fresh, F.col("at") == F.col("fresh_at"), "left").withColumn("again", F.col("fresh_at").isNull())
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    goes = F.col("blank") | F.col("again")
    known = known.withColumn("symbol", F.when(goes, "x").when(F.col("truncated"), F.upper(kind)).otherwise(kind))
    known = scratch.stage(known.select("conv_id", "turn", "at", "copies", "blank", "again", "truncated", "initial", "symbol"), "known")
    # a run is at most 2 ** run_bits rows of one conversation
    runs = known.groupBy("conv_id", F.shiftright("at", run_bits).alias("run")).agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "symbol", "initial", "copies"))).alias("rows"))
    schema = ", ".join([f"conv_id {turns.schema['conv_id'].dataType.simpleString()}", *[f"{n} {t}" for n, t in _RUN]])
    parsed = runs.select("conv_id", "at", "rows").mapInArrow(_parsed_runs, schema)
    plan = scratch.stage(_in_order(parsed, [F.col("at").asc()], _PLAN, _planned), "plan")
    rows = placed.select("conv_id", "at", "role", "text", "copies").join(plan.select("at", "letters", "before", "odd"), "at", "left")

    def repaired(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
        for conv_id, out in groupby(_replayed(rows), itemgetter(0)):
            yield from ((conv_id, i, *x[1:]) for i, x in enumerate(out))

    if lines:
        return _in_order(rows, [F.col("at").asc()], _LINES, repaired)

    def digests(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
        for conv_id, out in groupby(_replayed(rows), itemgetter(0)):
            yield conv_id, _digest(x[1:] for x in out)

    hashed = _in_order(rows, [F.col("at").asc()], [("repaired_sha256", "string")], digests)
    one = F.lit(1)
    figures = known.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(one))).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("again") & F.col("truncated"), one).otherwise(0)).alias("truncated"),
    )
    audits = plan.where("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit")
    out = ids.select(F.col("conv_id").alias("__id"))
    for part in (figures, audits, hashed):
        out = out.join(part.withColumnRenamed("conv_id", "__part"), F.col("__id").eqNullSafe(F.col("__part")), "left").drop("__part")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select(F.col("__id").alias("conv_id"), *[F.coalesce(F.col(n).cast(t), F.lit(nothing.get(n, 0)).cast(t)).alias(n) for n, t in _FIGURES])


def _repaired(turns: DataFrame, lines: bool, long_rows: int, long_bytes: int, run_bits: int) -> DataFrame:
    scratch = Scratch(turns.sparkSession, "conversations")
    sizes = turns.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    ids = scratch.stage(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id"), "long")
    if ids.isEmpty():
        return _short(_flagged(turns), lines)
    named = ids.withColumnRenamed("conv_id", "__long")
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    short = _short(_flagged(turns.join(named, same, "left_anti")), lines)
    return short.unionByName(_long(_flagged(turns.join(named, same, "left_semi")), ids, lines, scratch, run_bits))


def structure(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, run_bits: int = RUN_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in turns (as `damaged` returns them)."""
    return _repaired(turns, False, long_rows, long_bytes, run_bits)


def repaired_turns(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, run_bits: int = RUN_BITS) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text of the repaired conversations."""
    return _repaired(turns, True, long_rows, long_bytes, run_bits)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
