"""Conversation structure repair by Hirschberg's divide and conquer.

Rows are kept (0), given the role user or assistant (1), deleted (2), and empty user or assistant turns
are inserted (5), so that the role initials read ``(s?(ua)+)?``.  Blank rows and repeats must be deleted; a
truncated row that stays costs 5 more.  Four states suffice: nothing yet, after s, after u, after a.

A row is one of a few symbols (its initial and its fault), and a symbol is a 4 x 4 table of the cheapest
edits from state to state, insertions standing before the row they precede.  The audit is the string of
edit initials in order.  Audits of the same rows that end in different states are never prefixes of one
another (each ends in the letter of the last row), so the order of two audits is decided by their first
halves: beside its cost a state keeps its audit's rank among the four.  Halves then meet as in Hirschberg's
method: the forward vector of (cost, rank) of the first half and the backward vector of costs of the second
meet in the middle, of the cheapest crossings the one of the least rank is taken, and both halves are
solved again with their end states fixed.  Only vectors of four are held beside the result.  Vectors less
their minimum are few, so steps are looked up in a cache.

Spark shuffles the rows by conversation and sorts them; a task streams over them and holds one
conversation at a time, which is the operator's unit (its digest is sequential, too).

Defined cases: null role and text are one space, so such a row is blank; null turns come first; rows of one
turn are ordered by role and text; rows with a null conversation id are one conversation; an initial other
than s, u, a cannot be kept; a conversation without rows has an empty audit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, RELABEL, DELETE, TRUNCATED = 5, 1, 2, 5
SPACES = " \t\n\x0b\f\r"
NAMES = {"u": "user", "a": "assistant"}
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # states: 0 nothing yet, 1 after s, 2 after u, 3 after a
TAIL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # to an end from each state
WANTED = tuple(next(i for i in "ua" if i in step) for step in AFTER)  # what may be inserted or a row be named
FINE, CUT, GONE = 0, 1, 2
Vector = tuple[tuple[int, int] | None, ...]


def symbol(initial: str, fault: int) -> int:
    return ("-sua".find(initial) if initial and initial in "sua" else 0) * 3 + fault


@lru_cache(None)
def edits(sym: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """For each state before the row: state after it -> (cost, audit letters) of the cheapest, then least, edits."""
    initial, fault = "-sua"[sym // 3], sym % 3
    table = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, letters = start, 0, ""
        for _ in range(3):  # a third insertion would lead back
            ways = [(state, DELETE, "D")]
            if fault != GONE:
                extra = TRUNCATED * (fault == CUT)
                ways.append((AFTER[state][WANTED[state]], RELABEL + extra, "R"))
                if initial in AFTER[state]:
                    ways.append((AFTER[state][initial], extra, "K"))
            for end, more, letter in ways:
                best[end] = min(best.get(end, (1 << 60, "")), (cost + more, letters + letter))
            state, cost, letters = AFTER[state][WANTED[state]], cost + INSERT, letters + "I"
        table.append(best)
    return tuple(table)


@lru_cache(1 << 16)
def _forward(vector: Vector, sym: int) -> tuple[Vector, int]:
    """The vector of (cost less the smallest, rank) after one more row, and the smallest cost."""
    best: dict[int, tuple[int, int, str]] = {}
    for state, entry in enumerate(vector):
        if entry is not None:
            for end, (cost, letters) in edits(sym)[state].items():
                way = (entry[0] + cost, entry[1], letters)
                if end not in best or way < best[end]:
                    best[end] = way
    low = min(w[0] for w in best.values())
    order = sorted(best, key=lambda end: best[end][1:])
    return tuple((best[end][0] - low, order.index(end)) if end in best else None for end in range(4)), low


@lru_cache(1 << 16)
def _backward(costs: tuple, sym: int) -> tuple:
    """Costs less the smallest from each state before the row to the end state (None: out of reach)."""
    out = []
    for table in edits(sym):
        ways = [cost + costs[end] for end, (cost, _) in table.items() if costs[end] is not None]
        out.append(min(ways) if ways else None)
    low = min(c for c in out if c is not None)
    return tuple(None if c is None else c - low for c in out)


def _start(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def _pieces(rows: bytes, lo: int, hi: int, start: int, end: int) -> Iterator[str]:
    """The least of the cheapest edits of rows lo..hi from state to state, row by row."""
    if hi - lo == 1:
        yield edits(rows[lo])[start][end][1]
        return
    mid = (lo + hi) // 2
    fore = _start(start)
    for i in range(lo, mid):
        fore = _forward(fore, rows[i])[0]
    back = tuple(0 if s == end else None for s in range(4))
    for i in range(hi - 1, mid - 1, -1):
        back = _backward(back, rows[i])
    _, _, cross = min((fore[s][0] + back[s], fore[s][1], s) for s in range(4) if fore[s] is not None and back[s] is not None)
    yield from _pieces(rows, lo, mid, start, cross)
    yield from _pieces(rows, mid, hi, cross, end)


def _solve(rows: bytes) -> tuple[int, tuple[str, ...]]:
    vector, total = _start(0), 0
    for sym in rows:
        vector, low = _forward(vector, sym)
        total += low
    cost, _, end = min((entry[0] + TAIL[s][0], entry[1], s) for s, entry in enumerate(vector) if entry is not None)
    return total + cost, (*_pieces(rows, 0, len(rows), 0, end), TAIL[end][1])


_solve_short = lru_cache(1 << 14)(_solve)


def repair_edits(rows: bytes) -> tuple[int, tuple[str, ...]]:
    """(cost, edits per row and the insertions after the last) of a sequence of symbols."""
    if not rows:
        return 0, ("",)
    return _solve_short(rows) if len(rows) <= 32 else _solve(rows)


def repaired(edit_rows: tuple[str, ...], turns: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns as edited."""
    state = 0
    for letters, turn in zip(edit_rows, [*turns, None]):
        for letter in letters:
            if letter == "D":
                continue
            role, text = ("", "") if letter == "I" else turn
            initial = role[:1] if letter == "K" else WANTED[state]
            yield (role if letter == "K" else NAMES[initial]), text
            state = AFTER[state][initial]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with nulls as one space and every twentieth of each kind of damage; ``kept`` is false for dropped
    rows, which stay as marks of their conversation."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") != 0).alias("kept"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _last(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


class _Conversation:
    """Rows of one conversation as they stream by, and what is found in them."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.symbols, self.seen = conv_id, [], bytearray(), set()
        self.low = self.high = self.last_turn = None
        self.distinct = 0
        self.faults, self.illegal = {"blank": 0, "duplicate": 0, "truncated": 0}, 0

    def add(self, turn, role, text, last) -> None:
        if turn is not None and turn != self.last_turn:  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.distinct += 1
        if self.turns and self.turns[-1][0][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        fault, key = FINE, hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not last:
            fault, name = GONE, "blank"
        elif key in self.seen:
            fault, name = GONE, "duplicate"
        elif last not in ".!?":
            fault, name = CUT, "truncated"
        if fault != FINE:
            self.faults[name] += 1
        self.seen.add(key)
        self.symbols.append(symbol(role[:1], fault))
        self.turns.append((role, text))

    def result(self) -> dict:
        cost, pieces = repair_edits(bytes(self.symbols))
        digest, first = hashlib.sha256(), True
        for role, text in repaired(pieces, self.turns):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost,
                "audit": "".join(pieces), "repaired_sha256": digest.hexdigest(), "pieces": list(pieces)}


SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, pieces array<string>")
_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string()), ("repaired_sha256", pa.string()), ("pieces", pa.list_(pa.string()))])


def _repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv_id, turn, role, text, kept, last in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            if kept:
                now.add(turn, role, text, last)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_pylist(done, _ARROW)
            done = []
    if now is not None:
        done.append(now.result())
    if done:
        yield pa.RecordBatch.from_pylist(done, _ARROW)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, kept): faults, cost, audit, the edits of each row in
    order (``pieces``, the last holds the insertions at the end) and the digest of the repaired turns."""
    keyed = rows.select("conv_id", "turn", "role", "text", "kept", _last(F.col("text")).alias("last"))
    return (keyed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
            .mapInArrow(_repair_rows, SCHEMA))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damaged conversations, repaired: the columns of the report without the edits of single rows."""
    return repair(damage(conversations)).drop("pieces")
