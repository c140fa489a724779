"""Conversation repair by composed weighted automata.

Three machines: the input acceptor has one arc for each row of a conversation;
the edit transducer keeps, reroles, deletes and inserts rows at a cost; the
role-grammar acceptor accepts the wanted order of roles. Their composition is
explored lazily, state by state, and its best path under the weight (cost,
label string) is the repair. Weights compare by cost, then by the string of edit
labels.

The composition is acyclic (no more inserts in a row than the grammar has states
to pass), so its states are taken in topological order. Label strings are only preserved in their order
by what is put before them, so distances are computed from the end backwards,
and the string is then spelled forwards along arcs that keep the distance: one
pass over the rows in each direction, with one distance for each grammar
state carried on the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
ROLES = ("user", "assistant")
FAR = 1 << 60


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: (state, initial) -> state. The default accepts (s?(ua)+)?."""

    arcs: dict[tuple[int, str], int] = field(default_factory=lambda: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2})
    accepting: frozenset[int] = frozenset({0, 3})
    states: int = 4


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # more for a truncated row that stays


class Composition:
    """Input, edits and grammar, composed where asked: a state is (rows read, grammar state, inserts since the last row)."""

    def __init__(self, grammar: Grammar = Grammar(), costs: Costs = Costs()):
        self.grammar, self.costs = grammar, costs
        self.inserts = grammar.states - 2 or 1  # as many in a row as pass through the grammar without meeting a state again, and more only cost
        self._known: dict = {}

    def consuming(self, initial: str, fault: int, q: int) -> list[tuple[str, int, int, str | None]]:
        """Arcs (label, cost, grammar state, role or None) that read a row in grammar state q, by label; the role is None where the row's own stays."""
        key = (initial, fault, q)
        if key not in self._known:
            arcs, c = [(DELETE, self.costs.delete, q, None)], self.costs
            if fault not in (BLANK, DUPLICATE):
                more = c.truncated if fault == TRUNCATED else 0
                if (q, initial) in self.grammar.arcs:
                    arcs.append((KEEP, more, self.grammar.arcs[q, initial], None))
                arcs += [(REROLE, c.rerole + more, self.grammar.arcs[q, r[0]], r) for r in ROLES if (q, r[0]) in self.grammar.arcs]
            self._known[key] = arcs
        return self._known[key]

    def inserting(self, q: int) -> list[tuple[str, int, int, str]]:
        return [(INSERT, self.costs.insert, self.grammar.arcs[q, r[0]], r) for r in ROLES if (q, r[0]) in self.grammar.arcs]

    def distances(self, after: list[int] | None, row: tuple[str, int] | None) -> list[list[int]]:
        """[inserts made][grammar state] -> least cost from there to the end. after: the distances once the row is read; row None: the end."""
        states = range(self.grammar.states)
        if row is None:
            read = [0 if q in self.grammar.accepting else FAR for q in states]
        else:
            read = [min((cost + after[to] for _, cost, to, _ in self.consuming(*row, q)), default=FAR) for q in states]
        out = [read]
        for _ in range(self.inserts):  # out[0]: no insert may follow
            out.insert(0, [min([read[q], *(cost + out[0][to] for _, cost, to, _ in self.inserting(q))]) for q in states])
        return out

    def steps(self, q: int, after: list[int] | None, row: tuple[str, int] | None) -> tuple[list[tuple[str, str | None]], int]:
        """The edits (label, role) from grammar state q until the row is read, least labels first among those that keep the distance, and the state then."""
        table, made, out = self.distances(after, row), 0, []
        while True:
            arcs = [] if row is None else [(label, to, role, cost + after[to], False) for label, cost, to, role in self.consuming(*row, q)]
            if made < self.inserts:
                arcs += [(label, to, role, cost + table[made + 1][to], True) for label, cost, to, role in self.inserting(q)]
            if row is None and q in self.grammar.accepting and table[made][q] == 0:
                return out, q
            best = [x for x in arcs if x[3] == table[made][q]]
            label, q, role, _, inserted = min(best, key=lambda x: x[0])  # labels are unambiguous: no two arcs of a state share one
            out.append((label, role))
            if not inserted:
                return out, q
            made += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of ``conv_id:turn`` % 20, in which as in role and text a null is one space.

    0: gone (kept as a mark, without text); 1: the text is emptied; 2: it loses its
    ``[.!?]``; 3: the row comes twice; 4: the role becomes user.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    rows = conversations.select(*ids, own("role").alias("role"), own("text").alias("text"))
    rows = rows.withColumn("_k", F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20)
    text = F.when(F.col("_k").isin(0, 1), "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role")), "gone": F.col("_k") == 0})
    return rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


REPAIRED = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.binary()), ("text", pa.binary()), ("fault", pa.int32()), ("gone", pa.bool_()), ("rest", pa.int64()), ("after", pa.list_(pa.int64()))])
TURNS = "conv_id long, seq long, role string, text string, edit string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.binary()), ("text", pa.binary()), ("edit", pa.string())])


def _faults(rows: DataFrame) -> DataFrame:
    """rows with again (role and text were seen earlier in the conversation) and fault, the first of a row's faults (0: none)."""
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(same) > 1
    bad = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("again"), DUPLICATE)
    bad = bad.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    return rows.withColumn("again", again).withColumn("fault", F.when(F.col("gone"), 0).otherwise(bad))


def _initial(role: bytes) -> str:
    return role[:1].decode("ascii", "replace")  # a grammar over other letters would need more


def _ordered(rows: DataFrame, grammar: Grammar, costs: Costs) -> DataFrame:
    """Rows of a conversation together and in order, each with the distances to the end from every grammar state once it is read.

    One shuffle by conversation; sorted backwards for the distances, then, in the same
    partitions, forwards. Both sorts spill; a task holds no conversation.
    """

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition(grammar, costs)
        conv, rest, after = object(), 0, []
        for batch in batches:
            rests, afters = [], []
            for c, role, fault, gone in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "fault", "gone"))):
                if c != conv:
                    conv, rest, after = c, 0, machine.distances(None, None)[0]
                rests.append(rest)
                afters.append(after)
                rest += 1
                if not gone:
                    after = machine.distances(after, (_initial(role), fault))[0]
            cols = [batch.column(n) for n in ("conv_id", "turn", "role", "text", "fault", "gone")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rests, pa.int64()), pa.array(afters, pa.list_(pa.int64()))], schema=_ROW)

    down = [F.col(c).desc_nulls_last() for c in ("conv_id", "turn", "role", "text", "again")]
    cols = ["conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault", "gone"]
    ordered = _faults(rows).repartition("conv_id").sortWithinPartitions(*down).select(*cols)
    told = ordered.mapInArrow(back, "conv_id long, turn long, role binary, text binary, fault int, gone boolean, rest long, after array<long>")
    return told.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("rest").desc())


class _Walk:
    """One conversation, read forwards."""

    def __init__(self, machine: Composition):
        self.machine, self.q, self.cost, self.audit = machine, 0, None, []
        self.rows, self.turns, self.low, self.high, self.turn = 0, 0, None, None, None
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.digest, self.said = hashlib.sha256(), False

    def _say(self, role: bytes, text: bytes) -> tuple[bytes, bytes]:
        self.digest.update(b"\n" * self.said + role + b":" + text)
        self.said = True
        return role, text

    def read(self, turn, role: bytes, text: bytes, fault: int, after: list[int]) -> list[tuple[bytes, bytes, str]]:
        """The repaired rows up to this one, with their edits."""
        initial = _initial(role)
        if self.cost is None:
            self.cost = self.machine.distances(after, (initial, fault))[0][0]
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = (turn if self.low is None else self.low), turn, turn
        self.rows += 1
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        edits, self.q = self.machine.steps(self.q, after, (initial, fault))
        return self._take(edits, role, text)

    def _take(self, edits, role: bytes, text: bytes) -> list[tuple[bytes, bytes, str]]:
        out = []
        for label, new in edits:
            self.audit.append(label)
            if label != DELETE:
                own = new.encode() if new else role
                out.append((*self._say(own, b"" if label == INSERT else text), label))
        return out

    def end(self) -> list[tuple[bytes, bytes, str]]:
        return self._take(self.machine.steps(self.q, None, None)[0], b"", b"") if self.rows else []

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.rows, gaps, *self.faults[1:], self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest())


def repair(rows: DataFrame, turns: bool = False, grammar: Grammar = Grammar(), costs: Costs = Costs()) -> DataFrame:
    """One row per conversation with its faults and the cheapest repair; with ``turns`` the repaired turns instead (conv_id, seq, role, text, edit).

    rows: conv_id, turn, role, text, and gone (boolean, optional): rows that
    only tell that the conversation exists. Other columns are ignored. Rows are
    taken by turn, nulls first, then role and text. A row's fault is the first of: blank (no
    ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (the last such
    character is none of ``.!?``). gaps counts turn numbers missing between the least and the greatest;
    illegal counts neighbours whose roles' initials aren't su, ua or au. Blank and
    duplicate rows must be deleted. audit spells the edits (K, R, D, I), of the cheapest
    repairs the least by code point; repaired_sha256 is of ``role:text``, joined by line feeds.

    Null roles and texts are one space; a null conv_id is a conversation. Conversations
    without rows have zeros, an empty audit and the hash of the empty string. A
    conversation's digest needs its rows in order, so one task reads a
    conversation, as a stream: it holds one Arrow batch and one letter for each edit.
    """
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), own("role"), own("text"), gone.alias("gone"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition(grammar, costs)
        conv, walk, seq, out = None, None, 0, []

        def close() -> None:
            if walk is None:
                return
            last = walk.end()
            if turns:
                out.extend((conv, seq + k, *x) for k, x in enumerate(last))
            else:
                out.append((conv, *walk.summary()))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            schema = _TURNS if turns else _OUT
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

        for batch in batches:
            for c, turn, role, text, fault, g, after in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "gone", "after"))):
                if walk is None or c != conv:
                    close()
                    conv, walk, seq = c, _Walk(machine), 0
                if not g:
                    said = walk.read(turn, role, text, fault, after)
                    if turns:
                        out.extend((conv, seq + k, *x) for k, x in enumerate(said))
                        seq += len(said)
            yield batch_of(out)
            out = []
        close()
        yield batch_of(out)

    told = _ordered(rows, grammar, costs).mapInArrow(read, TURNS.replace("role string, text string", "role binary, text binary") if turns else REPAIRED)
    return told.withColumns({c: F.col(c).cast("string") for c in ("role", "text")}) if turns else told
