"""Repair of conversation structure by generalised LR parsing of the roles.

A well-formed conversation is empty or an optional system turn and then user-assistant pairs.
``RULES`` says so as a grammar, ``Automaton`` makes its SLR tables, and ``Repairer`` reads the
rows once. Where LR parsing would stop, every priced edit is tried: keep a row, give it the
role of a user or assistant, delete it, or insert an empty turn. The alternatives live in one
graph-structured stack: stacks share their lower parts, and stacks with equal tops and equal
rests are one node, which keeps the least ``(cost, audit)``. The audit is the string of edit
initials (D, I, K, R), so equal costs are settled by ASCII order.

Two facts bound the memory. A stack that costs over ``Prices.slack`` more than the cheapest one
can never win, since the cheapest can be brought to accept whatever the other accepts for that
much. And audits are compared by rank: audits that end with the edit of the same row either
differ before their ends or are equal, so a small integer per stack stands for its audit, and
edits are written out as soon as all living stacks agree on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: conversation: opening and pairs, or nothing; s, u, a are the initials of the roles
RULES = (
    ("conversation", ()), ("conversation", ("opening", "pairs")), ("opening", ()), ("opening", ("s",)),
    ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")),
)
END = "$"
NAMES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Prices:
    """What each edit costs; a kept or renamed row that breaks off costs ``truncated`` more."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    @property
    def slack(self) -> int:
        """Two inserts complete a pair, and one system turn may have to go."""
        return 2 * self.insert + self.delete


class Automaton:
    """SLR tables of ``RULES`` and stacks as shared nodes ``(state, rest)``."""

    def __init__(self):
        heads = {h for h, _ in RULES}
        empty = {h for h, body in RULES if not body}
        first = {h: set() for h in heads}
        follow = {h: set() for h in heads} | {"conversation": {END}}
        for _ in range(len(RULES) + 1):  # each round carries a symbol at least one rule further
            for head, body in RULES:
                for i, x in enumerate(body):
                    if all(y in empty for y in body[:i]):
                        first[head] |= first[x] if x in heads else {x}
                    if x in heads:
                        nxt = body[i + 1] if i + 1 < len(body) else None
                        follow[x] |= follow[head] if nxt is None else first[nxt] if nxt in heads else {nxt}
        closures: list[frozenset] = []

        def state(items: set) -> int:
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                body = RULES[rule][1]
                if dot < len(body):
                    for r, (head, _) in enumerate(RULES):
                        if head == body[dot] and (r, 0) not in items:
                            items.add((r, 0))
                            todo.append((r, 0))
            key = frozenset(items)
            if key not in closures:
                closures.append(key)
            return closures.index(key)

        state({(r, 0) for r, (head, _) in enumerate(RULES) if head == "conversation"})
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], int] = {}
        at = 0
        while at < len(closures):
            moves: dict[str, set] = {}
            for rule, dot in closures[at]:
                head, body = RULES[rule]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
                else:
                    for x in follow[head]:
                        if self.reduce.setdefault((at, x), rule) != rule:
                            raise ValueError("the grammar is not SLR")
            for x, items in moves.items():
                self.goto[at, x] = state(items)
            at += 1
        if any(k in self.reduce for k in self.goto):
            raise ValueError("the grammar is not SLR")
        self.nodes: dict[tuple, tuple] = {}
        self.start = self.node(0, None)
        self.moves: dict[tuple, tuple | None] = {}

    def node(self, state: int, rest: tuple | None) -> tuple:
        """The one node with this top and rest."""
        key = (state, id(rest))
        if key not in self.nodes:
            self.nodes[key] = (state, rest)
        return self.nodes[key]

    def read(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack after all reductions before ``symbol`` and its shift; None if it cannot come here.

        At the end of input the whole conversation is reduced, and the stack itself comes back.
        """
        key = (id(stack), symbol)
        if key not in self.moves:
            self.moves[key] = self._read(stack, symbol)
        return self.moves[key]

    def _read(self, stack: tuple, symbol: str) -> tuple | None:
        top = stack
        while (rule := self.reduce.get((top[0], symbol))) is not None:
            head, body = RULES[rule]
            for _ in body:
                top = top[1]
            if head == "conversation":
                return stack
            top = self.node(self.goto[top[0], head], top)
        to = self.goto.get((top[0], symbol))
        return None if to is None else self.node(to, top)


class Repairer:
    """Edits of one conversation after the other; ``row`` and ``end`` give back what is settled.

    An edit is ``(letter, role, row)``: the role the turn gets (None where it is deleted), and
    the row (None where it is inserted).

    The living stacks are a tuple of ``(stack, cost above the least, rank of its audit)``. There
    are few such tuples, so what a kind of row does to one is worked out once and kept.
    """

    #: pending rows at which the living stacks are first searched for a common beginning
    STEPS = 32

    def __init__(self, prices: Prices | None = None, automaton: Automaton | None = None):
        self.prices, self.lr = prices or Prices(), automaton or Automaton()
        self.known: dict[tuple, tuple] = {}
        self._begin()

    def _begin(self) -> None:
        self.live, self.pasts, self.cost = ((self.lr.start, 0, 0),), [None], 0
        self.pending, self.look = 0, self.STEPS

    def _inserted(self, live: tuple) -> dict:
        """All stacks that inserts lead to, by least (cost, rank, tail): which stack each came from, and the edits."""
        out = {stack: (cost, rank, "", i, ()) for i, (stack, cost, rank) in enumerate(live)}
        todo = list(out)
        while todo:
            stack = todo.pop()
            cost, rank, tail, origin, edits = out[stack]
            if cost + self.prices.insert > self.prices.slack:
                continue
            for x, role in NAMES.items():
                to = self.lr.read(stack, x)
                if to is not None:
                    new = (cost + self.prices.insert, rank, tail + "I", origin, (*edits, ("I", role)))
                    if to not in out or new[:3] < out[to][:3]:
                        out[to] = new
                        todo.append(to)
        return out

    def _step(self, live: tuple, own: str, must_go: bool, truncated: bool) -> tuple:
        """What a row adds to the least cost, the living stacks after it, and where each came from by which edits."""
        p, read, late = self.prices, self.lr.read, self.prices.truncated if truncated else 0
        found: dict[tuple, tuple] = {}

        def offer(to, cost, rank, tail, origin, edits):
            if to not in found or (cost, rank, tail) < found[to][:3]:
                found[to] = (cost, rank, tail, origin, edits)

        for stack, (cost, rank, tail, origin, edits) in self._inserted(live).items():
            offer(stack, cost + p.delete, rank, tail + "D", origin, (*edits, ("D", None)))
            if must_go:
                continue
            if own and (to := read(stack, own)) is not None:
                offer(to, cost + late, rank, tail + "K", origin, (*edits, ("K", None)))
            for x, name in NAMES.items():
                if (to := read(stack, x)) is not None:
                    offer(to, cost + late + p.rerole, rank, tail + "R", origin, (*edits, ("R", name)))
        least = min(x[0] for x in found.values())
        found = {k: v for k, v in found.items() if v[0] <= least + p.slack}
        ranks = {k: i for i, k in enumerate(sorted({v[1:3] for v in found.values()}))}
        return least, tuple((k, v[0] - least, ranks[v[1:3]]) for k, v in found.items()), tuple(v[3:] for v in found.values())

    def row(self, role: str, row, must_go: bool = False, truncated: bool = False) -> list:
        own = role[:1]
        key = (self.live, own if own in ("s", "u", "a") else "", must_go, truncated)
        if key not in self.known:
            self.known[key] = self._step(*key)
        added, self.live, moves = self.known[key]
        self.cost += added
        pasts = []
        for origin, edits in moves:
            past = self.pasts[origin]
            for letter, name in edits[:-1]:
                past = (past, letter, name, None)
            letter, name = edits[-1]
            pasts.append((past, letter, role if letter == "K" else name, row))
        self.pasts = pasts
        self.pending += 1
        return self._settled() if self.pending >= self.look else []

    def _settled(self) -> list:
        """Edits that all living stacks share; the search is repeated when twice as many wait."""
        chains = []
        for past in self.pasts:
            chain = []
            while past is not None:
                chain.append(past)
                past = past[0]
            chains.append(chain[::-1])
        common = 0
        while all(len(c) > common for c in chains) and all(c[common] is chains[0][common] for c in chains):
            common += 1
        done, kept, self.pasts = [x[1:] for x in chains[0][:common]], {}, []
        for chain in chains:
            past = None
            for x in chain[common:]:  # steps that stacks share stay shared
                past = kept.setdefault(id(x), (past, *x[1:]))
            self.pasts.append(past)
        self.pending = max(map(len, chains)) - common
        self.look = max(self.STEPS, 2 * self.pending)
        return done

    def end(self) -> tuple[list, int]:
        """The last edits and the cost of the whole conversation; the next row begins another."""
        whole = [v for k, v in self._inserted(self.live).items() if self.lr.read(k, END) is not None]
        cost, _, _, origin, edits = min(whole, key=lambda v: v[:3])
        past = self.pasts[origin]
        for letter, name in edits:
            past = (past, letter, name, None)
        cost, self.pasts = self.cost + cost, [past]
        edits = self._settled()
        self._begin()
        return edits, cost


#: one row per edit, in order
SCHEMA = "conv_id long, step long, edit string, role string, text string, turn long, was string, fault string, cost long, last boolean"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
FAULTS = ("", "blank", "duplicate", "truncated")
#: characters, and edits, in one output batch
BATCH_CHARS, BATCH_ROWS = 4_000_000, 4096


def _repair(prices: Prices):
    def run(batches) -> Iterator[pa.RecordBatch]:
        work, rows, size, now, step = Repairer(prices), [], 0, None, 0

        def put(edits, cost=None):
            nonlocal step, size
            for i, (letter, role, row) in enumerate(edits):
                turn, was, text, fault = row or (None, None, "", "")
                last = cost is not None and i == len(edits) - 1
                rows.append((now[0], step, letter, role, text if role is not None else None, turn, was, fault, cost if last else None, last))
                step, size = step + 1, size + len(text)

        def batch():
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
            rows.clear()
            size = 0
            return out

        for b in batches:
            for conv, turn, role, text, fault in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now != (conv,):
                    if now:
                        put(*work.end())
                    now, step = (conv,), 0
                fault = FAULTS[fault]
                put(work.row(role, (turn, role, text, fault), fault in ("blank", "duplicate"), fault == "truncated"))
                if size > BATCH_CHARS or len(rows) > BATCH_ROWS:
                    yield batch()
        if now:
            put(*work.end())
        if rows:
            yield batch()

    return run


def fault() -> Column:
    """The first fault of a row: 1 blank, 2 seen earlier (``_seen`` over 1), 3 broken off, else 0."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 1).when(F.col("_seen") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def repair_chats(turns: DataFrame, prices: Prices | None = None) -> DataFrame:
    """One row per edit of ``conv_id, turn, role, text``: ``step, edit, role, text`` and what the row was.

    ``edit`` is K, R, D or I; ``role`` and ``text`` are those of the repaired turn, null where
    the row is deleted. ``turn, was, fault`` are the row's turn, role and first fault. ``cost`` is
    on a conversation's last edit (``last``). The edits of a conversation stand together and in
    order in one partition.

    Null roles and texts are one space; null turns come first; rows of one turn are ordered by
    role and text; a repeated row is a duplicate. Rows without conv_id are one conversation. No
    rows give no edits. Further columns are left out. A conversation is read by one task as a
    sorted stream, which keeps no texts beyond the edits that are not settled yet; repeats are
    found by a sort of the same partition, not by a table in memory.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    rows = rows.withColumn("_seen", seen).withColumn("fault", fault()).drop("_seen")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == 2)
    return rows.mapInArrow(_repair(prices or Prices()), SCHEMA)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class _Summary:
    """Counts and digests of one conversation, from its edits in order."""

    def __init__(self):
        self.audit, self.hash, self.turns = bytearray(), hashlib.sha256(), 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.distinct, self.first, self.latest, self.before = 0, 0, None, None, None

    def add(self, edit: str, role: str | None, text: str | None, turn: int | None, was: str | None, fault: str) -> None:
        self.audit += edit.encode()
        if role is not None:
            self.hash.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
            self.turns += 1
        if was is not None:
            self.faults[fault] += 1
            if self.before is not None and self.before + was[:1] not in LEGAL:
                self.illegal += 1
            self.before = was[:1]
            if turn is not None:
                self.distinct += turn != self.latest
                self.first, self.latest = turn if self.first is None else self.first, turn

    def row(self, conv: int | None, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.distinct
        return (conv, gaps, *(self.faults[f] for f in FAULTS[1:]), self.illegal, cost, self.audit.decode(), self.hash.hexdigest())


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    kinds = (*(pa.int64(),) * 7, pa.string(), pa.string())
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    now = None
    for b in batches:
        rows = []
        cols = [b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "turn", "was", "fault", "cost", "last")]
        for conv, edit, role, text, turn, was, fault, cost, last in zip(*cols):
            now = now or _Summary()
            now.add(edit, role, text, turn, was, fault)
            if last:
                rows.append(now.row(conv, cost))
                now = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def summaries(edits: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation, read off the edits where they stand.

    ``gaps``: turn numbers between the least and the greatest that no row has. ``illegal``:
    neighbouring rows whose role initials are not su, ua or au. ``repaired_sha256``: of the
    repaired ``role:text``, joined by newlines.
    """
    return edits.mapInArrow(_summaries, SUMMARY)
