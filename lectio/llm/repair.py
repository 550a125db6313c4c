"""Operator 12: conversations repaired by the cheapest edits, by dynamic programming shared along a trie.

A conversation's signature has a letter a row: its role (system, user, assistant, other), whether the row is truncated,
or that it must go. The signatures, in order, are walked as the depth-first order of their prefix trie: a task keeps the
layers of the path to where it is, one for each letter, so that a prefix is computed once for all signatures that begin
with it, and a signature's answer is read off where it ends. Signatures are dealt in ranges of (signature, conversation),
so that one which very many conversations share has no task to itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.common import record, small_batches, written

#: Costs of a rerole, a deletion and an insertion, and what a truncated row costs that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials and names of roles. A repaired conversation has the initials (s?(ua)+)?.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: By the last row's initial, or none yet: the initials that may follow.
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}
#: Letter of a row that must go, and of one whose role has no place; truncated rows have capitals.
GONE, OTHER = "d", "x"

FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
PLANNED = "cost long, audit string"

#: A layer: for each last initial that can be reached the least cost, less that of the cheapest, and the order of its edits.
Layer = tuple[tuple[str, int, int], ...]
START: Layer = (("", 0, 0),)


@functools.cache
def _inserted(last: str) -> tuple[tuple[str, str], ...]:
    """(edits, last initial then) of no insertion, one and more, as long as they lead somewhere new."""
    out, at = [("", last)], last
    while (at := FOLLOW[at][-1]) not in [x for _, x in out]:
        out.append((out[-1][0] + "I", at))
    return tuple(out)


@functools.cache
def step(layer: Layer, letter: str) -> tuple[int, Layer, dict[str, tuple[str, str]]]:
    """(cost of the cheapest more, next layer, last initial -> (the one before, edits)) after a row of this letter.

    Edits that reach different initials after the same rows differ, none begins with another, as each ends with a row's
    own edit: so their ASCII order is that of the edits before, and among these that of the new ones.
    """
    more = TRUNCATED if letter.isupper() else 0
    role, best = letter.lower(), {}
    for last, cost, order in layer:
        for edits, at in _inserted(last):
            paid = cost + INSERT * len(edits)
            ways = [(DELETE, "D", at)]
            if letter != GONE:
                ways.append((REROLE + more, "R", FOLLOW[at][-1]))
                if role in FOLLOW[at]:
                    ways.append((more, "K", role))
            for price, edit, then in ways:
                way = (paid + price, order, edits + edit, last)
                if then not in best or way < best[then]:
                    best[then] = way
    least = min(w[0] for w in best.values())
    places = {w: i for i, w in enumerate(sorted((w[1], w[2]) for w in best.values()))}
    return least, tuple((q, w[0] - least, places[w[1], w[2]]) for q, w in sorted(best.items())), {q: (w[3], w[2]) for q, w in best.items()}


@functools.cache
def ending(layer: Layer) -> tuple[int, str, str]:
    """(cost more, last initial before, edits) of the cheapest way to end after this layer."""
    ways = [(cost + INSERT * len(edits), order, edits, last) for last, cost, order in layer for edits, at in _inserted(last) if at in ("", "a")]
    cost, _, edits, last = min(ways)
    return cost, last, edits


class Trie:
    """Costs and edits of signatures that come in order; a prefix that follows itself is computed once."""

    def __init__(self):
        self.path, self.layers, self.costs, self.backs, self.answer = "", [START], [0], [], (0, "")

    def solve(self, signature: str) -> tuple[int, str]:
        if signature == self.path and signature:
            return self.answer
        n, most = 0, min(len(self.path), len(signature))
        while n < most and self.path[n] == signature[n]:
            n += 1
        del self.layers[n + 1 :], self.costs[n + 1 :], self.backs[n:]
        for letter in signature[n:]:
            more, layer, back = step(self.layers[-1], letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + more)
            self.backs.append(back)
        more, at, edits = ending(self.layers[-1])
        out = [edits]
        for back in reversed(self.backs):
            at, edits = back[at]
            out.append(edits)
        self.path, self.answer = signature, (self.costs[-1] + more, "".join(reversed(out)))
        return self.answer


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key): key tells whether role and text are the same, and orders rows of one turn and role."""
    role, text = _plain("role"), _plain("text")
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, again, initial, fault) of every row, without its text."""
    blank, ends = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    again = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(F.col("turn").asc_nulls_first())) > 1
    marked = _ordered(rows).select("conv_id", "turn", "role", "key", blank.alias("blank"), ends.alias("ends")).withColumn("again", again)
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(~F.col("ends"), "t").otherwise("-")
    return marked.select("conv_id", "turn", "role", "key", "again", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def signatures(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every conversation of rows, and of conversations (conv_id) besides.

    A task reads its conversations' rows in order, as a stream; it holds a letter a row of one conversation.
    """
    letters = _letters(rows).select("conv_id", F.lit(True).alias("row"), "turn", "role", "key", "again", "initial", "fault")
    if conversations is not None:
        more = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        letters = letters.unionByName(more.withColumn("row", F.lit(False)), allowMissingColumns=True)
    dealt = letters.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "key", "again").select("conv_id", "row", "turn", "initial", "fault")
    schema = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((x.split()[0], pa.int64()) for x in FAULTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, done = None, []
        for b in batches:
            for conv_id, row, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if one is None or conv_id != one.conv_id:
                    if one is not None:
                        done.append(one.result())
                    one = _Faults(conv_id)
                if row:
                    one.add(turn, initial, fault)
            if len(done) >= 1000:
                yield record(schema, *zip(*done, strict=True))
                done = []
        if one is not None:
            done.append(one.result())
            yield record(schema, *zip(*done, strict=True))

    return dealt.mapInArrow(run, f"conv_id long, signature string, {FAULTS}")


class _Faults:
    """A conversation's signature and counts, row by row in order of turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.letters, self.initial = conv_id, [], None
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.counts = {"b": 0, "d": 0, "t": 0}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None and (self.initial + "." + initial) not in ("s.u", "u.a", "a.u"):
            self.illegal += 1
        self.initial = initial
        if fault in self.counts:
            self.counts[fault] += 1
        role = initial if initial in ROLES else OTHER
        self.letters.append(GONE if fault in ("b", "d") else role.upper() if fault == "t" else role)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, "".join(self.letters), gaps, *self.counts.values(), self.illegal)


def plans(signed: DataFrame) -> DataFrame:
    """(conv_id, faults, cost, audit) from signatures(): the cheapest edits' initials, the ASCII-least of equally cheap ones."""
    names = signed.columns[2:]
    dealt = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            solved = [trie.solve(s) for s in b.column(1).to_pylist()]
            yield record(schema, b.column(0), *b.columns[2:], [c for c, _ in solved], [a for _, a in solved])

    return dealt.mapInArrow(run, f"conv_id long, {FAULTS}, {PLANNED}")


class _Repair:
    """A conversation's repaired rows, one after the other: the audit says what becomes of the next row and what comes before it."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.place, self.hash = audit, 0, "", 0, hashlib.sha256()

    def _row(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.place - 1, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.last = self.at + 1, FOLLOW[self.last][-1]
            yield self._row(ROLES[self.last], "")

    def take(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.last = role[0]
            yield self._row(role, text)
        elif edit == "R":
            self.last = FOLLOW[self.last][-1]
            yield self._row(ROLES[self.last], text)


def _walked(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans (row false) and rows of each conversation, in order, in one task: conv_id, row, role, text, and planned's columns."""
    small_batches(rows.sparkSession)
    both = _ordered(rows).withColumn("row", F.lit(True)).unionByName(planned.withColumn("row", F.lit(False)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "key")
    return dealt.select("conv_id", "row", "role", "text", *planned.columns[1:])


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows (conv_id, place, role, text) of every repaired conversation, by the audits of plans(); places from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, one = None, None
        for b in batches:
            done = []
            for i, row, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "row", "role", "text", "audit")), strict=True):
                if row:
                    done += [(i, *x) for x in one.take(role, text)]
                else:
                    done += [(conv_id, *x) for x in one.inserted()] if one else []
                    conv_id, one = i, _Repair(audit)
            if done:
                yield record(schema, *zip(*done, strict=True))
        if one and (done := [(conv_id, *x) for x in one.inserted()]):
            yield record(schema, *zip(*done, strict=True))

    return _walked(rows, planned).mapInArrow(run, "conv_id long, place long, role string, text string")


def digested(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with repaired_sha256 of each conversation: of `role:text` of its repaired rows, joined by line ends.

    The hash takes the rows one after the other, so that a conversation's rows are one task's; it holds a batch of them.
    """
    names = planned.columns
    schema = pa.schema([*((n, pa.string() if n == "audit" else pa.int64()) for n in names), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, one, done = None, None, []
        for b in batches:
            columns = [b.column(n).to_pylist() for n in names]
            for i, (row, role, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row", "role", "text")), strict=True)):
                if row:
                    for _ in one.take(role, text):
                        pass
                    continue
                if one:
                    done.append(_finished(plan, one))
                plan = [c[i] for c in columns]
                one = _Repair(plan[names.index("audit")])
            if done:
                yield record(schema, *zip(*done, strict=True))
                done = []
        if one:
            yield record(schema, *zip(_finished(plan, one), strict=True))

    return _walked(rows, planned).mapInArrow(run, f"conv_id long, {FAULTS}, {PLANNED}, repaired_sha256 string")


def _finished(plan: list, one: _Repair) -> list:
    for _ in one.inserted():
        pass
    return [*plan, one.hash.hexdigest()]


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows (conv_id, turn, role, text).

    A conversation's rows go by turn, nulls first, those of one turn by role and the hash of role and text. Null roles and
    texts are one space. Of a row's faults the first counts: blank (nothing but ASCII white space), duplicate (role and text
    of a row before it), truncated (its last other character isn't one of .!?). gaps: turns missing between the first and
    the last, null turns aside; illegal: neighbours whose roles' initials aren't su, ua or au. Edits: Keep, Rerole to user
    or assistant, Delete (the only one for blank and duplicate rows), Insert a row of empty text. Rows of a null conv_id
    are one conversation, repeated rows are duplicates, other columns, whatever their names, are left behind. conversations
    (conv_id): more that are to be in the result, without rows where rows has none: zeros, an empty audit, the hash of
    nothing. An empty table gives no rows.
    """
    signed = written(signatures(rows, conversations))
    return digested(rows, written(plans(signed)))
