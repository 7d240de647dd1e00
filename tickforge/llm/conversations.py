"""Repair of conversation structure by a Viterbi search with coalescing survivors.

A well formed conversation has the role initials ``(s?(ua)+)?``. Every row is kept,
given another role or deleted, empty rows may be put in between, and the cheapest
edits win; among equals the one whose string of edit initials is least.

Rows of a conversation stream past four states (nothing yet, after system, after
user, after assistant). The survivors of the states are leaves of a tree of edits
with back pointers and reference counts: a path that loses is cut off at once, and
as soon as all survivors share an ancestor the edits up to it are final and are
emitted. So a task holds the undecided end of one conversation, whatever its
length. Paths of equal cost are compared over their whole undecided ends. States
that can no longer win or tie are dropped: deleting everything, once being after
an assistant is cheaper by more than a deleted system row; waiting after a system
row, once being after an assistant is cheaper.

Paths of one cost into one state are never prefixes of each other (the longer one
would have paid for its insertions), so the lesser stays the lesser whatever comes
after it, and one survivor per state is enough.

A conversation is one task's because its digest is; it is not held there.

Defined results
* null role or text: one space. Null turns come first; rows of one turn are taken
  by role and text. A null id is a conversation of its own.
* empty texts are blank; repeated rows are duplicates; only their first stays.
* a conversation without rows has no edits, one row of nulls in ``repair``.
* very long texts are held while undecided and by one row at a time after.
* empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs, ends of a sentence, white space.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ENDS = ".!?"
SPACE = " \t\n\x0b\f\r"
LEGAL = {"su", "ua", "au"}
NONE, SYSTEM, USER, ASSISTANT = range(4)
_MOVES = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}


class _Node:
    """An edit of a path; ``refs`` counts the edits and survivors that follow it."""

    __slots__ = ("parent", "edit", "role", "row", "refs")

    def __init__(self, parent, edit, role=None, row=None):
        self.parent, self.edit, self.role, self.row, self.refs = parent, edit, role, row, 0
        if parent is not None:
            parent.refs += 1


class Repair:
    """Push the rows (role, text, fault, ...) of one conversation in order; each push
    returns the edits that have become final: (edit, new role, row or None)."""

    def __init__(self):
        self.root = _Node(None, "")
        self.root.refs = 1
        self.best: dict[int, tuple[int, _Node]] = {}
        self._become(self._insertions({NONE: (0, self.root)}))

    def push(self, row: tuple) -> list[tuple]:
        role, _, fault = row[:3]
        must_go, extra = fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")
        moves = _MOVES.get(role[:1], {})
        new: dict[int, tuple[int, _Node]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + DELETE, node, "D", role, row)
            if must_go:
                continue
            if state in moves:
                self._offer(new, moves[state], cost + extra, node, "K", role, row)
            to = ASSISTANT if state == USER else USER
            self._offer(new, to, cost + REROLE + extra, node, "R", _NAMES[to], row)
        self._become(self._insertions(new))
        return self._settled()

    def finish(self) -> list[tuple]:
        """The remaining edits of the cheapest well formed end."""
        ends = {}
        for state in (NONE, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                if not ends or (cost, self._path(node)) < (ends[0][0], self._path(ends[0][1])):
                    ends = {0: (cost, node)}
        return [(n.edit, n.role, n.row) for n in self._nodes(ends[0][1])]

    def held(self) -> int:
        """Distinct edits in memory."""
        seen = {id(n) for _, leaf in self.best.values() for n in self._nodes(leaf)}
        return len(seen)

    def _nodes(self, node: _Node) -> list[_Node]:
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def _path(self, node: _Node) -> str:
        return "".join(n.edit for n in self._nodes(node))

    def _offer(self, to: dict, state: int, cost: int, parent: _Node, edit: str, role: str, row) -> None:
        if state in to:
            held, node = to[state]
            if cost > held or cost == held and self._path(parent) + edit > self._path(node):
                return
        node = _Node(parent, edit, role, row)
        node.refs = 1
        if state in to:
            self._release(to[state][1])
        to[state] = (cost, node)

    def _insertions(self, to: dict) -> dict:
        """Inserted rows lead on to a user, then to an assistant; more never pays."""
        for state in (NONE, SYSTEM, ASSISTANT):
            if state in to:
                self._offer(to, USER, to[state][0] + INSERT, to[state][1], "I", "user", None)
        if USER in to:
            self._offer(to, ASSISTANT, to[USER][0] + INSERT, to[USER][1], "I", "assistant", None)
        return to

    def _become(self, new: dict) -> None:
        if ASSISTANT in new:
            least = new[ASSISTANT][0]
            for state, beyond in ((NONE, least + DELETE), (SYSTEM, least)):
                if state in new and new[state][0] > beyond:
                    self._release(new.pop(state)[1])
        for _, node in self.best.values():
            self._release(node)
        self.best = new

    def _release(self, node: _Node) -> None:
        """One follower less; an edit that nothing follows goes, and so on up."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node = node.parent
            node.refs -= 1

    def _settled(self) -> list[tuple]:
        """Edits up to the last ancestor of all survivors."""
        if self.root.refs != 1 or len(self.best) == 0:
            return []
        out = []
        for node in self._nodes(next(iter(self.best.values()))[1]):
            if self.root.refs != 1:
                break
            out.append((node.edit, node.role, node.row))
            node.parent, self.root = None, node
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) with one row in five harmed by its check
    number; a dropped row stays as a mark (``present`` false) of its conversation."""
    none = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), none),
                               F.coalesce(F.col("turn").cast("string"), none)).cast("binary")) % 20
    text = F.coalesce("text", none)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of (conv_id, turn, role, text, present) plus ``fault``: blank, duplicate,
    truncated or null. Partitioned by conversation."""
    bare = F.btrim("text", F.lit(SPACE))
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), "present").repartition("conv_id")
    return dealt.select("*", F.when(bare == "", "blank").when(F.row_number().over(seen) > 1, "duplicate")
                        .when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated").alias("fault"))


_EDIT = ["conv_id", "seq", "edit", "role", "text", "turn", "was_role", "fault"]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of all batches; a null id (None or NaN) is None, a null turn too."""
    for batch in batches:
        yield from (tuple(None if v is None or v != v else v for v in r) for r in batch.itertuples(index=False, name=None))


def _batched(rows: Iterator[tuple], names: list[str], size: int = 5000) -> Iterator[pd.DataFrame]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield pd.DataFrame(out, columns=names, dtype=object)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order, one row each: conv_id, seq, edit
    (K, R, D or I), role and text after it (of a deleted row: as it was), the row's
    turn, was_role and fault. The rows whose edit is not D are the repaired
    conversation. ``rows``: conv_id, turn, role, text, present."""
    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            search, seq = Repair(), 0
            for final in _finals(search, group):
                for edit, role, row in final:
                    _, text, fault, turn = row or (None, "", None, None)
                    yield conv, seq, edit, role, text, turn, row and row[0], fault
                    seq += 1
            if not seq:
                yield conv, 0, None, None, None, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batched(edits(_stream(batches)), _EDIT)

    # of equal rows, the one that is no duplicate comes first
    ready = faults(rows).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text",
                                              F.col("fault").eqNullSafe("duplicate"))
    kind = dict(rows.dtypes)["conv_id"]
    return ready.select("conv_id", "turn", "role", "text", "present", "fault").mapInPandas(
        run, f"conv_id {kind}, seq long, edit string, role string, text string, turn long, was_role string, fault string")


def _finals(search: Repair, group: Iterator[tuple]) -> Iterator[list[tuple]]:
    for _, turn, role, text, present, fault in group:
        if present:
            yield search.push((role, text, fault, turn))
    yield search.finish()


_DIGEST = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair``, straight from it (their
    order counts): faults, cost, edit initials, SHA-256 of the repaired text."""
    def summary(conv, group: Iterator[tuple]) -> tuple:
        count, audit, sha = {"blank": 0, "duplicate": 0, "truncated": 0}, [], hashlib.sha256()
        cost = illegal = turns = said = 0
        first = last = before = None
        for _, _, edit, role, text, turn, was_role, fault in group:
            if edit is None:
                continue
            audit.append(edit)
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit != "D":
                sha.update(f"{chr(10) if said else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                said += 1
                cost += TRUNCATED * (fault == "truncated")
            if edit == "I":
                continue
            if fault:
                count[fault] += 1
            illegal += before is not None and before[:1] + was_role[:1] not in LEGAL
            before = was_role
            if turn is not None:
                turns += turn != last
                first, last = turn if first is None else first, turn
        gaps = 0 if first is None else last - first + 1 - turns
        return conv, gaps, *count.values(), illegal, cost, "".join(audit), sha.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batched((summary(c, g) for c, g in groupby(_stream(batches), key=lambda r: r[0])), _DIGEST)

    kind = dict(edits.dtypes)["conv_id"]
    return edits.mapInPandas(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, "
                                  "illegal long, cost long, audit string, repaired_sha256 string")
