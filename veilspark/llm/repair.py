"""Cheapest repair of the turn structure of conversations by generalised LR parsing with weighted edits.

The roles of a sound conversation, by their first letters, are sentences of a small grammar (``GRAMMAR``:
nothing, or an optional system turn and then pairs of user and assistant). Its LR automaton is built from the
rules. The turns of a conversation are read in order with a graph-structured stack: a stack is a link (state, stack below),
stacks share what lies below, and every turn extends all live tops by these actions:

* keep (K, cost 0): shift the turn's role;
* rerole (R, 2): shift ``u`` or ``a`` instead, the role becomes user or assistant;
* delete (D, 3): the stack stays; the only action for blank turns and repeated ones;
* insert (I, 2): shift ``u`` or ``a`` without reading, an empty turn, anywhere.

A truncated turn that is not deleted costs 1 more. Equal stack tops are merged to the one with the smallest (cost,
audit), the audit being the letters of its edits in order. That loses nothing: tops with equal states accept
the same rest here, and audits of equal cost that have read the same turns never begin with one another, so the order
of two of them stays when the same edits follow. For the same reason audits are compared by the rank
of what they extend and the letters that are added, so the cost of a turn does not grow with the conversation.

Each live top carries the running SHA-256 of its repaired turns, so a conversation is read once, as a stream of rows,
whatever its length; what is held for it are links of edits, some bytes a turn.

``damaged`` makes faults on purpose, by a checksum of id and turn.

Defined results: turns are ordered by number (null first), role and text; null role or text is one space; ``duplicate`` is a turn
whose role and text came earlier in its conversation, blank ones included; each turn has its first fault only (blank, duplicate,
truncated); a turn with an empty role has no initial and cannot be kept; gaps between numbers wrap as 64-bit numbers do; rows with a null conv_id are one conversation; a conversation whose
rows are all gone has zeros and an empty audit; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Symbols of one lower-case letter are first letters of roles; the first rule is the goal.
GRAMMAR = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"

Item = tuple[str, str, int]
Stack = tuple[int, "Stack | None"]
START: Stack = (0, None)


# ---- the automaton ----


def lr_automaton(grammar=GRAMMAR) -> tuple[list[dict[str, int]], list[list[tuple[str, int]]]]:
    """For each state its transitions by symbol and its reductions (symbol, length of the rule)."""
    heads = {head for head, _ in grammar}

    def closed(items: set[Item]) -> frozenset[Item]:
        todo, seen = list(items), set(items)
        while todo:
            _, body, at = todo.pop()
            if at < len(body) and body[at] in heads:
                for rule in ((h, b, 0) for h, b in grammar if h == body[at]):
                    if rule not in seen:
                        seen.add(rule)
                        todo.append(rule)
        return frozenset(seen)

    states = [closed({(h, b, 0) for h, b in grammar if h == grammar[0][0]})]
    moves: list[dict[str, int]] = []
    for state in states:  # grows meanwhile
        moves.append({})
        for symbol in sorted({b[at] for _, b, at in state if at < len(b)}):
            goal = closed({(h, b, at + 1) for h, b, at in state if at < len(b) and b[at] == symbol})
            if goal not in states:
                states.append(goal)
            moves[-1][symbol] = states.index(goal)
    reductions = [[(h, len(b)) for h, b, at in sorted(state) if at == len(b)] for state in states]
    return moves, reductions


class Parser:
    """Shifts on linked stacks, with every reduction that a shift makes possible."""

    def __init__(self, grammar=GRAMMAR):
        self.moves, self.reductions = lr_automaton(grammar)
        self.goal = grammar[0][0]
        self.shift = cache(self._shift)
        self.accepts = cache(self._accepts)

    def _reduced(self, stack: Stack) -> set[Stack]:
        """The stack and all that reductions make of it."""
        found, todo = {stack}, [stack]
        while todo:
            top = todo.pop()
            for head, length in self.reductions[top[0]]:
                below = top
                for _ in range(length):
                    below = below[1]
                if head in self.moves[below[0]]:
                    new = (self.moves[below[0]][head], below)
                    if new not in found:
                        found.add(new)
                        todo.append(new)
        return found

    def _shift(self, stack: Stack, symbol: str) -> Stack | None:
        shifted = [(self.moves[s[0]][symbol], s) for s in self._reduced(stack) if symbol in self.moves[s[0]]]
        if len(shifted) > 1:
            raise ValueError("the grammar is ambiguous")
        return shifted[0] if shifted else None

    def _accepts(self, stack: Stack) -> bool:
        def below(top: Stack, length: int) -> Stack | None:
            for _ in range(length):
                top = top[1]
            return top

        ends = ((s, n) for s in self._reduced(stack) for h, n in self.reductions[s[0]] if h == self.goal)
        return any(below(s, n) == START for s, n in ends)


class Repair:
    """The live tops of one conversation: state -> (cost, rank, stack, sha, edits)."""

    def __init__(self, parser: Parser):
        self.parser = parser
        self.tops = {0: (0, 0, START, None, None)}

    def _inserted(self, cost, rank, letters, stack, sha, edits, then) -> None:
        """Call ``then`` for the top itself and for the tops after one and two inserted turns."""
        then(cost, rank, letters, stack, sha, edits)
        if len(letters) < 2:
            for role in ROLES:
                if (pushed := self.parser.shift(stack, role)) is not None:
                    self._inserted(cost + INSERT, rank, letters + "I", pushed, (sha, role), edits, then)

    def read(self, initial: str, text: bytes, role: bytes, must_go: bool, cut_short: bool) -> None:
        """One turn: all actions on all tops, then one top for each state."""
        shift = self.parser.shift
        best: dict[int, tuple] = {}

        def offer(stack, cost, rank, letters, written, edits) -> None:
            old = best.get(stack[0])
            if old is None or (cost, rank, letters) < old[:3]:
                best[stack[0]] = (cost, rank, letters, stack, written, edits)

        def act(cost, rank, letters, stack, sha, edits) -> None:
            offer(stack, cost + DELETE, rank, letters + "D", sha, edits)
            if must_go:
                return
            cost += CUT_SHORT * cut_short
            if (kept := shift(stack, initial)) is not None:
                offer(kept, cost + KEEP, rank, letters + "K", (sha, None), edits)
            for symbol in ROLES:
                if (given := shift(stack, symbol)) is not None:
                    offer(given, cost + REROLE, rank, letters + "R", (sha, symbol + "R"), edits)

        for cost, rank, stack, sha, edits in self.tops.values():
            self._inserted(cost, rank, "", stack, sha, edits, act)
        # beyond two inserts of the cheapest nothing can win
        limit = min(b[0] for b in best.values()) + 2 * INSERT
        live = sorted((b for b in best.values() if b[0] <= limit), key=lambda b: b[1:3])
        ranks = {order: i for i, order in enumerate(sorted({b[1:3] for b in live}))}
        self.tops = {
            stack[0]: (cost, ranks[rank, letters], stack, self._written(written, role, text), (edits, letters))
            for cost, rank, letters, stack, written, edits in live
        }

    @staticmethod
    def _written(chain, role: bytes, text: bytes):
        """The running digest after the turns of ``chain``; the first link is a digest or None."""
        steps = []
        while isinstance(chain, tuple):
            chain, step = chain
            steps.append(step)
        if not steps:
            return chain
        state = None if chain is None else chain.copy()
        for step in reversed(steps):
            if state is None:
                state = hashlib.sha256()
            else:
                state.update(b"\n")
            if step is None:
                state.update(role + b":" + text)
            elif len(step) == 1:
                state.update(ROLES[step].encode() + b":")
            else:
                state.update(ROLES[step[0]].encode() + b":" + text)
        return state

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        ends: list[tuple] = []

        def end(cost, rank, letters, stack, sha, edits) -> None:
            if self.parser.accepts(stack):
                ends.append((cost, rank, letters, sha, edits))

        for cost, rank, stack, sha, edits in self.tops.values():
            self._inserted(cost, rank, "", stack, sha, edits, end)
        cost, _, letters, sha, edits = min(ends, key=lambda e: e[:3])
        state = self._written(sha, b"", b"")
        parts = [letters]
        while edits is not None:
            edits, letters = edits
            parts.append(letters)
        return cost, "".join(reversed(parts)), (state or hashlib.sha256()).hexdigest()


# ---- Spark ----

_RESULT = pa.schema(
    [
        ("conv_id", pa.int64()),
        *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.large_string()),
        ("repaired_sha256", pa.string()),
    ]
)
_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (conv_id, gone, turn, role, text, fault) in, one row a conversation out."""
    parser = Parser()
    out: list[tuple] = []
    conv: object = batches  # differs from every id
    repair, counts, illegal, before = Repair(parser), [0, 0, 0, 0], 0, None
    low = high = None
    distinct = 0

    def finish() -> None:
        gaps = 0 if low is None else high - low + 1 - distinct
        out.append((conv, (gaps + 2**63) % 2**64 - 2**63, *counts[1:], illegal, *repair.result()))

    def table() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_RESULT)

    for batch in batches:
        for c, gone, turn, role, text, fault in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if c != conv:
                if conv is not batches:
                    finish()
                conv, repair, counts, illegal, before, low, high, distinct = c, Repair(parser), [0, 0, 0, 0], 0, None, None, None, 0
            if gone:
                continue
            if turn is not None:
                low = turn if low is None else low
                distinct += turn != high
                high = turn
            counts[fault] += 1
            illegal += before is not None and before + role[:1] not in LEGAL
            before = role[:1]
            repair.read(role[:1], text.encode(), role.encode(), fault in (1, 2), fault == 3)
        if len(out) >= 1024:
            yield table()
    if conv is not batches:
        finish()
    if out:
        yield table()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults made on purpose by crc32(``conv_id:turn``) modulo 20:
    0 the row is gone, 1 its text is empty, 2 its text has no sentence ends, 3 it comes twice, 4 its role is user."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(name) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when((kind == 0) | (kind == 1), F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return changed.drop("_copy")


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, gone): counts of faults, cost, audit and digest.

    ``rows`` is exchanged once, by conv_id; all sorts after it are local and spill.
    """
    here = rows.repartition("conv_id")
    order = F.col("turn").asc_nulls_first()
    print_ = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "_print").orderBy(order))
    # a row marked as gone shares a window with gone rows only
    marked = here.withColumn("_print", print_).withColumn("_seen", seen)
    last = F.right(_bare(F.col("text")), F.lit(1))
    fault = (
        F.when(F.length(_bare(F.col("text"))) == 0, 1)
        .when(F.col("_seen") > 1, 2)
        .when(~last.isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    ordered = marked.withColumn("_fault", fault).sortWithinPartitions("conv_id", "gone", order, "role", "text", "_seen")
    return ordered.select("conv_id", "gone", "turn", "role", "text", "_fault").mapInArrow(_repair_rows, _DDL)
