"""Packing of tokenised documents into sequences of a fixed capacity by linear grouping and best fit.

1. One pass tokenises the documents (a public tokenizer, then an end id), cuts only those longer than the
   capacity, and numbers the pieces of each length within its task.
2. The lengths are counted; there are at most ``capacity`` different ones, so the counts, and a plan made from them, are
   of bounded size whatever the table. Offsets of the tasks turn the numbers within a task into numbers among all
   pieces of a length.
3. The plan, on the counts alone. Large lengths are sorted into groups of equal cardinality and rounded up to the largest of their
   group. For the few sizes that are left, the configurations of a sequence are optimised by column generation (the linear
   program of cutting stock; its patterns are found by a knapsack). Whole multiples of them are used; each place of
   a configuration then gets actual pieces of its group, and what those leave free is known exactly. Small pieces, and
   the few large ones that are left over, go longest first into the fullest sequence that holds them, new
   sequences where none does. The border between large and small is tried at several parts of the capacity; the plan with
   the fewest sequences is kept.
4. A plan is a list of runs: pieces ``first`` to ``last`` of a length go to sequences from ``sequence`` on, ``per`` in
   each, from ``offset`` on. Every piece finds its run by one binary search; nothing is exchanged for it.

Words between ASCII white space are tokenised on their own and remembered, which gives the ids of the whole text: the tokenizer drops
white space, puts no token across it, and its normalisation works on one side of it. A text with ``<|``, which may be a special
token, goes through the tokenizer whole.

Defined results: null text is empty and is the end id alone; every row is a document of its own, also repeated ones and those
without an id; other columns are not read; an empty table has no pieces.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.shared import flat_lists, row_groups, store, text_bytes

CAPACITY = 2048
GROUPS = 64
#: Borders between small and large that are tried, as parts of the capacity.
BORDERS = (2, 3, 4, 8)
#: Entries of the table of word parts that a worker process keeps.
REMEMBERED = 400_000
#: Characters that normalisation leaves alone but for lower case.
PLAIN = r"^[\x21-\x7E\x{A1}-\x{24F}]*$"
_TEXT_BYTES = 1 << 24


# ---- ids of texts ----


def _kept_by_worker(name: str, make):
    """A value that a worker process keeps between its tasks; losing it costs time only."""
    module = sys.modules.setdefault("_veilspark_worker", types.ModuleType("_veilspark_worker"))
    if name not in module.__dict__:
        module.__dict__[name] = make()
    return module.__dict__[name]


class WordTokenizer:
    """Ids of texts by a tokenizer file, by way of their words."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = lambda part: alphabet.pre_tokenize_str(part)[0][0]
        # fixed: the parts of a word that the tokenizer's file names
        self.parts_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # ids as bytes; the younger half of the table becomes the older one when it is full
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.young.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                tokens = self.model.tokenize(part if part.isascii() else self.as_bytes(part))
                ids = array("i", [t.id for t in tokens]).tobytes()
            if len(part) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[part] = ids
        return ids

    def word(self, word: str, plain: bool) -> bytes:
        """Ids of a word; ``plain`` words have no character that normalisation changes but for lower case."""
        if word in self.young:
            return self.young[word]
        if not plain:
            return array("i", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        if word.isalpha():
            return self._part(word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, self.parts_of(word)))

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column without nulls."""
        out: list[np.ndarray | None] = [None] * len(column)
        special = np.asarray(pc.match_substring(column, "<|"))
        for i in np.flatnonzero(special):
            out[i] = np.array(self.whole.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
        if special.any():
            column = pc.if_else(pa.array(special), "", column)
        words = pc.ascii_split_whitespace(pc.ascii_lower(column))
        known = words.flatten().dictionary_encode()
        plain = pc.match_substring_regex(known.dictionary, PLAIN).to_pylist()
        ids = list(map(self.word, known.dictionary.to_numpy(zero_copy_only=False).tolist(), plain))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        places = np.asarray(known.indices)
        counts = sizes[places]
        ends = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[places]
        values = flat[np.arange(len(flat) and int(ends[-1])) + np.repeat(starts - (ends - counts), counts)]
        borders = np.concatenate([[0], ends])[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [values[a:b] if own is None else own for own, a, b in zip(out, borders[:-1], borders[1:], strict=True)]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, names: list[str]):
    """The task function: documents in, pieces out; ``nth`` counts the pieces of a length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _kept_by_worker(f"tokenizer {path}", lambda: WordTokenizer(path))
        part = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(names.index("text")).fill_null("")
            for first, last in row_groups(text_bytes(texts)[1], _TEXT_BYTES):
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                for row, own in enumerate(tokenizer.texts(texts.slice(first, last - first)), first):
                    own = np.append(own, np.int32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        rows.append(row)
                        number.append(k)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        ids.append(piece)
                length = np.array(length, np.int64)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + used[ordered]
                used += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length)]
                columns += [pa.array(crc, pa.int64()), pa.array(np.full(len(length), part, np.int32)), pa.array(nth)]
                columns += [flat_lists([i.astype(np.int32) for i in ids], length, pa.int32())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=_PIECE + ["ids"] * with_ids)

    return run


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = True) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32, part, nth and, if wanted, ids."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * ids
    return chosen.mapInArrow(_pieces(path, capacity, end_id, ids, ["doc_id", "text"]), ddl)


# ---- the plan ----


@dataclass
class Plan:
    """Runs (length, first, last, sequence, per, offset) and the number of sequences."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def equal_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, cut into groups of equal cardinality; a length may be in two groups."""
    total = sum(n for _, n in large)
    groups = min(groups, total)
    borders = [-(-total * (j + 1) // groups) for j in range(groups)]
    out: list[list[tuple[int, int]]] = [[] for _ in borders]
    taken = now = 0
    for length, n in large:
        while n:
            now += taken == borders[now]
            m = min(n, borders[now] - taken)
            out[now].append((length, m))
            taken, n = taken + m, n - m
    return out


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the sizes of the most valuable multiset that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        grown, item = best.copy(), np.full(capacity + 1, -1)
        for j, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if value > 0:
                tried = best[: capacity + 1 - size] + value
                better = tried > grown[size:] + 1e-12
                grown[size:][better], item[size:][better] = tried[better], j
        if (item < 0).all():
            break
        layers.append(item)
        best = grown
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for item in reversed(layers):
        if item[room] >= 0:
            counts[item[room]] += 1
            room -= int(sizes[item[room]])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use them: the linear program of cutting stock by column generation."""
    basis = np.diag(capacity // sizes).astype(float)
    use = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = best_pattern(sizes, worth, capacity).astype(float)
        if pattern @ worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, pattern)
        ratios = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        use = np.maximum(use - step * change, 0)
        use[out] = step
        basis[:, out] = pattern
    return [(basis[:, j].astype(np.int64), float(use[j])) for j in range(len(sizes))]


class _Gaps:
    """Runs of consecutive sequences by what they have free."""

    def __init__(self, capacity: int):
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 2, bool)

    def add(self, gap: int, first: int, last: int) -> None:
        if last > first:
            self.runs[gap].append((first, last))
            self.some[gap] = True

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run with the smallest gap that is ``least`` or more."""
        gap = least + int(self.some[least:].argmax())
        if not self.some[gap]:
            return None
        first, last = self.runs[gap].pop()
        self.some[gap] = bool(self.runs[gap])
        return gap, first, last


def _plan(counts: dict[int, int], capacity: int, border: int, groups: int) -> Plan:
    plan, gaps, next_of = Plan(), _Gaps(capacity), dict.fromkeys(counts, 0)
    left = dict(counts)

    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if length > border]
    grouped = equal_groups(large, groups)
    if grouped:
        sizes = np.array([g[0][0] for g in grouped])
        demand = np.array([sum(n for _, n in g) for g in grouped])
        for pattern, use in configurations(sizes, demand.astype(float), capacity):
            times = int(use + 1e-9)
            if not times:
                continue
            # actual pieces of the group for each place, as runs over the uses of the pattern
            places = []
            for g in np.repeat(np.arange(len(sizes)), pattern).tolist():
                wanted, place = times, []
                while wanted and grouped[g]:
                    length, n = grouped[g][-1]
                    m = min(wanted, n)
                    place.append((length, m))
                    wanted -= m
                    grouped[g][-1:] = [(length, n - m)] * (n > m)
                places.append(place)
            ends = [np.cumsum([m for _, m in place]).tolist() for place in places]
            at = 0
            for end in sorted({e for own in ends for e in own} | {times}):
                offset = 0
                for place, own in zip(places, ends, strict=True):
                    i = bisect_left(own, at + 1)
                    if i < len(own):  # a group may run out in the last uses
                        length = place[i][0]
                        first = next_of[length]
                        plan.runs.append((length, first, first + end - at, plan.sequences + at, 1, offset))
                        next_of[length] += end - at
                        left[length] -= end - at
                        offset += length
                gaps.add(capacity - offset, plan.sequences + at, plan.sequences + end)
                at = end
            plan.sequences += times

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            found = gaps.take(length)
            if found is None:
                needed = -(-n // (capacity // length))
                found = (capacity, plan.sequences, plan.sequences + needed)
                plan.sequences += needed
            gap, first, last = found
            per = gap // length
            full = min(last - first, n // per)
            start, offset = next_of[length], capacity - gap
            if full:
                plan.runs.append((length, start, start + full * per, first, per, offset))
                gaps.add(gap - per * length, first, first + full)
            rest = min(n - full * per, per) if first + full < last else 0
            if rest:
                plan.runs.append((length, start + full * per, start + full * per + rest, first + full, per, offset))
                gaps.add(gap - rest * length, first + full, first + full + 1)
            gaps.add(gap, first + full + bool(rest), last)
            next_of[length] += full * per + rest
            n -= full * per + rest
    return plan


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan with the fewest sequences over the borders between small and large."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = None
    for part in BORDERS:
        plan = _plan(counts, capacity, capacity // part, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


# ---- Spark ----


def _placed(plan: Plan):
    """The task function: adds sequence_id and offset to pieces with their number among all of their length."""
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    by_length = {int(length): runs[runs[:, 0] == length] for length in np.unique(runs[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.unique(length):
                at, known = np.flatnonzero(length == own), by_length[int(own)]
                found = known[np.searchsorted(known[:, 1], number[at], "right") - 1]
                past = number[at] - found[:, 1]
                sequence[at] = found[:, 3] + past // found[:, 4]
                offset[at] = found[:, 5] + past % found[:, 4] * own
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "number"]
            columns = [*kept, ("sequence_id", pa.array(sequence)), ("offset", pa.array(offset))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS, ids: bool = True
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, the ids if wanted, sequence_id, offset."""
    pieces = store(token_pieces(docs, path, capacity, end_id, ids), "pieces").frame
    counts = store(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts").frame
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = packing_plan(totals, capacity, groups) if totals else Plan()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("nth") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    ddl = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return numbered.select(*names, "number").mapInArrow(_placed(plan), ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the spans (offset, length, doc_id, piece) of their documents."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # capacity ids at most
    spans = F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"]))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), spans.alias("spans"))
