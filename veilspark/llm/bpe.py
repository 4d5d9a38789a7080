"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Borders of the pieces come from class arrays, not from a regular expression. Every
code point has a class, its neighbours make it a symbol, and each symbol is a
function on the states of a small automaton. Functions compose associatively, so a
scan over compositions gives the state before each character, and state and symbol
say whether a piece begins there. Pieces are merged by rank with a bounded cache.

Defined results: a null text is an empty text and has no ids; rows are encoded
independently, so repeated rows give equal results; an empty table gives an empty
table. Only the named columns are read. A text is worked on in groups of a million
characters, cut where a piece is known to begin, so long texts need no more memory
than their own bytes and ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.shared import row_groups, text_bytes

# Code points that Unicode 16 has as letters and as numbers and that the
# character database of Python may not have yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

# Classes of code points.
LETTER, NUMBER, OTHER, BLANK = range(4)
# Symbols: the first three classes, an apostrophe before a contraction of one or two letters, a space
# or another blank before a character that is no blank, and a blank before a blank or the end.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_BREAK, S_BLANK = range(8)
SYMBOLS = 8
# States: nothing open, runs, a space that the next character joins, and what a contraction still needs.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8


def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
        elif chr(point).isspace() and not 0x1C <= point <= 0x1F:
            table[point] = BLANK
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this character."""
    if symbol == S_LETTER:
        if state in (TWO_MORE, ONE_MORE):
            return (ONE_MORE if state == TWO_MORE else CLOSED), False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}[symbol], True
    if symbol == S_SPACE:
        return JOINING, True
    if symbol == S_BREAK:
        return CLOSED, True
    return IN_BLANKS, state != IN_BLANKS


class Automaton:
    """The functions that symbols generate under composition, numbered, with their tables."""

    def __init__(self) -> None:
        plain = [tuple(step(q, s)[0] for q in range(STATES)) for s in range(SYMBOLS)]
        heads = [(step(CLOSED, s)[0],) * STATES for s in range(SYMBOLS)]  # the first character of a text forgets
        generators = plain + heads
        number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *generators]))}
        todo = list(number)
        while todo:
            f = todo.pop()
            for g in generators:
                both = tuple(g[q] for q in f)
                if both not in number:
                    number[both] = len(number)
                    todo.append(both)
        functions = list(number)
        self.size = len(functions)
        self.of_symbol = np.array([number[f] for f in generators], np.uint16)
        self.then = np.array([number[tuple(g[q] for q in f)] for f in functions for g in functions], np.uint16)
        self.apply = np.array(functions, np.uint8).reshape(-1)
        self.begins = np.array([step(q, s)[1] for q in range(STATES) for s in range(SYMBOLS)], bool)

    def states(self, functions: np.ndarray) -> np.ndarray:
        """The state before each character: an exclusive scan over compositions.

        Blocks are scanned side by side, their totals by doubling strides.
        """
        n, width = len(functions), 128
        blocks = -(-n // width)
        padded = np.zeros(blocks * width, np.uint16)  # number 0 is the identity
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
        before = np.empty_like(columns)
        total = np.zeros(blocks, np.intp)
        for j in range(width):
            before[j] = total
            total = self.then[total * self.size + columns[j]].astype(np.intp)
        stride = 1
        while stride < blocks:
            total[stride:] = self.then[total[:-stride] * self.size + total[stride:]]
            stride *= 2
        start = np.full(blocks, CLOSED, np.intp)
        start[1:] = self.apply[total[:-1] * STATES + CLOSED]
        found = self.apply[before.astype(np.intp) * STATES + start]
        return np.ascontiguousarray(found.T).reshape(-1)[:n]


class Pieces(dict):
    """Ids of a piece as little-endian bytes, at most ``limit`` pieces at a time."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 200_000) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbouring pair of the lowest rank, the leftmost first, until none is left.

    A heap holds the pairs and links the parts, so a piece of n bytes takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, previous = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined with another part
        end[i], after[i], end[j] = stop, after[j], 0
        if after[i] < n:
            previous[after[i]] = i
            wide = end[after[i]]
            if (r := ranks.get(piece[i:wide])) is not None:
                heapq.heappush(heap, (r, i, wide))
        if (h := previous[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Vocabulary:
    """Ranks of byte strings and the tables that encoding and decoding need.

    Its size is that of the rank file and a table of code points.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes = class_table()
        self.automaton = Automaton()
        self.pieces = Pieces(self.ranks)

    def borders(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts of code points, given where the texts begin."""
        n = len(points)
        kind = self.classes[points]
        blank = kind == BLANK
        head = np.zeros(n + 1, bool)
        head[heads] = True
        head[n] = True
        ends = head[1:]  # the last character of a text
        symbol = kind.copy()
        follows = np.empty(n, bool)  # a character that is no blank follows in the same text
        follows[:-1] = ~blank[1:]
        follows[-1:] = False
        follows &= ~ends
        symbol[blank] = np.where(follows[blank], np.where(points[blank] == 32, S_SPACE, S_BREAK), S_BLANK)
        at = np.flatnonzero(points == 39)
        if len(at):
            one = np.where((at + 1 < n) & ~ends[at], points[np.minimum(at + 1, n - 1)], 0)
            two = np.where((at + 2 < n) & (one > 0) & ~ends[np.minimum(at + 1, n - 1)], points[np.minimum(at + 2, n - 1)], 0)
            for tail in CONTRACTIONS:
                if len(tail) == 1:
                    symbol[at[one == ord(tail)]] = S_SHORT
                else:
                    symbol[at[(one == ord(tail[0])) & (two == ord(tail[1]))]] = S_LONG
        function = self.automaton.of_symbol[symbol.astype(np.intp) + SYMBOLS * head[:-1]]
        state = self.automaton.states(function)
        return np.flatnonzero(self.automaton.begins[state.astype(np.intp) * SYMBOLS + symbol] | head[:-1])

    def encode(self, data: bytes, text_borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a group, one text after another, and the number of ids of each text."""
        if not data:
            return np.empty(0, "<u4"), np.zeros(len(text_borders) - 1, np.int64)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            at = np.arange(len(points) + 1)
        else:
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(size)])
        heads = np.searchsorted(at, text_borders[:-1])
        begins = at[self.borders(points, heads[heads < len(points)])]
        bounds = begins.tolist()
        bounds.append(len(data))
        found = list(map(self.pieces.__getitem__, map(data.__getitem__, map(slice, bounds, bounds[1:]))))
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = np.concatenate([[0], np.cumsum(counts)])
        per_text = total[np.searchsorted(begins, text_borders)]
        return np.frombuffer(b"".join(found), "<u4"), np.diff(per_text)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the byte offset at which each id begins."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        offsets = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.start[ids] - offsets, lengths) + np.arange(total)
        return self.bytes[places], offsets


def _cut(data: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts; each next part begins with a blank behind another character, where a piece begins."""
    lo = 0
    while len(data) - lo > limit:
        hi = lo + limit
        while hi < len(data) and not (data[hi] in b" \n\t\r" and data[hi - 1] < 128 and data[hi - 1] > 32):
            hi += 1
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def encoded(vocabulary: Vocabulary, column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of rows: their ids and the number of ids of each row."""
    data, borders = text_bytes(column)
    for first, last in row_groups(borders, limit):
        lo, hi = int(borders[first]), int(borders[last])
        part = data[lo:hi].tobytes()
        if last == first + 1 and len(part) > limit:
            ids = np.concatenate([vocabulary.encode(p, np.array([0, len(p)]))[0] for p in _cut(part, limit)])
            yield ids, np.array([len(ids)])
        else:
            yield vocabulary.encode(part, borders[first : last + 1] - lo)


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    """Read on the driver; it travels to the tasks with their function."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids array<int>, offsets array<int>)``: ids and the byte offset of each in the text.

    The offsets lead from any id back to its bytes; together with the ids they are what decoding needs.
    """
    vocabulary = vocabulary_of(path)
    out = T.StructType(
        [docs.select(doc_id).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for ids, counts in encoded(vocabulary, batch.column(1)):
                rows = batch.column(0).slice(row, len(counts))
                row += len(counts)
                starts = vocabulary.decode(ids)[1]
                ends = np.concatenate([[0], np.cumsum(counts)])
                firsts = np.repeat(starts[np.minimum(ends[:-1], max(len(starts) - 1, 0))] if len(starts) else ends[:-1], counts)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32)))
                    for v in (ids, starts - firsts)
                ]
                yield pa.RecordBatch.from_arrays([rows, *lists], names=[doc_id, "ids", "offsets"])

    return docs.select(doc_id, text).mapInArrow(run, out)


def decode(encoded_docs: DataFrame, path: str, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, bytes)``: the bytes that the column ``ids`` stands for; null ids are no ids."""
    vocabulary = vocabulary_of(path)
    out = T.StructType([encoded_docs.select(doc_id).schema[0], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [vocabulary.decode(np.array(ids or [], np.int64))[0].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=[doc_id, "bytes"])

    return encoded_docs.select(doc_id, "ids").mapInArrow(run, out)


def token_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every text: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    vocabulary = vocabulary_of(path)
    out = T.StructType(
        [
            docs.select(doc_id).schema[0],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for ids, counts in encoded(vocabulary, batch.column(1)):
                rows = batch.column(0).slice(row, len(counts))
                row += len(counts)
                text_bytes_, starts = vocabulary.decode(ids)
                at = np.concatenate([[0], np.cumsum(counts)])
                byte_at = np.append(starts, len(text_bytes_))[at].tolist()
                at = at.tolist()
                digests = [
                    [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                    for values, cuts in ((memoryview(ids.tobytes()), [4 * a for a in at]), (memoryview(text_bytes_.tobytes()), byte_at))
                ]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(counts, pa.int64()), *map(pa.array, digests)],
                    names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(doc_id, text).mapInArrow(run, out)
