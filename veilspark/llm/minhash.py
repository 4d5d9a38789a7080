"""Near-duplicate detection with SuperMinHash signatures, banding, verification and grouping.

A document is the set of its word shingles. SuperMinHash gives each element one
permutation of the ``SLOTS`` slots; in round j the element proposes the value ``j + r`` to the
slot its permutation has at j, and each slot keeps its smallest value. After round j
nothing below j + 1 can come any more, so a document whose slots all hold less is
finished: long documents need a round or two. All elements of many documents go
through a round together.

1. One pass over the texts writes a row for each document: size and fingerprint of its set,
   band keys and one byte of every slot. Texts are read again only to verify.
2. Equal sets are grouped by fingerprint before anything else; one stands for all.
3. Within a band the member with most band companions leads; every other member is
   compared with its leader only, so a large group gives one pair a member.
4. Links are grouped by contraction of stars (smallest ids win) until nothing changes.
5. Members of a band that are still in different groups are compared in blocks, without
   rows for the pairs. Signatures rule out most pairs; the others must also pass an exact
   bound: elements are counted in ``BINS`` bins by their fingerprints, and the smaller
   counts of two sets add up to no less than their intersection. What passes is
   verified, so no link is lost that any band shows, whatever the leaders were.

Every link is confirmed on whole sets. Bands follow from the limit of similarity: as many
slots a band as miss a pair at the limit in all bands with a chance of ``MISSED`` at most. At 0.85
these are 32 bands of 8 (a chance of 4e-5), at 0.80 42 bands of 6 (3e-6).

Defined results: null, empty and blank texts have an empty set and stand alone; a text
of fewer words than a shingle is one shingle; equal rows get equal rows; a null
id is returned with a null group, is kept and links nothing; rows with the same id are taken
to have the same text; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import flat_lists, hot_keys, row_groups, salted_join, store, text_bytes
from veilspark.llm.words import find_words, mix, printables, shingle_prints

SLOTS = 256
#: The largest chance that all bands miss a pair at the limit.
MISSED = 4e-5
#: Bins in which the elements of a set are counted; a full count of 255 says nothing.
BINS = 256
#: Documents of a block in the comparison by signatures.
BLOCK = 128
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def missed(percent: int, bands: int, width: int) -> float:
    """The chance that no band of ``width`` slots shows a pair of that similarity."""
    return (1 - (percent / 100) ** width) ** bands


def banding(percent: int, slots: int = SLOTS) -> tuple[int, int]:
    """Bands and slots of each; below 4 % of similarity even bands of one slot miss more than ``MISSED``."""
    width = max([w for w in range(1, slots + 1) if missed(percent, slots // w, w) <= MISSED], default=1)
    return slots // width, width


def slots_alike(percent: int, slots: int = SLOTS) -> int:
    """The slots in which a pair at the limit agrees, less seven deviations (at 0.85: 217.6 less 7 x 5.7 are 178)."""
    p = percent / 100
    return max(0, round(slots * p - 7 * (slots * p * (1 - p)) ** 0.5))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures ``[n, slots]`` of n sets; ``owner`` tells the set of each distinct element.

    The round is in the upper 32 bits of a value, the random part in the lower.
    """
    signature = np.full(n * slots, _EMPTY, np.uint64)
    seed = mix(elements)
    live = np.arange(len(elements))
    base = owner.astype(np.int64) * slots
    open_sets = np.unique(owner)
    order = None
    for j in range(slots):
        if not len(live):
            break
        drawn = mix(seed[live] + np.uint64((j * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((drawn >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            row = live_row * slots
            place = order[row + pick].astype(np.int64)
            order[row + pick] = order[row + j]
        value = np.uint64(j << 32) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(signature, base[live] + place, value)
        largest = signature.reshape(n, slots)[open_sets].max(axis=1)
        done = largest < np.uint64((j + 1) << 32)
        first_round = order is None
        if done.any():
            gone = np.zeros(n, bool)
            gone[open_sets[done]] = True
            keep = ~gone[owner[live]]
            open_sets, live = open_sets[~done], live[keep]
            pick = pick[keep]
            if not first_round:
                live_row = live_row[keep]
        if first_round:  # only those that go on need an order of their own
            live_row = np.arange(len(live))
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(live), 1)).reshape(-1)
            order[live_row * slots + pick] = 0
    return signature.reshape(n, slots)


def _sets(prints: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    shingles = shingle_prints(prints, width)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            one = np.sort(shingles[a : b - width + 1])
            found.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        else:
            found.append(shingle_prints(prints[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return found


def _signed(sizes: np.ndarray, sets: list[np.ndarray], slots: int, bands: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and slot bytes of many sets; sets of like size go through the rounds together."""
    keys = np.zeros((len(sets), bands), np.uint64)
    sketch = np.zeros((len(sets), slots), np.uint8)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    weights = mix(np.arange(width, dtype=np.uint64)) | np.uint64(1)
    lo = 0
    while lo < len(order):
        ends = np.cumsum(sizes[order[lo : lo + 2048]])
        hi = lo + max(1, int(np.searchsorted(ends, 1 << 16, "right")))
        chosen = order[lo:hi]
        signature = None
        if hi == lo + 1 and sizes[chosen[0]] > 1 << 17:  # a very large set in parts: slots keep the smaller value
            whole = sets[chosen[0]]
            for at in range(0, len(whole), 1 << 16):
                part = whole[at : at + (1 << 16)]
                one = super_minhash(part, np.zeros(len(part), np.int32), 1, slots)
                signature = one if signature is None else np.minimum(signature, one)
        else:
            owner = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes[chosen])
            signature = super_minhash(np.concatenate([sets[i] for i in chosen]), owner, len(chosen), slots)
        mixed = mix(signature)
        keys[chosen] = mix((mixed[:, : bands * width].reshape(len(chosen), bands, width) * weights).sum(axis=2) + mix(np.arange(bands, dtype=np.uint64)))
        sketch[chosen] = (mixed & np.uint64(255)).astype(np.uint8)
        lo = hi
    return keys, sketch


def signatures(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, n_shingles, print, bands, sketch, bins)`` of every row, with the bands for a limit of ``percent``."""
    bands, of_band = banding(percent, slots)
    out = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("print", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
            T.StructField("bins", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = printables()
        for batch in batches:
            data, borders = text_bytes(batch.column(1))
            for lo, hi in row_groups(borders, 8 << 20):
                sets: list[np.ndarray] = []
                for a, b in row_groups(borders[lo : hi + 1]):
                    a, b = a + lo, b + lo
                    words = find_words(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], kind)
                    sets += _sets(words.prints, words.first, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys, sketch = _signed(sizes, sets, slots, bands, of_band)
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                cells = np.repeat(np.arange(len(sets)) * BINS, sizes) + (flat >> np.uint64(56)).astype(np.int64)
                bins = np.minimum(np.bincount(cells, minlength=len(sets) * BINS), 255).astype(np.uint8).reshape(len(sets), BINS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                        flat_lists(keys.reshape(-1).view(np.int64), np.full(len(sets), bands), pa.int64()),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                        pa.array([row.tobytes() for row in bins], pa.binary()),
                    ],
                    names=out.names,
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, out)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough; ``texts`` is ``(doc_id, text)``.

    ``a`` may be a hot key: its pairs are dealt over parts and its text is repeated for them.
    """
    members = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    leaders = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(
        pairs.select("a").distinct(), "a", "left_semi"
    )
    both = salted_join(members, leaders, "a", hot=hot_keys(pairs, "a"), by=["b"])
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = printables()
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                data, borders = text_bytes(column)
                sets: list[np.ndarray] = []
                for lo, hi in row_groups(borders):
                    words = find_words(data[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo], kind)
                    sets += _sets(words.prints, words.first, width)
                sides.append(sets)
            linked = []
            for x, y in zip(*sides):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared) and len(x) > 0)
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=out.names)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, out)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``links (a, b)`` reaches.

    Each round links the larger neighbours of a node, then its smaller ones, to the
    smallest neighbour. In a result every node points to the smallest node of its group and nothing points to
    it, which one sum over the nodes tells; links that are such stars from the start need no round. The smallest node
    itself has no row.
    """

    def are_stars(edges: DataFrame) -> bool:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("out"))
        )
        sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("all"))
        return sums.where("out > 1 OR (out = 1 AND all > 1)").isEmpty()

    def round_of(edges: DataFrame, rows: int) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both, "u", rows=2 * rows)
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        wide = salted_join(both, least, "u", hot=hot).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            salted_join(wide, low, "u", hot=hot)
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(low.select("u", F.col("least").alias("v")))
        )
        return small.where("u <> v").distinct()

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = None
    while not are_stars(edges):
        after = store(round_of(edges, edges.count()), "groups")
        if now is not None:
            now.drop()
        now, edges = after, after.frame
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _block_pairs(crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different groups that signatures and bins do not rule out.

    ``crowded`` is ``(band, n, doc_id, n_shingles, component, sketch, bins)``. The members of a band are
    dealt into blocks, and pairs of blocks are compared inside a task, so no row is made
    for a pair that is ruled out.
    """
    blocks = (
        crowded.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .groupBy("band", "block", "blocks")
        .agg(F.collect_list(F.struct("doc_id", "n_shingles", "component", "sketch", "bins")).alias("members"))
    )
    left = blocks.select(
        "band", F.col("members").alias("left"), "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other")
    )
    right = blocks.select("band", F.col("block").alias("other"), F.col("members").alias("right"))
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    alike = slots_alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column: pa.Array, i: int) -> dict[str, np.ndarray]:
            rows = column[i].values
            found = {c: rows.field(c).to_numpy() for c in ("doc_id", "n_shingles", "component")}
            for c in ("sketch", "bins"):
                found[c] = np.frombuffer(b"".join(rows.field(c).to_pylist()), np.uint8).reshape(len(rows), -1)
            return found

        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = side(batch.column(0), i), side(batch.column(1), i)
                full_x, full_y = (z["bins"].max(axis=1) == 255 for z in (x, y))
                for k in range(len(x["doc_id"])):
                    n, m = x["n_shingles"][k], y["n_shingles"]
                    fits = (x["component"][k] != y["component"]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                    hit = np.flatnonzero(fits)
                    hit = hit[(x["sketch"][k] == y["sketch"][hit]).sum(axis=1) >= alike]
                    most = np.minimum(x["bins"][k], y["bins"][hit]).sum(axis=1, dtype=np.int64)
                    hit = hit[(100 * most >= percent * (n + m[hit] - most)) | full_x[k] | full_y[hit]]
                    a.append(np.minimum(x["doc_id"][k], y["doc_id"][hit]))
                    b.append(np.maximum(x["doc_id"][k], y["doc_id"][hit]))
            flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(flat, names=out.names)

    return left.join(right, ["band", "other"]).select("left", "right").mapInArrow(run, out).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``.

    Documents are linked if the intersection of their sets of ``width``-word shingles is at
    least ``percent`` of the union. ``component_id`` is the smallest id of the linked
    documents, ``kept`` tells whether it is the document's own.
    """
    rows = store(signatures(docs, text, doc_id, width, percent), "signatures").frame
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = store(named.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "sets").frame
    first = sets.select("doc_id", F.col("print").alias("_print"))
    one_each = store(
        named.join(first, "doc_id").where("print = _print").dropDuplicates(["print"])
        .select("doc_id", "n_shingles", "bands", "sketch", "bins"),
        "one-each",
    ).frame

    banded = one_each.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = store(banded.join(shared, "band"), "band-members").frame
    ranked = members.join(members.groupBy("doc_id").agg(F.sum("n").alias("degree")), "doc_id")
    leader = ranked.groupBy("band").agg(
        F.max(F.struct("degree", (-F.col("doc_id")).alias("least"), F.col("n_shingles").alias("n_a"))).alias("top")
    ).select("band", (-F.col("top.least")).alias("a"), "top.n_a")
    fits = F.expr(f"100 * least(n_a, n_shingles) >= {percent} * greatest(n_a, n_shingles)")
    pairs = store(
        members.join(leader, "band").where(fits & (F.col("a") != F.col("doc_id")))
        .select("a", F.col("doc_id").alias("b")).distinct(),
        "pairs",
    ).frame
    texts = store(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")),
        "texts",
    ).frame
    groups = components(store(confirmed(pairs, texts, width, percent), "links").frame)

    def grouped(frame: DataFrame, key: str, of: DataFrame, name: str) -> DataFrame:
        return frame.join(of.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(
            name, F.coalesce(name, key)
        )

    placed = grouped(members, "doc_id", groups, "component")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    crowded = placed.join(mixed.select("band"), "band", "left_semi").join(one_each.select("doc_id", "sketch", "bins"), "doc_id")
    rest = store(_block_pairs(crowded, percent).join(pairs, ["a", "b"], "left_anti"), "rest").frame
    more = store(confirmed(rest, texts, width, percent), "more-links").frame
    of_set = grouped(sets, "doc_id", groups, "component").select("print", "component")
    if not more.isEmpty():  # links between groups: group the groups
        between = grouped(grouped(more, "a", groups, "x"), "b", groups, "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        wider = components(store(between, "between-groups").frame)
        of_set = grouped(of_set, "component", wider, "wider").select("print", F.col("wider").alias("component"))
    often = sets.where(F.col("copies") > F.lit(max(64.0, rows.count() * 0.002)))  # 500 sets at most
    hot = [r[0] for r in often.select("print").collect()]
    joined = salted_join(named.select("doc_id", "n_shingles", "print"), of_set, "print", hot=hot).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id")
    )
    rest_rows = rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return joined.unionByName(rest_rows).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
