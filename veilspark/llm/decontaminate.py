"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A window is ``window`` consecutive words of a benchmark item, or a whole shorter item.
A window that occurs in a document shares all its shingles with it, so it is enough
to join on one of them: the shingles of a window are ordered by how rare they are
in the documents, and the rarest is the necessary prefix. A joined pair must then fit
in position and length, and its words are compared one by one.

1. One pass over the texts keeps the runs of words whose shingles pass a bit table
   of the benchmark's shingles. Its size is fixed, so the table may be broadcast; it
   only spares work. Runs that are shorter than the shortest window cannot hold one.
2. Equal runs are grouped first, so a passage that a third of the documents share
   is counted, joined and verified once.
3. Results of runs go back to the documents by a join that salts hot runs.

Defined results: null or empty texts have no words and no hits; an item without words
is never found; equal items count as several; equal rows of documents give one equal
row each, rows of an item that is given twice are one item with two texts. Other
columns are not read. Neither table has to fit anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import lowered, row_groups, salted_join, store, text_bytes
from veilspark.llm.words import alphanumerics, find_words, lower_bytes, shingle_prints

WINDOW = 10
SHINGLE = 5
FILTER_BITS = 23
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _shingle_texts(words: Column, width: Column) -> Column:
    """The shingles of an array of words, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " ")
    )


def item_windows(items: DataFrame, text: str, item_id: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(item, words, width)``: the distinct windows of each item and the width of their shingles."""
    words = items.select(F.col(item_id).alias("item"), F.regexp_extract_all(lowered(F.col(text)), F.lit(WORD), F.lit(0)).alias("all"))
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1))),
        lambda i: F.slice(F.col("all"), i, F.lit(window)),
    )
    return (
        words.where(F.size("all") > 0)
        .select("item", F.explode(cut).alias("words"))
        .distinct()
        .withColumn("width", F.least(F.size("words"), F.lit(shingle)))
    )


def _bit_table(items: DataFrame, text: str, window: int, shingle: int, bits: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bits of all shingles of the items, and the shortest window for each shingle width.

    The table has ``2 ** bits`` bits whatever the number of items, made up of rows of 4 KB.
    """
    kind = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("bit", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = text_bytes(batch.column(0))
            words = find_words(data, borders, alphanumerics())
            widths, sizes, places = [], [], []
            for a, b in zip(words.first[:-1], words.first[1:]):
                if b > a:
                    width = min(int(b - a), shingle)
                    prints = np.unique(shingle_prints(words.prints[a:b], width) >> np.uint64(64 - bits))
                    widths += [width] * len(prints)
                    sizes += [min(int(b - a), window)] * len(prints)
                    places.append(prints.astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(widths, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(places) if places else [], pa.int64())],
                names=["width", "words", "bit"],
            )

    rows = items.select(text).mapInArrow(run, kind)
    parts = rows.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"),
        F.collect_set(F.struct("width", "words")).alias("sizes"),
    )
    table = np.zeros(1 << (bits - 3), np.uint8)
    shortest: dict[int, int] = {}
    for row in parts.toLocalIterator():
        at = (row.part - 1) * 4096
        table[at : at + 4096] = np.frombuffer(row.bits, np.uint8)[: len(table) - at]
        for size in row.sizes:
            shortest[size.width] = min(size.words, shortest.get(size.width, size.words))
    return table, shortest


def _runs(docs: DataFrame, text: str, doc_id: str, table: np.ndarray, shortest: dict[int, int], bits: int) -> DataFrame:
    """``(doc_id, n_words, runs array<string>)``: lower-cased runs of words that may hold a window."""
    out = T.StructType(
        [
            docs.select(doc_id).schema[0],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.StringType())),
        ]
    )
    least = min(shortest.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, kind = lower_bytes(), alphanumerics()
        for batch in batches:
            data, borders = text_bytes(batch.column(1))
            for lo, hi in row_groups(borders):
                part = data[borders[lo] : borders[hi]]
                words = find_words(part, borders[lo : hi + 1] - borders[lo], kind)
                counts = np.diff(words.first)
                owner = np.repeat(np.arange(hi - lo), counts)
                held = np.zeros(len(owner) + 1, np.int32)  # runs as differences: +1 where a shingle begins, -1 behind its end
                for width in shortest:
                    places = shingle_prints(words.prints, width) >> np.uint64(64 - bits)
                    at = np.flatnonzero(table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1)
                    at = at[owner[at] == owner[at + width - 1]]
                    np.add.at(held, at, 1)
                    np.add.at(held, at + width, -1)
                inside = np.cumsum(held[:-1]) > 0
                heads = inside.copy()
                heads[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
                tails = inside.copy()
                tails[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
                a, b = np.flatnonzero(heads), np.flatnonzero(tails)
                long = b - a + 1 >= least
                found: list[list[str]] = [[] for _ in range(hi - lo)]
                for i, j in zip(a[long].tolist(), b[long].tolist()):
                    spans = zip(words.starts[i : j + 1].tolist(), words.ends[i : j + 1].tolist())
                    found[owner[i]].append(b" ".join(lower[part[s:e]].tobytes() for s, e in spans).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                    names=[doc_id, "n_words", "runs"],
                )

    return docs.select(doc_id, text).mapInArrow(run, out)


def run_hits(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(run_id, n_hit, items)`` of the distinct runs ``(run_id, words, n)`` that hold a window."""
    widths = [r.width for r in windows.select("width").distinct().collect()]  # five values at most
    shingles = None
    for width in widths:
        one = runs.where(F.size("words") >= width).select(
            "run_id", "n", F.posexplode(_shingle_texts(F.col("words"), F.lit(width))).alias("at", "shingle")
        )
        shingles = one if shingles is None else shingles.unionByName(one)
    counts = shingles.groupBy("shingle").agg(F.sum("n").alias("n"))
    own = windows.select("item", "words", F.posexplode(_shingle_texts(F.col("words"), F.col("width"))).alias("offset", "shingle"))
    # A shingle that no document holds rules its window out, and it would be the rarest one.
    ordered = own.join(counts, "shingle", "left").groupBy("item", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    )
    prefix = ordered.where("rarest.n > 0").select(
        "item", F.col("words").alias("window"), F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")
    )
    candidates = (
        shingles.select("run_id", "at", "shingle")
        .join(prefix, "shingle")
        .withColumn("from", F.col("at") - F.col("offset"))
        .where("from >= 0")
    )
    held = candidates.join(runs.select("run_id", "words"), "run_id").where(
        (F.col("from") + F.size("window") <= F.size("words"))
        & (F.slice("words", F.col("from") + 1, F.size("window")) == F.col("window"))
    )
    covered = held.select("run_id", "item", F.explode(F.sequence(F.col("from"), F.col("from") + F.size("window") - 1)).alias("place"))
    return covered.groupBy("run_id").agg(
        F.size(F.collect_set("place")).cast("long").alias("n_hit"), F.collect_set("item").alias("items")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` of every row of ``docs``.

    ``n_hit`` counts the words that lie in an occurrence of a window, ``items`` are the
    ids of the items with such windows. ``filter_bits`` sets the size of the bit table:
    more bits pass fewer runs in vain, the result is the same.
    """
    kind = T.ArrayType(items.schema[item_id].dataType)
    table, shortest = _bit_table(items, item_text, window, shingle, filter_bits)
    found = store(
        _runs(docs, text, doc_id, table, shortest, filter_bits).withColumn("row", F.monotonically_increasing_id()), "runs"
    ).frame
    if not shortest:  # no item has a word
        return found.select(doc_id, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(kind).alias("items"))
    windows = store(item_windows(items, item_text, item_id, window, shingle), "windows").frame
    held = store(
        found.where(F.size("runs") > 0)
        .select("row", F.posexplode("runs").alias("_", "run"))
        .select("row", F.sha2("run", 256).alias("run_id"), "run"),
        "row-runs",
    ).frame
    distinct = store(
        held.groupBy("run_id").agg(F.first("run").alias("run"), F.count("*").alias("n"))
        .select("run_id", F.split("run", " ", -1).alias("words"), "n"),
        "distinct-runs",
    ).frame
    hits = store(run_hits(distinct, windows), "run-hits").frame
    rows = salted_join(held.select("row", "run_id"), hits, "run_id").groupBy("row").agg(
        F.sum("n_hit").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return found.select("row", doc_id, "n_words").join(rows, "row", "left").select(
        doc_id,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(kind)).alias("items"),
    )


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The counts and digests of ``contamination``."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        doc_id,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
