"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Labelled examples are a sample of at most ``EXAMPLES`` rows of the training fold, by the hash of
their ids. The space has the terms that go together with the label in the sample
(chi-square, at most ``TERMS``); their document frequencies are counted over all documents.

The index is inverted and block-max: examples lie in blocks of ``BLOCK``, each term has its
postings by block and the largest weight in each block. For a document the sums of
weight times block maximum bound the cosine in every block; blocks are evaluated from the
largest bound down and the search ends when the next bound is below the k-th
cosine, so the neighbours are the exact ones.

Neighbours vote with the square of their cosine, smoothed by the share of toxic examples. A monotone
calibration of the votes is fitted on the examples, each without itself. The evidence of a
score are its nearest examples.

Defined results: texts without any term of the space (also null and empty ones) have no neighbours
and score the smoothed toxic share of such examples; labels that are null or contradict
each other in repeated rows count as the larger one; without any toxic example every score is
the smoothed share of toxic examples; equal rows get equal rows, rows without an id
are scored as held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import flat_lists, hash_sample, row_groups, store, text_bytes
from veilspark.llm.words import find_words, letters

EXAMPLES = 16_000
TERMS = 2048
NEIGHBOURS = 24
BLOCK = 64
#: Chi-square of one degree of freedom at 1e-6, for very many words are tested.
CHI_SQUARE = 23.9
#: Votes that a task remembers; short vectors repeat often.
REMEMBERED = 50_000
BINS = 64


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _counts(column: pa.Array, terms: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of rows ``(first, last, row of each entry, term, count)``; terms as positions in ``terms`` or as they are."""
    data, borders = text_bytes(column)
    kind = letters()
    flags = None
    if terms is not None:
        flags = np.zeros(1 << 16, bool)
        flags[terms >> np.uint64(48)] = True
    for lo, hi in row_groups(borders):
        words = find_words(data[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo], kind)
        row = np.repeat(np.arange(hi - lo), np.diff(words.first))
        prints = words.prints
        if terms is not None:
            near = np.flatnonzero(flags[prints >> np.uint64(48)])
            at = np.searchsorted(terms, prints[near])
            at = np.minimum(at, max(len(terms) - 1, 0))
            same = terms[at] == prints[near] if len(terms) else np.zeros(len(near), bool)
            row, prints = row[near[same]], at[same].astype(np.uint64)
        order = np.lexsort((prints, row))
        row, prints = row[order], prints[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
        first = np.flatnonzero(new)
        yield lo, hi, row[first], prints[first], np.diff(np.append(first, len(row)))


def _vector_lists(lo: int, hi: int, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    lengths = np.bincount(row, minlength=hi - lo)
    return [flat_lists(term.astype(np.int64), lengths, pa.int64()), flat_lists(count.astype(np.int32), lengths, pa.int32())]


def term_vectors(docs: DataFrame, text: str, keys: list[str], terms: np.ndarray | None = None) -> DataFrame:
    """``(keys, terms, counts)``: the distinct words of each text, or those of ``terms`` as positions."""
    out = T.StructType(
        [
            *[docs.schema[k] for k in keys],
            T.StructField("terms", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, term, count in _counts(batch.column(len(keys)), terms):
                rows = [batch.column(i).slice(lo, hi - lo) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*rows, *_vector_lists(lo, hi, row, term.view(np.int64), count)], names=out.names)

    return docs.select(*keys, text).mapInArrow(run, out)


def term_counts(vectors: DataFrame, toxic: str | None = None) -> DataFrame:
    """``(term, n, a)``: rows that hold a term and, of these, the sum of the column ``toxic``.

    Each task counts what it reads and gives a row for each term, so a common term is not exchanged once a text.
    """
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("term", "n", "a")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, n, a = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy()
            marked = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
            found, back = np.unique(np.concatenate([term, flat]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, np.ones(len(flat), np.int64)]), len(found)).astype(np.int64)
            a = np.bincount(back, np.concatenate([a, marked]), len(found)).astype(np.int64)
            term = found
        if len(term):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term, n, a)], names=out.names)

    marks = F.col(toxic).cast("long") if toxic else F.lit(0).cast("long")
    counted = vectors.select("terms", F.coalesce(marks, F.lit(0)).alias("_a")).mapInArrow(run, out)
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


@dataclass
class Index:
    """Unit vectors of the examples as postings by block, with the largest weight of each block."""

    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    starts: np.ndarray = field(default=None)  # [terms, blocks + 1] into the postings
    example: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    largest: np.ndarray = field(default=None)  # [terms, blocks]

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosines above zero, ties to the earlier one, and the cosines."""
        q = self.weights(terms, counts)
        bound = q @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best, cosine, at, size = np.empty(0, np.int64), np.empty(0), 0, 8
        while at < len(order):
            if len(best) >= k and bound[order[at]] * (1 + 1e-9) < cosine[-1]:
                break
            blocks = order[at : at + size]
            at, size = at + size, size * 2
            a = self.starts[terms[:, None], blocks].reshape(-1)
            n = self.starts[terms[:, None], blocks + 1].reshape(-1) - a
            place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            part = np.repeat(np.repeat(q, len(blocks)), n) * self.weight[place]
            found, back = np.unique(self.example[place], return_inverse=True)
            sums = np.bincount(back, weights=part, minlength=len(found))
            if without is not None:
                keep = found != without
                found, sums = found[keep], sums[keep]
            best, cosine = np.concatenate([best, found]), np.concatenate([cosine, sums])
            top = np.lexsort((best, -cosine))[:k]
            best, cosine = best[top], cosine[top]
        return best, cosine


def build_index(idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Index:
    """Examples with like labels and like strongest terms share blocks, which keeps the bounds tight."""
    index = Index(idf, ids, toxic)
    vectors = [index.weights(t, c) for t, c in rows]
    lead = np.array([t[np.argmax(w)] for (t, _), w in zip(rows, vectors)], np.int64)
    order = np.lexsort((ids, lead, toxic))
    index.ids, index.toxic = ids[order], toxic[order]
    blocks = -(-len(order) // BLOCK)
    example = np.concatenate([np.full(len(vectors[i]), at) for at, i in enumerate(order)]) if len(order) else np.empty(0, np.int64)
    term = np.concatenate([rows[i][0] for i in order]) if len(order) else np.empty(0, np.int64)
    weight = np.concatenate([vectors[i] for i in order]) if len(order) else np.empty(0)
    by = np.lexsort((example, term))
    index.example, index.weight = example[by], weight[by]
    cell = term[by] * blocks + index.example // BLOCK if blocks else term[by]
    edges = np.searchsorted(cell, np.arange(len(idf) * blocks + 1))
    index.starts = np.column_stack([edges[:-1].reshape(len(idf), blocks), edges[1:].reshape(len(idf), blocks)[:, -1:]]) if blocks else np.zeros((len(idf), 1), np.int64)
    index.largest = np.zeros((len(idf), blocks))
    if blocks:
        np.maximum.at(index.largest.reshape(-1), cell, index.weight)
    return index


@dataclass
class Model:
    terms: np.ndarray  # sorted fingerprints
    index: Index
    prior: float  # smoothed toxic share of the examples
    bare: float  # and of those without any term
    edges: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # of votes
    shares: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # calibrated

    def vote(self, terms: np.ndarray, counts: np.ndarray, without: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The smoothed vote, or a negative number without neighbours, and the neighbours."""
        if not len(terms) or not len(self.index.ids):
            return -1.0, np.empty(0, np.int64), np.empty(0)
        near, cosine = self.index.nearest(terms, counts, NEIGHBOURS, without)
        w = cosine**2
        return (float((w * self.index.toxic[near]).sum()) + 0.25 * self.prior) / (float(w.sum()) + 0.25), near, cosine

    def score(self, vote: float) -> float:
        return self.bare if vote < 0 else float(np.interp(vote, self.edges, self.shares))


def _monotone(votes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbouring bins until the shares rise; a point of each pool, in between is interpolated."""
    pools: list[list[float]] = []  # weighted vote, count, toxic
    for v, n, t in zip(votes, counts, toxic):
        pools.append([v * n, n, t])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.05) / (p[1] + 0.1) for p in pools])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[Model, DataFrame]:
    """The model and ``(doc_id, terms, counts)`` of all documents in its space.

    What the driver sees is bounded by ``EXAMPLES`` and ``TERMS``.
    """
    usable = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = usable.groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    sample = store(hash_sample(known, known.count(), EXAMPLES, [doc_id]), "labelled").frame
    labelled = docs.select(doc_id, text).join(F.broadcast(sample), doc_id)
    n_toxic = F.sum("_toxic").alias("n1")
    words = store(term_vectors(labelled.select(doc_id, "_toxic", text), text, [doc_id, "_toxic"]), "labelled-words").frame
    n, n1 = words.agg(F.count("*"), F.coalesce(n_toxic, F.lit(0))).first()
    per_term = term_counts(words, "_toxic")
    # The usual 2 x 2 table: a toxic with the term, b others with it, c and d without.
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n - n1)) - b
    chi = F.try_divide(F.lit(float(n)) * F.pow(a * d - b * c, 2), (a + b) * (c + d) * (a + c) * (b + d))
    chosen = per_term.where("n >= 3").withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE).orderBy(F.col("chi").desc(), "term").limit(TERMS)
    terms = np.sort(np.array([r.term for r in chosen.collect()], np.int64).view(np.uint64))
    vectors = store(term_vectors(docs, text, [doc_id], terms), "vectors").frame

    total = vectors.count()
    frequency = np.zeros(len(terms))
    for r in term_counts(vectors).collect():  # at most TERMS rows
        frequency[r.term] = r.n
    idf = np.log((total + 1) / (frequency + 1)) + 1
    rows = vectors.join(F.broadcast(sample), doc_id).select(F.col(doc_id).cast("long").alias("id"), "_toxic", "terms", "counts").orderBy("id").toArrow()
    toxic = rows.column("_toxic").to_numpy().astype(np.float64)
    full = pc.list_value_length(rows.column("terms")).to_numpy() > 0
    prior = float((toxic.sum() + 0.1) / (len(toxic) + 1))
    bare = float((toxic[~full].sum() + prior) / ((~full).sum() + 1))
    held = [v for batch in rows.combine_chunks().to_batches() for v in _lists(batch, 2)]
    index = build_index(idf, rows.column("id").to_numpy()[full], toxic[full], [v for v, keep in zip(held, full) if keep])
    model = Model(terms, index, prior, bare)
    return _calibrated(model, vectors.join(F.broadcast(sample), doc_id), doc_id), vectors


def _calibrated(model: Model, examples: DataFrame, doc_id: str) -> Model:
    """The model with a calibration from the votes on its own examples, each without itself."""
    place = {int(v): i for i, v in enumerate(model.index.ids)}
    out = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("vote", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [model.vote(*v, without=place.get(i))[0] for i, v in zip(batch.column(0).to_pylist(), _lists(batch, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], names=out.names)

    spread = examples.select(doc_id, "_toxic", "terms", "counts").where(F.size("terms") > 0).repartition(16)
    votes = spread.mapInArrow(run, out).where("vote >= 0")
    bins = votes.groupBy(F.least(F.floor(F.col("vote") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.avg("vote").alias("vote"), F.count("*").alias("n"), F.sum("toxic").alias("toxic")
    )
    rows = sorted(bins.collect(), key=lambda r: r.bin)
    if rows:
        model.edges, model.shares = _monotone(*(np.array([float(r[c]) for r in rows]) for c in ("vote", "n", "toxic")))
    return model


def _lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each row."""
    terms, counts = batch.column(column), batch.column(column + 1)
    borders = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(int).tolist()
    t, c = terms.flatten().to_numpy(), counts.flatten().to_numpy()
    for a, b in zip(borders, borders[1:]):
        yield t[a:b], c[a:b]


def scores(vectors: DataFrame, model: Model, doc_id: str = "doc_id", evidence: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence array<struct<doc_id, toxic, cosine>>)`` of every row."""
    near_kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.BooleanType()), T.StructField("cosine", T.DoubleType())])
    out = T.StructType(
        [vectors.schema[doc_id], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(near_kind))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index
        known: dict[tuple[bytes, bytes], tuple[float, list[dict]]] = {}
        for batch in batches:
            found, shown = [], []
            for terms, counts in _lists(batch, 1):
                key = terms.tobytes(), counts.tobytes()
                if key not in known:
                    vote, near, cosine = model.vote(terms, counts)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = model.score(vote), [
                        {"doc_id": int(index.ids[i]), "toxic": bool(index.toxic[i]), "cosine": float(c)}
                        for i, c in zip(near[:evidence], cosine[:evidence])
                    ]
                found.append(known[key][0])
                shown.append(known[key][1])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.bool_()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(shown, kind)], names=out.names)

    return vectors.select(doc_id, "terms", "counts").mapInArrow(run, out).select(
        doc_id,
        held_out(F.col(doc_id)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "evidence",
    )


def without_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns; texts are neither joined nor shuffled."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], bool] = {}

        def stays(terms: np.ndarray, counts: np.ndarray) -> bool:
            key = terms.tobytes(), counts.tobytes()
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = model.score(model.vote(terms, counts)[0]) < limit
            return known[key]

        for batch in batches:
            for lo, hi, row, term, count in _counts(batch.column(at), model.terms):
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                term = term.astype(np.int64)
                keep = [stays(term[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield batch.slice(lo, hi - lo).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
