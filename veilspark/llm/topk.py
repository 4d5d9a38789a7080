"""Exact top-k search by inner product with pivot-table elimination.

Inner products become distances: with M the largest norm of all vectors, a vector x
gets one more component sqrt(M^2 - |x|^2), a query q gets 0, and then
|q - x|^2 = |q|^2 + M^2 - 2 qx. So the largest products are the smallest distances. For
each pivot p the triangle inequality gives |q - x| >= | |q - p| - |x - p| |; the largest of
these over all pivots is the lower bound of a distance, hence an upper bound of a score.
Candidates are evaluated in the order of their bounds, in integers, and a query stops
when the next bound is below its k-th score: no later candidate can get in, not even by a tie.

Pivots are chosen farthest first from a sample of ``SAMPLE`` vectors; they only decide how
much is evaluated. Queries meet all vectors in pairs of blocks of bounded size, so
neither side has to fit anywhere as a whole.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; shorter vectors end in zeros; a vector without components scores 0; equal
rows are candidates each, equal query rows are one query; no row with a query's own id is its
candidate; an empty table gives an empty table. Scores are exact 64-bit integers; vectors so long that a score
might not fit (the largest square norm is 2^63 or more) are an error. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import hash_sample, store

PIVOTS = 48
SAMPLE = 2048
#: Vectors and queries of a pair of blocks.
VECTORS_PER_BLOCK = 2048
QUERIES_PER_BLOCK = 1024


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as a long; null if a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix of 64-bit integers; short lists end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def choose_pivots(vectors: np.ndarray, radius: float, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, each farthest from those before, and their added components."""
    added = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(axis=1), 0))
    points = np.column_stack([vectors, added])
    chosen = [int(np.argmin(added))]
    nearest = np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if nearest.max() <= 0:
            break
        chosen.append(int(np.argmax(nearest)))
    return vectors[chosen], added[chosen]


def best_of_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, added: np.ndarray, radius: float, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query the k best vectors of a block: ``(query index, vector index, score)``, and how many were evaluated."""
    x, q = vectors.astype(np.float64), queries.astype(np.float64)
    own = np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))
    table = np.sqrt(np.maximum(2 * radius**2 - 2 * (x @ pivots.T + np.outer(own, added)), 0)).T
    norms = (q**2).sum(axis=1)
    far = np.sqrt(np.maximum(norms[:, None] + radius**2 - 2 * q @ pivots.T, 0))
    slack = 1e-6 * (radius**2 + norms) + 1.0  # far above the rounding of the distances
    largest = max(float(np.abs(x).max(initial=0)), 1.0) * max(float(np.abs(q).max(initial=0)), 1.0) * x.shape[1]
    exact = x if largest < 2.0**52 else vectors  # sums of whole numbers below 2^53 are exact as doubles
    asked = q if largest < 2.0**52 else queries
    out_q, out_v, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        lower = np.abs(table[0] - far[i, 0]) if len(table) else np.zeros(len(x))
        for p in range(1, len(table)):
            np.maximum(lower, np.abs(table[p] - far[i, p]), out=lower)
        upper = (norms[i] + radius**2 - lower**2) / 2 + slack[i]
        upper[ids == query_ids[i]] = -np.inf
        order = np.argsort(-upper, kind="stable")
        order = order[: len(order) - int(np.isinf(upper).sum())]
        best, scores, at, size = np.empty(0, np.int64), np.empty(0, exact.dtype), 0, 64
        while at < len(order):
            if len(best) >= k and upper[order[at]] < scores[-1]:
                break
            chunk = order[at : at + size]
            at, size = at + size, size * 2
            evaluated += len(chunk)
            best = np.concatenate([best, chunk])
            scores = np.concatenate([scores, exact[chunk] @ asked[i]])
            top = np.lexsort((ids[best], -scores))[:k]
            best, scores = best[top], scores[top]
        out_q.append(np.full(len(best), i))
        out_v.append(best)
        out_s.append(scores.astype(np.int64))
    flat = [np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_q, out_v, out_s)]
    return flat[0], flat[1], flat[2], evaluated


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 1024,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors with the largest inner product with each query."""
    whole = vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(embedding), scale).alias("v"), is_query.alias("asks")
    )
    rows = store(whole.where("v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors").frame
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "vec_id", "score")])
    if not n:
        empty = vectors.sparkSession.createDataFrame([], kind)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    if largest >= 2.0**63:  # no product is larger than the largest square
        raise ValueError("scores of these vectors do not fit in 64 bits")
    radius, width = float(np.sqrt(largest)), max(width, 1)
    sample = hash_sample(rows, n, SAMPLE, ["id", "row"]).select("v").toArrow()  # a bounded sample
    chosen, added = choose_pivots(matrix(sample.column(0), width).astype(np.float64), radius, pivots)

    blocks = -(-n // VECTORS_PER_BLOCK)
    queries = rows.where("asks").groupBy("id", "v").agg(F.min("row").alias("row"))
    query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    dealt = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))
    candidates = rows.select("row", "id", "v", F.lit(False).alias("asks"), dealt(blocks).alias("block"), every(query_blocks).alias("query_block"))
    asked = queries.select("row", "id", "v", F.lit(True).alias("asks"), every(blocks).alias("block"), dealt(query_blocks).alias("query_block"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        ask, own = table.filter(asks), table.filter(pc.invert(asks))
        ids, query_ids = (t.column("id").to_numpy() for t in (own, ask))
        q, v, score, _ = best_of_block(
            ids, matrix(own.column("v"), width), query_ids, matrix(ask.column("v"), width), chosen, added, radius, k
        )
        names = ["query", "query_id", "vec_id", "score"]
        return pa.table([ask.column("row").to_numpy()[q], query_ids[q], ids[v], score], names=names)

    found = candidates.unionByName(asked).groupBy("block", "query_block").applyInArrow(run, kind)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
