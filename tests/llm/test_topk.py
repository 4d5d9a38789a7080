import math
import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import topk


def brute(rows, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q, versions in whole.items():
        if q % 100:
            continue
        for a in {tuple(v) for v in versions}:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, many in whole.items() if i != q for b in many)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_best_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(1100, None), (1200, [0.1] * 7 + [float("nan")]), (1300, [0.1] * 7 + [None]), (1400, [float("inf")] * 8), (None, [1.0] * 8), (1500, []), (1600, [2.0, 1.0]), (5, rows[5][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int")
    monkeypatch.setattr(topk, "VECTORS_PER_BLOCK", 300)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    few = df.where("vec_id in (100, 3)")
    assert {r.vec_id for r in topk.top_k(few, F.col("vec_id") % 100 == 0).collect()} == {3}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 1100"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [2.0**10, 2.0**20])
def test_scores_above_2_53_are_exact(spark, size):
    r = random.Random(3)
    near = [[r.uniform(-size, size) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + r.choice([0, 1 / 1024, -1 / 1024]) for c in r.choice(near)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(100, [2.0**40]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(df, F.col("vec_id") % 100 == 0)


def test_bounds_spare_evaluations():
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.normal(0, 300, (20, 16))
    x = np.rint(centres[r.integers(0, 20, 2000)] + r.normal(0, 10, (2000, 16))).astype(np.int64)
    radius = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
    chosen, added = topk.choose_pivots(x[:500].astype(float), radius)
    evaluated = topk.best_of_block(np.arange(2000), x, np.arange(20), x[:20], chosen, added, radius, 10)[3]
    assert evaluated < 20 * 2000 / 4
