import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import toxicity

SF = "/root/testdata/sf0.1"


def brute(index, terms, counts, k):
    dense = np.zeros((len(index.ids), len(index.idf)))
    blocks = index.largest.shape[1]
    for t in range(len(index.idf)):
        a, b = index.starts[t, 0], index.starts[t, blocks]
        dense[index.example[a:b], t] = index.weight[a:b]
    q = np.zeros(len(index.idf))
    q[terms] = index.weights(terms, counts)
    cosine = dense @ q
    order = np.lexsort((np.arange(len(cosine)), -cosine))[:k]
    return order[cosine[order] > 0], cosine[order][cosine[order] > 0]


def test_neighbours_are_the_exact_ones():
    r = np.random.default_rng(4)
    rows = []
    for _ in range(900):
        t = np.sort(r.choice(60, r.integers(1, 12), replace=False))
        rows.append((t, r.integers(1, 5, len(t)).astype(float)))
    index = toxicity.build_index(1 + r.random(60) * 4, np.arange(900), (r.random(900) < 0.2).astype(float), rows)
    for t, c in rows[:60]:
        near, cosine = index.nearest(t, c, 24)
        want, best = brute(index, t, c, 24)
        assert np.allclose(cosine, best) and len(near) == len(want)
        assert set(near[cosine > cosine[-1] + 1e-9]) == set(want[best > best[-1] + 1e-9])


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, vectors = toxicity.fit(docs, labels)
    return model, docs, toxicity.scores(vectors, model).join(labels.select("doc_id", "toxic"), "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    rows = scored[2]
    held = rows[rows.held_out & rows.toxic.notna()]
    rank, toxic = held.score.rank(), held.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.94
    hits = (held.predicted == 1) & toxic
    assert hits.sum() / (held.predicted == 1).sum() > 0.8 and hits.sum() / toxic.sum() > 0.85
    assert rows.score.between(0, 1).all() and len(rows) == 10000


def test_labels_of_the_held_out_rows_do_not_count(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.scores(*reversed(toxicity.fit(docs, x))).collect()) for x in (labels, turned))
    assert one == two


def test_rejected_rows_are_the_predicted_ones(spark, scored):
    model, docs, rows = scored
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).select("doc_id").collect()}
    assert kept == set(rows.doc_id[rows.predicted == 0])


def test_edge_cases(spark):
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(30))
    rows = [(i, plain() + (" vile nasty" if i % 4 == 0 else ""), "x") for i in range(400)]
    rows += [(None, None, "x"), (None, "vile", "x"), (1000, "", "x"), (1001, "vile " * 50000, "x"), (7, rows[7][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(400)] + [(3, None, None), (None, 1, None), (8, 1, 5)], "doc_id long, toxic int, text int")
    model, vectors = toxicity.fit(docs, labels)
    got = toxicity.scores(vectors, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.held_out is not None for x in got)
    assert {x.predicted for x in got if x.doc_id in (0, 4, 1001)} == {1} and {x.predicted for x in got if x.doc_id in (1, 1000)} == {0}
    none, empty = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))
    assert {x.predicted for x in toxicity.scores(empty, none).collect()} == {0}
    bare, nothing = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scores(nothing, bare).count() == 0 and toxicity.without_toxic(docs.limit(0), bare).count() == 0


def test_terms_are_counted_in_the_tasks(spark):
    rows = [([1, 2, 2**62], 1), ([2], 0), ([], 1), ([-5, 2], None), ([1], 1)] * 50
    vectors = spark.createDataFrame(rows, "terms array<long>, toxic int").repartition(7)
    assert {tuple(r) for r in toxicity.term_counts(vectors, "toxic").collect()} == {(1, 100, 100), (2, 150, 50), (2**62, 50, 50), (-5, 50, 0)}
    assert {tuple(r) for r in toxicity.term_counts(vectors).collect()} == {(1, 100, 0), (2, 150, 0), (2**62, 50, 0), (-5, 50, 0)}
    assert toxicity.term_counts(vectors.limit(0)).count() == 0
