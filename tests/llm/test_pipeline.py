import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.llm import secret_scan
from veilspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        seen[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    sizes = {n: (a.count(), b.count()) for n, (a, b) in seen.items()}
    assert all(b < a for n, (a, b) in sizes.items() if n in ("toxicity", "near-dedup", "decontamination"))
    assert all(a == b for n, (a, b) in sizes.items() if n in ("secrets", "tokens"))
    text = seen["secrets"][1]
    assert text.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    assert text.where(F.col("n_chars") != F.length("text")).count() == 0
    assert text.where(F.contains("text", F.lit(secret_scan.MASK))).count() > 0


def test_empty_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.limit(40).unionByName(docs.limit(40)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    nulls = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 100000)
    rows = rows.unionByName(nulls)
    nulls = nulls.collect()
    two = spark.createDataFrame([(200000, "first text of five words and more"), (200000, "quite another text of seven words")], "doc_id long, text string")
    rows = rows.unionByName(two.selectExpr("doc_id", "text", "'xx' AS lang", "'own' AS source", "CAST(length(text) AS BIGINT) AS n_chars"))
    for name, table in (("odd", rows.withColumn("score", F.lit("extra"))), ("empty", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(tmp_path / name / f"{other}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(i for i in named if i >= 100000) == [*sorted(r.doc_id for r in nulls), 200000, 200000] and ids.count(None) == 3
    assert len(set(named)) == len(named) - 1
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)
