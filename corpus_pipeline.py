"""The corpus pipeline: documents in, encoded documents out, in five stages.

Each stage works on all its predecessor kept, takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; ``run`` writes it as Parquet into the shared folder and rereads it for the next one. All stages but
the last return the columns of documents.

1. toxicity: rows whose score from labelled neighbours is 0.5 or more go.
2. near-dedup: one document of each group of near-duplicates stays, the one with the smallest id; of equal
   rows one stays; different texts with the same id stay together if one of them is kept; texts without words and
   rows without an id all stay.
3. decontamination: documents that hold a window of the benchmark go.
4. secrets: found secrets are replaced in the texts, ``n_chars`` follows.
5. tokens: the ids of the texts, with counts and digests.

Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from veilspark.llm.shared import store

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT)
    model, _ = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT)
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id")
    ids = store(found.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "kept-ids").frame
    repeated = ids.where("n > 1").select("doc_id")
    named = docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*DOCUMENT)
    if not repeated.isEmpty():  # only rows that share an id can be equal
        several = named.join(repeated, "doc_id", "left_semi").select(*DOCUMENT).dropDuplicates()
        named = named.join(repeated, "doc_id", "left_anti").select(*DOCUMENT).unionByName(several)
    return named.unionByName(docs.where("doc_id IS NULL"))


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = found.where("n_hit > 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*DOCUMENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT)
    text = secret_scan.masked(F.col("text"), secret_scan.train(docs))
    changed = docs.withColumn("_text", text)
    return changed.select(
        "doc_id",
        F.col("_text").alias("text"),
        "lang",
        "source",
        F.when(F.col("_text") == F.col("text"), F.col("n_chars")).otherwise(F.length("_text")).cast("long").alias("n_chars"),
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near-dedup", one_of_each),
    ("decontamination", not_leaked),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: Neither the neighbours' votes nor byte-pair merges can be written in SQL; the tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name).frame
    return docs
