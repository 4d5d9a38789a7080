"""Language of web pages by Bayesian fusion of several kinds of evidence.

1. Text: hashed byte trigrams under a model with one distribution a language, learned from
   labelled texts. Trigrams overlap, so the log likelihood is tempered.
2. The language that the markup declares.
3. A language-like part of the address: the first part of the path, else the last part of the host.
4. The host: its share of languages, smoothed by that of its domain, smoothed by that of all pages.

How reliable 2 and 3 are and what hosts hold is counted over all pages by grouped
aggregation of what the text alone says, each page without its own share. All terms are added
as logarithms.

Defined results: a page without text is decided by the other evidence; null pages have neither
text nor a declaration, null addresses have no host and count as one host; equal rows
get equal rows; without labelled texts every page has a null language. Declarations and parts of
addresses are two or three letters, so their tables have at most 18,252 rows and are broadcast;
hosts are joined with hot hosts salted. Every language that a labelled text has is known; the model has a row of
``BUCKETS`` numbers for each. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import hot_keys, salted_join, store, text_bytes

#: Labelled texts that the text model is learned from (about so many), and its buckets of trigrams.
EXAMPLES = 8000
BUCKETS = 1 << 15
#: Weight of a trigram, for they overlap and repeat, and the most that text may weigh.
TEMPER = 0.2
MOST = 25.0

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.I)
_META = re.compile(r"<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.I)


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte; letters only count in lower case, others as one blank."""
    kind = np.full(256, 32, np.uint32)
    kind[97:123] = np.arange(97, 123)
    kind[65:91] = np.arange(97, 123)
    kind[128:] = np.arange(128, 256)
    x = kind[data]
    if len(x) < 3:
        return np.empty(0, np.int64)
    gram = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    places = ((gram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    places[gram == 0x202020] = -1
    return places


def learn(
    texts: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", examples: int = EXAMPLES
) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every bucket under each, from a bounded sample of labelled texts."""
    place = F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30))
    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("_place"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    names = [r.lang for r in sizes.orderBy(F.col("rows").desc(), "lang").collect()]
    share = max(1, examples // max(1, len(names)))
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, borders = text_bytes(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                places = _buckets(data[borders[i] : borders[i + 1]])
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += np.bincount(places[places >= 0], minlength=BUCKETS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=out.names)

    # Of each language as many rows as its share, give or take chance; a row a language is sent to the tasks.
    reach = F.floor(F.least(F.lit(1.0), F.lit(float(share)) / F.col("rows")) * (1 << 30)) + 1
    sample = known.join(F.broadcast(sizes.select("lang", reach.alias("_reach"))), "lang").where("_place < _reach").select("lang", "text")
    table = np.full((len(names), BUCKETS), 0.5)
    if names:
        row = {name: i for i, name in enumerate(names)}
        lists = F.collect_list(F.struct("bucket", "n")).alias("cells")  # at most BUCKETS a language
        counts = sample.mapInArrow(run, out).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(lists)
        for batch in counts.select("lang", "cells.bucket", "cells.n").toArrow().to_batches():
            for name, bucket, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                table[row[name], bucket.values.to_numpy()] += n.values.to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str], url: str, page: str) -> DataFrame:
    """``(keys, url, declared, text array<double>)``: the declaration and the log likelihood of each language."""
    names, table = model
    out = T.StructType(
        [
            *[pages.schema[k] for k in keys],
            T.StructField("url", T.StringType()),
            T.StructField("declared", T.StringType()),
            T.StructField("text", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.ascontiguousarray(table.T)
        for batch in batches:
            n = len(keys)
            whole = batch.column(n + 1)
            declared, logs = [], []
            for source in whole:
                source = source.as_py() or ""
                found = _DECLARED.search(source) or _META.search(source)
                declared.append(found.group(1).lower() if found else None)
                places = _buckets(np.frombuffer(html.unescape(_HIDDEN.sub(" ", source)).encode("utf-8", "replace"), np.uint8))
                places = places[places >= 0]
                total = np.zeros(len(names))
                for at in range(0, len(places), 1 << 16):
                    total += by_bucket[places[at : at + (1 << 16)]].sum(axis=0)
                logs.append((total * min(TEMPER, MOST / max(float(np.ptp(total)), 1e-9))).tolist() if len(names) else [])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n)], batch.column(n), pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
                names=out.names,
            )

    return pages.select(*keys, F.col(url).alias("url"), F.col(page)).mapInArrow(run, out)


def _shares(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.get("share", F.lit(i))).alias(f"s{i}") for i in range(n)]


def identify(
    pages: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("page_id",), url: str = "url", page: str = "html", text: str = "text",
    lang: str = "lang", doc_id: str = "doc_id",
) -> DataFrame:
    """``(keys, url, lang, confidence, text_lang, declared, suffix, shares map)`` of every page."""
    names, table = learn(texts, text, lang, doc_id)
    n = len(names)
    address = F.lower(F.col("url"))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    path = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://[^/]*/([a-z]{2,3})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2,3})$", 1)
    found = evidence(pages, (names, table), list(keys), url, page)
    rows = store(
        found.select(
            *keys, "url", "declared", "text",
            _shares(F.col("text")).alias("share"),
            F.coalesce(host, F.lit("")).alias("host"),
            F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
            F.when(path != "", path).when(top != "", top).alias("suffix"),
        ),
        "pages",
    ).frame
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*keys, "url", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "suffix", F.create_map().cast("map<string,double>").alias("shares"))

    total = rows.agg(F.count("*").alias("n"), *_sums(n)).first()
    overall = [((total[f"s{i}"] or 0.0) + 1) / (total.n + n) for i in range(n)]

    def told(column: str) -> DataFrame:
        """For each value the sums of shares; the values are two or three letters."""
        return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(f"{column}_n"), F.array(*_sums(n)).alias(f"{column}_s"))

    def smoothed(counts: str, size: str, base: Column, weight: float) -> Column:
        """Shares of a group without the page itself, smoothed by ``base``."""
        others = F.zip_with(counts, "share", lambda c, s: F.greatest(c - s, F.lit(0.0)))
        return F.zip_with(others, base, lambda c, b: (c + weight * b) / (F.col(size) - 1 + weight))

    def likelihood(column: str) -> Column:
        """log P(value | language), up to a constant; nothing without a value."""
        base = F.array(*map(F.lit, overall))
        posterior = smoothed(f"{column}_s", f"{column}_n", base, 4.0)
        logs = F.zip_with(posterior, base, lambda p, b: F.log(p) - F.log(b))
        return F.when(F.col(column).isNotNull(), logs).otherwise(F.array(*[F.lit(0.0)] * n))

    domains = rows.groupBy("domain").agg(F.count("*").alias("domain_n"), F.array(*_sums(n)).alias("domain_s"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_n"), F.array(*_sums(n)).alias("host_s"))
    placed = (
        salted_join(salted_join(rows, domains, "domain", by=list(keys)), hosts, "host", hot=hot_keys(rows, "host"), by=list(keys))
        .join(F.broadcast(told("declared")), "declared", "left")
        .join(F.broadcast(told("suffix")), "suffix", "left")
    )
    base = F.array(*map(F.lit, overall))
    prior = smoothed("host_s", "host_n", smoothed("domain_s", "domain_n", base, 8.0), 4.0)
    parts = [F.col("text"), F.transform(prior, lambda p: F.log(p)), likelihood("declared"), likelihood("suffix")]
    joint = parts[0]
    for one in parts[1:]:
        joint = F.zip_with(joint, one, lambda a, b: a + b)
    known = F.array(*map(F.lit, names))
    best = lambda shares: F.get(known, (F.array_position(shares, F.array_max(shares)) - 1).cast("int"))
    return (
        placed.withColumn("_joint", _shares(joint))
        .select(
            *keys, "url",
            best(F.col("_joint")).alias("lang"),
            F.array_max("_joint").alias("confidence"),
            best(F.col("share")).alias("text_lang"),
            "declared", "suffix",
            F.map_from_arrays(known, "_joint").alias("shares"),
        )
    )
