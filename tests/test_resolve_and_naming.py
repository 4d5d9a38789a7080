import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.operators import naming, resolve
from veilspark.operators.skew import hot_keys, split_join

FIELDS = "start INT, end INT, category STRING, label STRING, tier INT, rule STRING, seq INT"


def greedy(candidates):
    """Plain form of the overlap rule, with a set of taken positions."""
    taken, kept = set(), []
    for c in sorted(candidates, key=lambda c: (-c[4], c[0] - c[1], c[0], c[6])):
        places = set(range(c[0], c[1]))
        if not places & taken:
            taken |= places
            kept.append(c)
    return sorted(kept)


def join_touching(spans):
    out = []
    for c in spans:
        if out and out[-1][1] == c[0]:
            last = out[-1]
            best = c if c[4] > last[4] else last
            out[-1] = (last[0], c[1], *best[2:])
        else:
            out.append(c)
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    rows = []
    for doc in range(400):
        spans = []
        for seq in range(r.choice([0, 1, 2, 5, 9, 40, 150])):
            start = r.randrange(0, 400)
            tier = r.randrange(1, 5)
            spans.append((start, start + r.randrange(1, 14), "keys", f"L{seq % 7}", tier, f"r{seq}", seq))
        rows.append((doc, spans))
    return rows


def test_array_and_table_form_equal_brute_force(spark, texts):
    df = spark.createDataFrame(texts, f"doc INT, c ARRAY<STRUCT<{FIELDS}>>").repartition(8)
    arrays = {
        r["doc"]: ([tuple(x) for x in r["kept"]], [tuple(x) for x in r["merged"]])
        for r in df.select(
            "doc", resolve.resolved(F.col("c")).alias("kept"), let(resolve.resolved(F.col("c")), resolve.merged).alias("merged")
        ).collect()
    }
    for doc, spans in texts:
        kept = greedy(spans)
        assert arrays[doc][0] == kept
        assert arrays[doc][1] == join_touching(kept)
    rows = df.select("doc", F.inline("c"))
    kept = resolve.resolved_table(rows, ["doc"])
    got = {}
    for r in kept.collect():
        got.setdefault(r["doc"], []).append(tuple(r[f] for f in ("start", "end", "category", "label", "tier", "rule", "seq")))
    assert {d: sorted(x) for d, x in got.items()} == {d: greedy(x) for d, x in texts if x}
    joined = {}
    for r in resolve.merged_table(kept, ["doc"]).collect():
        joined.setdefault(r["doc"], []).append((r["start"], r["end"], r["label"]))
    want = {d: [(c[0], c[1], c[3]) for c in join_touching(greedy(x))] for d, x in texts if x}
    assert {d: sorted(x) for d, x in joined.items()} == want


def test_names_within_a_row(spark):
    r = random.Random(5)
    rows, want = [], {}
    for doc in range(150):
        n = r.choice([1, 2, 3, 17, 60])
        taken = [f"A_{k}" for k in r.sample(range(1, 30), r.choice([0, 3, 8]))] + ["A_01", "B_C_2", "X_99999999999999999999"]
        values = [(i * 10, i * 10 + 5, "keys", r.choice(["A", "B", "B_C"]), "rule", f"v{r.randrange(0, 25)}") for i in range(n)]
        rows.append((doc, values, taken))
        names, counters = {}, {}
        for v in values:
            if v[5] not in names:
                k = counters.get(v[3], 0) + 1
                while f"{v[3]}_{k}" in taken:
                    k += 1
                counters[v[3]] = k
                names[v[5]] = f"{v[3]}_{k}"
        want[doc] = [names[v[5]] for v in values]
    schema = "doc INT, s ARRAY<STRUCT<start INT, end INT, category STRING, label STRING, rule STRING, value STRING>>, t ARRAY<STRING>"
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = df.select("doc", naming.named(F.col("s"), F.col("t")).alias("n")).collect()
    assert {g["doc"]: [x["placeholder"] for x in g["n"]] for g in got} == want


def test_names_across_rows_with_one_large_scope(spark):
    """One scope holds most rows; numbers must equal a plain pass over the ordered rows."""
    r = random.Random(9)
    rows, texts = [], []
    for turn in range(1200):
        scope = "hot" if turn % 3 else f"s{turn % 7}"
        value = f"v{r.randrange(0, 500)}"
        rows.append((scope, turn, r.randrange(0, 50), value, r.choice(["EMAIL", "IP"]), "c"))
        if turn % 40 == 0:
            texts.append((scope, f"see EMAIL_{turn // 40 + 1} and IP_0{turn} and IP_{turn}"))
    found = spark.createDataFrame(rows, "scope STRING, turn INT, start INT, value STRING, label STRING, category STRING")
    source = spark.createDataFrame(texts, "scope STRING, text STRING")
    unique = naming.unique_values(found, "scope", ["turn", "start"])
    names = naming.number_values(unique, naming.reserved_numbers(source, "text", "scope"), "scope", slices=13)
    got = {(x["scope"], x["value"]): x["placeholder"] for x in names.collect()}
    used = {(s, w) for s, t in texts for w in t.split()}
    want, counters = {}, {}
    for scope, turn, start, value, label, _ in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if (scope, value) not in want:
            k = counters.get((scope, label), 0) + 1
            while (scope, f"{label}_{k}") in used:
                k += 1
            counters[scope, label] = k
            want[scope, value] = f"{label}_{k}"
    assert got == want


def test_running_count_spreads_one_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), "id").repartition(8)
    out = naming.running_count(df, ["g"], ["id"], F.lit(1), "n", slices=9)
    assert out.where("n <> id + 1").count() == 0
    assert out.count() == 5000


def test_numbers_beside_many_that_are_taken(spark):
    """The n-th value of a label gets the n-th free number, also with thousands of both."""
    rng = random.Random(5)
    cases = []
    for n, m in ((3, 0), (5, 3), (40, 60), (5000, 5000)):
        values = [f"v{rng.randrange(n)}" for _ in range(n)]
        labels = {v: rng.choice(["A", "B", "EMAIL"]) for v in values}
        taken = [f"{rng.choice(['A', 'B', 'C', 'EMAIL'])}_{rng.choice([str(rng.randrange(1, 2 * m)), '007', '0', 'x'])}" for _ in range(m)]
        cases.append((len(cases), [(i, i + 1, "c", labels[v], "r", v) for i, v in enumerate(values)], taken))
    span = "struct<start:int,end:int,category:string,label:string,rule:string,value:string>"
    table = spark.createDataFrame(cases, f"id int, spans array<{span}>, taken array<string>")
    began = time.time()
    got = table.select("id", naming.named(F.col("spans"), F.array_distinct("taken")).alias("spans")).collect()
    assert time.time() - began < 60
    for row in got:
        _, spans, taken = cases[row.id]
        free = {label: filter(lambda i, own=f"{label}_", used=set(taken): f"{own}{i}" not in used, itertools.count(1)) for label in ("A", "B", "EMAIL")}
        names = {}
        for _, _, _, label, _, value in spans:
            if value not in names:
                names[value] = f"{label}_{next(free[label])}"
        assert [s.placeholder for s in row.spans] == [names[s[5]] for s in spans]


def test_a_hot_key_stays_where_it_is(spark):
    left = spark.range(40_000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("s")).alias("scope"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT_1")).otherwise(F.concat(F.lit("W_"), (F.col("id") % 5000).cast("string"))).alias("word"),
    ).repartition(16, "id").checkpoint()
    right = left.select(F.col("scope").alias("_s"), F.col("word").alias("_w")).distinct().where("_w <> 'W_7'").withColumn("v", F.concat("_w", F.lit("!")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            joined = split_join(left, right, [("scope", "_s"), ("word", "_w")], how)
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
            plain = left.join(right, F.expr("scope <=> _s AND word = _w"), how)
            assert joined.exceptAll(plain).isEmpty() and joined.count() == plain.count()
        assert hot_keys(left, ["scope", "word"]).count() == 2 and split_join(left.limit(0), right, [("word", "_w")]).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_large_island(spark):
    """10,000 candidates that hang together: none is compared with all that are accepted."""
    rng = random.Random(11)
    chain = [(i * 7, i * 7 + 9, "c", "L", rng.randrange(1, 5), "r", i) for i in range(8000)]
    inner = [(s := rng.randrange(56_000), s + rng.randrange(1, 40), "c", "L", rng.randrange(1, 5), "r", 8000 + i) for i in range(2000)]
    table = spark.createDataFrame([(chain + inner,)], f"c array<struct<{FIELDS.replace(' ', ':')}>>".replace(",:", ","))
    began = time.time()
    got = [tuple(x) for x in table.select(resolve.resolved(F.col("c")).alias("kept")).first().kept]
    assert time.time() - began < 30
    assert got == greedy(chain + inner)
