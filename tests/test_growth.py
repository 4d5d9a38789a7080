"""Steps whose cost has to follow their input."""

import math
import re

import pytest
from pyspark.sql import functions as F

from samplejobs import derived
from samplejobs.jobs import QUERIES
from veilspark.functions import checks
from veilspark.functions import patterns as P
from veilspark.functions.arrays import let, running_max, running_sum
from veilspark.functions.text import ENTROPY_SQL, chunked, cut, searchable, widen
from veilspark.operators import audits, resolve, secrets
from veilspark.operators import candidates as spans
from veilspark.sources.rules import Catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def customers(spark, tmp_path):
    rows = [(i // 2, f"Customer {i}", 1, 0.0, "BUILDING") for i in range(90)]
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_tasks_follow_the_rows(spark, customers, monkeypatch):
    monkeypatch.setattr(derived, "TEXTS_PER_TASK", 3)
    assert derived.customers(spark, customers, "c_custkey").rdd.getNumPartitions() == 30
    assert derived.customers(spark, customers, "c_custkey", texts_per_row=2).rdd.getNumPartitions() == 60
    assert derived.service_log(spark, customers).rdd.getNumPartitions() == 30
    one_key = spark.range(90).select(F.lit(7).alias("k"))
    assert max(derived.spread(one_key).rdd.glom().map(len).collect()) < 15


def test_texts_of_a_small_table_are_not_broadcast(spark, customers):
    found = QUERIES["rule_allowlist"](spark, customers)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    texts = derived.service_log(spark, customers).dropDuplicates(["log_id"])
    names = spark.createDataFrame([(0, "EMAIL_1", "a@b.example")], "log_id BIGINT, placeholder STRING, value STRING")
    same = audits.roundtrip_audit(texts, texts.withColumnRenamed("text", "masked"), names, ["log_id"], "log_id")
    assert not re.search(r"BroadcastHashJoin \[log_id#\d+L\], \[log_id#\d+L\], Inner", plan(same))
    assert same.where("same").count() == 45


def test_entropy_of_sql_takes_each_character_once(spark):
    spark.sql(ENTROPY_SQL)
    texts = ["", "a", "aab", "aé\U0001f600\U0001f600", "x y\nz" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").selectExpr("i", "entropy(t) AS bits").collect()
    for i, bits in rows:
        t = texts[i]
        assert bits == pytest.approx(-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)), abs=1e-12)
    assert ENTROPY_SQL.count("replace(") == 1


def test_spans_grow_over_words_of_any_length(spark):
    lengths = [0, 1, 31, 32, 33, 127, 128, 255, 256, 257, 600]
    texts = [("- " + "a" * n + "<>" + "b" * m + " -", n, m) for n in lengths for m in lengths]
    texts = [(t.replace("<>", "xy"), n, m) for t, n, m in texts]
    df = spark.createDataFrame(texts, "t STRING, n INT, m INT")
    at = F.col("n") + 2
    grown = let(chunked(F.col("t")), lambda c: widen(c, F.length("t"), at, at + 2))
    for n, m, g, longest in df.select("n", "m", grown, F.array_max(F.transform(chunked(F.col("t")), F.length))).collect():
        assert (g["start"], g["end"]) == (2, n + m + 4)
        assert longest <= 128


def never(*_):
    """Text that must not be asked for."""
    return F.raise_error(F.lit("not needed")).cast("string")


def test_keywords_of_short_lines_need_no_look_at_their_places(spark, monkeypatch):
    token = "gl" + "pat-" + "0123456789abcdefghij"
    monkeypatch.setattr(secrets, "condensed", lambda t: F.struct(*[never().alias(p) for p in ("named", "tokens", "text")]))
    found = secrets.rule_candidates(searchable(F.col("t")), Catalogue(), {"keys"})
    short = spark.createDataFrame([(f"first line\nuse {token} here\nlast one",), ("nothing here",), ("",)], "t STRING")
    rows = [[(c["rule"], c["start"], c["end"]) for c in r[0] or []] for r in short.select(found).collect()]
    assert rows == [[("gitlab-pat", 15, 41)], [], []]
    long = spark.createDataFrame([("word " * 60 + token,)], "t STRING")
    with pytest.raises(Exception, match="not needed"):
        long.select(found).collect()


def test_both_ways_to_the_rules_of_a_text_agree(spark, monkeypatch):
    tokens = ["gl" + "pat-" + "0123456789abcdefghij", "datadog_api_key = '" + "0a1b2c3d4e" * 4 + "'", "np" + "m_" + "0a1b2c3d4e5f6g7h8i9" + "j" * 17]
    head = "-----BEGIN RSA PRIV" + "ATE KEY-----\n"
    texts = ["\n".join(["plain words"] * 3 + tokens + [head + "A" * 64 + "\n" + head.replace("BEGIN", "END")])]
    texts += [texts[0].replace("plain words", "plain words " * 90), tokens[0] + " " + tokens[1], None]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").repartition(1)

    def found(mean):
        monkeypatch.setattr(secrets, "SHORT_LINE", mean)
        every = F.sort_array(secrets.rule_candidates(searchable(F.col("t")), Catalogue(), {"keys", "privateKeys", "passwords"}))
        return sorted((i, [tuple(c) for c in f or []]) for i, f in df.select("i", every).collect())

    whole, looked = found(1 << 30), found(0)
    assert whole == looked and {c[5] for c in whole[0][1]} >= {"gitlab-pat", "datadog-access-token", "private-key"}


def test_only_spans_beside_word_characters_are_widened(spark, monkeypatch):
    def grown(texts):
        whole = F.expr("array(named_struct('start', a, 'end', b, 'category', 'keys', 'label', 'L', 'tier', 1, 'rule', 'r', 'seq', 0))")
        df = spark.createDataFrame(texts, "t STRING, a INT, b INT")
        return [(r[0][0]["start"], r[0][0]["end"]) for r in df.select(spans.widened(F.col("t"), whole)).collect()]

    assert grown([("xyz", 0, 3), ("xyz", 1, 2), ("xy z", 0, 1), ("-\u00e9 xyz", 4, 6), ("a" * 300 + "xy", 300, 302)]) == [
        (0, 3), (0, 3), (0, 2), (3, 6), (0, 302)
    ]
    monkeypatch.setattr(spans, "widen", lambda *_: F.struct(never().cast("int").alias("start"), F.lit(0).alias("end")))
    assert grown([("xyz", 0, 3), ("- xyz\n", 2, 5), ("\u00e9xyz\u00e9", 1, 4)]) == [(0, 3), (2, 5), (1, 4)]


def test_running_values_take_as_many_strides_as_the_array_needs(spark):
    arrays = [[(i * 7) % 11 - 5 for i in range(n)] for n in (*range(10), 16, 17, 31, 32, 33, 64, 65, 100)]
    df = spark.createDataFrame([(a,) for a in [*arrays, None]], "v ARRAY<INT>").repartition(1)
    got = {tuple(r[0]): (r[1], r[2]) for r in df.select("v", running_sum(F.col("v")), running_max(F.col("v"))).collect() if r[0] is not None}
    for a in arrays:
        assert got[tuple(a)] == ([sum(a[: i + 1]) for i in range(len(a))], [max(a[: i + 1]) for i in range(len(a))])
    shown = df.select(running_sum(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "bin(" in shown


def test_a_bound_value_is_made_once_and_not_copied(spark):
    df = spark.createDataFrame([("a",), (None,)], "t STRING").repartition(1)
    twice = let(F.concat("t", F.expr("uuid()")), lambda x: F.struct(x.alias("a"), x.alias("b")))
    shown = df.select(twice.alias("s"), let(F.col("t"), lambda x: F.coalesce(x, F.lit("none"))).alias("n"))
    (full, one), (empty, none) = sorted(shown.collect(), key=lambda r: r[1])
    assert full["a"] == full["b"] != None and (one, none) == ("a", "none") and tuple(empty) == (None, None)  # noqa: E711
    assert "transform(" not in shown._jdf.queryExecution().optimizedPlan().toString()


def test_gates_of_the_checks_let_every_hit_pass(spark):
    stop = P.GLOBAL_STOPWORDS
    values = [
        "true", "TRUEish", "truth", "a false b", "aFALSEb", "is null", "NULL", "null!", "annul", "$1", "${12}", "$HOME", "$home", "${A_B}",
        "{{ a.b }}", "${{ secrets.KEY }}", "%PATH%", "%path%", "%+d", "%s", "{12}", "{}", "@VAR@", "/Users/me/x y", "/USERS/me/x", "/etc/a b",
        "/etc", *("".join(c * n for _ in "1") for c in "akKsSxzZ*." for n in (1, 2, 9)), "aab", "aA", "Xx", "", "..x", "*x", "\u212a", "k\u212a",
        *stop, *(f"x{w.upper()}y" for w in stop), stop[1].replace("k", "\u212a"), stop[1][:-1], stop[0][1:], "9f8e7d6c5b4a", None,
    ]
    df = spark.createDataFrame([(v,) for v in values], "v STRING").repartition(1)
    v = F.col("v")
    plain = F.lit(False)
    for pattern in P.GLOBAL_ALLOW:
        plain = plain | v.rlike(pattern)
    held = F.contains(F.lower(v), F.lit(stop[0])) | F.contains(F.lower(v), F.lit(stop[1]))
    rows = df.select("v", checks.globally_allowed(v), plain, checks.has_global_stopword(v), held, v.rlike(P.GLOBAL_ALLOW_GATE)).collect()
    for value, allowed, listed, stopped, holds, gate in rows:
        assert (allowed, stopped) == (listed, holds), value
        assert gate or not listed, value
    assert {r[0] for r in rows if r[1]} >= {"true", "a false b", "is null", "KK", "{}", "/etc/a b"} and sum(bool(r[3]) for r in rows) == 5
    assert not any(r[5] for r in rows if r[0] in ("9f8e7d6c5b4a", "truth", "annul", "aab"))

    names = ["key", "monkey", "apiKeys", "my.pwd", "PASS", "compass", "a_pa\u017fs", "title", "privateX", "publicKey", "keyed", "KEYS-x", "", None]
    segments = F.split(v, P.NAME_SEGMENTS)
    whole = ~F.upper(v).rlike(P.PUBLIC_NAME) & (
        F.upper(v).rlike(P.SECRET_NAME) | F.exists(segments, lambda s: F.upper(s).rlike(P.SECRET_SEGMENT))
    )
    shown = spark.createDataFrame([(n,) for n in names], "v STRING").repartition(1)
    assert all(r[0] == r[1] for r in shown.select(checks.is_secret_name(v), whole, F.lit(P.SECRET_SEGMENT_GATE)).collect())
    gate = re.compile(P.AUTH_GATE)
    assert all(gate.search(x) for x in ("x BEARER y", "AUTHORIZATION:", "bearer")) and not gate.search("bear author")


def test_a_cut_takes_one_chunk_or_two_without_a_slice(spark, monkeypatch):
    text = "".join(chr(97 + i % 26) if i % 9 else "é" for i in range(400))
    at = [(a, b) for a in (0, 1, 127, 128, 255, 256, 383, 384, 399, 400) for b in (0, 1, 127, 128, 129, 256, 300, 400) if a <= b]
    df = spark.createDataFrame([(text, a, b) for a, b in at], "t STRING, a INT, b INT").repartition(1)
    for n in (400, 384):
        short = df.withColumn("t", F.substr("t", F.lit(1), F.lit(n))).where(f"b <= {n}")
        rows = short.select("a", "b", cut(chunked(F.col("t")), F.col("a"), F.col("b"))).collect()
        assert len(rows) > 20 and all(got == text[a:b] for a, b, got in rows)
    none = df.limit(1).select(cut(chunked(F.lit(None).cast("string")), F.col("a"), F.col("b"))).collect()
    assert none[0][0] is None
    monkeypatch.setattr(F, "slice", lambda *_: F.array(never()))
    near = df.where("a div 128 = greatest(b - 1, a) div 128 or a div 128 + 1 = greatest(b - 1, a) div 128").where("a < 400")
    rows = near.select("a", "b", cut(chunked(F.col("t")), F.col("a"), F.col("b"))).collect()
    assert len(rows) > 20 and all(got == text[a:b] for a, b, got in rows)


def test_spans_in_order_and_apart_are_not_sorted_again(spark, monkeypatch):
    fields = "array<struct<start:int,end:int,category:string,label:string,tier:int,rule:string,seq:int>>"

    def rows(spans):
        one = [(a, b, "email", "EMAIL", 2, "email", 1003) for a, b in spans]
        df = spark.createDataFrame([(one,), (None,)], f"c {fields}").repartition(1)
        both = df.select(let(resolve.resolved(F.col("c")), resolve.merged)).collect()
        return sorted(([(s["start"], s["end"]) for s in r[0]] if r[0] is not None else [(-1, -1)]) for r in both)[1]

    assert rows([(5, 9), (0, 3)]) == [(0, 3), (5, 9)]
    assert rows([(0, 3), (3, 9), (12, 14)]) == [(0, 9), (12, 14)]
    assert rows([(0, 6), (4, 12), (20, 21)]) == [(4, 12), (20, 21)]
    monkeypatch.setattr(resolve, "_greedy", lambda _: F.array(F.raise_error(F.lit("not needed"))).cast(fields))
    assert rows([(0, 3), (4, 9), (9, 10)]) == [(0, 3), (4, 10)] and rows([(2, 3)]) == [(2, 3)]
    with pytest.raises(Exception, match="not needed"):
        rows([(5, 9), (0, 3)])


def test_documents_that_grow_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "TEXTS_PER_TASK", 8)
    rows = [(i // 2, f"user{i % 3}@mail.example.com and text {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["doc_top_findings"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 20
    # 231 addresses, the first of the list twice: 230 and the text's own one, 200 of them listed
    assert found.count() == 40 * 200 and {r[0] for r in found.select("n_more").distinct().collect()} == {31}
    assert found.where("placeholder = 'EMAIL_2' AND preview = 'box1@many.example.org' AND n_hits = 2 AND place = 2").count() == 40
