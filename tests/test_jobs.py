import os

import pytest
from pyspark.sql import functions as F

from tests.cases import sample_log
from veilspark import CATEGORIES, Catalogue, entropy, restore, scan
from veilspark.functions.text import ENTROPY_SQL
from veilspark.operators import audits, keeping, reports
from veilspark.operators.restoring import restore_with_map
from veilspark.plans import sql
from veilspark.plans.scan import KeptScan
from veilspark.sources import documents
from veilspark.sources.documents import write_scan
from veilspark.streaming import masking


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("texts")
    (f / "a.log").write_text(sample_log())
    (f / "b.log").write_text("mail a@example.com\r\n\n")
    (f / "c.log").write_text("")
    return f


def test_files_lines_and_sinks(spark, folder, tmp_path):
    texts = documents.read_text_files(spark, str(folder)).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "text")
    assert {r["name"]: len(r["text"]) for r in texts.collect() if r["name"] != "a.log"} == {"b.log": 21, "c.log": 0}
    got = documents.lines(texts.where("name = 'b.log'"), "text", ["name"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line_start"], r["line"]) for r in got] == [(0, 0, "mail a@example.com\r"), (1, 20, ""), (2, 21, "")]
    result = scan(texts, "text", ["name"])
    paths = [str(tmp_path / p) for p in ("masked", "findings", "vault")]
    documents.write_scan(result, *paths)
    assert spark.read.parquet(paths[1]).columns == ["name", "start", "end", "category", "rule", "placeholder"]
    back = restore(spark.read.parquet(paths[0]), "masked", spark.read.parquet(paths[2]), ["name"], "name")
    same = back.join(texts, "name").select(F.col("restored") == F.col("text"))
    assert all(r[0] for r in same.collect())
    with pytest.raises(ValueError):
        documents.write_scan(result, paths[0], paths[1], paths[0] + "/vault")
    documents.write_scan(result, str(tmp_path / "m2"), str(tmp_path / "f2"))
    with pytest.raises(Exception, match="(?i)exists"):
        documents.write_scan(result, *paths)  # a vault is never written over
    documents.write_scan(result, str(tmp_path / "m2"), str(tmp_path / "f2"), str(tmp_path / "m2-vault"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f2", "findings", "m2", "m2-vault", "masked", "vault"]
    documents.write_masked_text(result, str(tmp_path / "lines"))
    lines = spark.read.json(str(tmp_path / "lines"))
    assert {r["name"]: r["masked"] for r in lines.collect()} == {r["name"]: r["masked"] for r in result.masked.collect()}


def test_views(spark):
    df = spark.createDataFrame([(1, "mail a@example.com")], "id INT, text STRING")
    scan(df, "text", ["id"]).create_views()
    row = spark.sql("SELECT masked, placeholder, value FROM masked JOIN placeholder_map USING (id) JOIN findings USING (id, placeholder)").first()
    assert tuple(row) == ("mail EMAIL_1", "EMAIL_1", "a@example.com")


def test_streams(spark, folder, tmp_path):
    query = masking.write_masked(
        masking.text_stream(spark, str(folder)), "text", ["path"], str(tmp_path / "m"), str(tmp_path / "c"), str(tmp_path / "v"),
        catalogue=Catalogue(), findings_path=str(tmp_path / "f"),
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "f"))
    assert {r["placeholder"] for r in found.collect()} >= {"EMAIL_1"} and "value" not in found.columns
    got = {r["path"].split("/")[-1]: r["masked"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got["b.log"] == "mail EMAIL_1\r\n\n"
    masked = masking.mask_stream(masking.text_stream(spark, str(folder)), "text", ["path"]).masked
    query = (
        masked.writeStream.format("parquet").option("path", str(tmp_path / "m2"))
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    again = {r["path"].split("/")[-1]: r["masked"] for r in spark.read.parquet(str(tmp_path / "m2")).collect()}
    assert again == got


def test_restore_whole_words_only(spark):
    mapping = spark.createDataFrame([(7, f"HOST_{i}", f"node-{i}.example.net") for i in range(1, 25)], "ticket INT, placeholder STRING, value STRING")
    answer = "Restart HOST_2 (not HOST_21!) and HOST_24/HOST_2; leave XHOST_2, HOST_2B, HOST_77 and host_2 alone."
    want = "Restart node-2.example.net (not node-21.example.net!) and node-24.example.net/node-2.example.net; leave XHOST_2, HOST_2B, HOST_77 and host_2 alone."
    df = spark.createDataFrame([(7, answer), (8, answer), (9, ""), (None, answer)], "ticket INT, reply STRING")
    got = {r["ticket"]: r["restored"] for r in restore(df, "reply", mapping, ["ticket"], "ticket").collect()}
    assert got == {7: want, 8: answer, 9: "", None: answer}
    names = F.create_map(*[F.lit(x) for i in (2, 21, 24) for x in (f"HOST_{i}", f"node-{i}.example.net")])
    assert df.where("ticket = 7").select(restore_with_map(F.col("reply"), names)).first()[0] == want
    sql.register(spark)
    df.createOrReplaceTempView("answers")
    by_sql = "restore(reply, map('HOST_2', 'node-2.example.net', 'HOST_21', 'node-21.example.net', 'HOST_24', 'node-24.example.net'))"
    assert {r[0] for r in spark.sql(f"SELECT {by_sql} FROM answers WHERE ticket IN (7, 9)").collect()} == {want, ""}
    assert spark.sql("SELECT restore(CAST(NULL AS STRING), map('A_1', 'x'))").first()[0] is None
    assert [r.category for r in spark.table("categories").orderBy("position").collect()] == list(CATEGORIES)


def test_a_batch_that_dies_between_its_outputs(spark, tmp_path, monkeypatch):
    """Each row comes once, no reader sees half a batch, and nothing is left in the shared folder."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.log").write_text(f"mail user{i}@example.org now")
    paths = {n: str(tmp_path / n) for n in ("masked", "findings", "vault", "progress")}

    def run():
        masking.write_masked(
            masking.text_stream(spark, str(folder)), "text", ["path"], paths["masked"], paths["progress"], paths["vault"], findings_path=paths["findings"]
        ).awaitTermination()

    def left():
        shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        return [n for n in os.listdir(shared) if n.startswith("veilspark-stream-")]

    with monkeypatch.context() as broken:
        broken.setattr(KeptScan, "discard", lambda self: None)  # a killed driver discards nothing
        broken.setattr(KeptScan, "findings", property(lambda self: 1 / 0))
        with pytest.raises(Exception):
            run()
    schema = "path STRING, masked STRING"
    assert masking.read_committed(spark, paths["masked"], paths["masked"], schema).count() == 0 and left()
    run()
    got = masking.read_committed(spark, paths["masked"], paths["masked"], schema).collect()
    assert sorted(r.masked for r in got) == ["mail EMAIL_1 now"] * 3 and masking.committed_batches(spark, paths["masked"]) == [0]
    vault = masking.read_committed(spark, paths["vault"], paths["masked"], "path STRING, placeholder STRING, value STRING")
    assert {r.value for r in vault.collect()} == {f"user{i}@example.org" for i in range(3)} and vault.count() == 3
    assert not left()


def test_partitioned_sinks_are_put_in_place_together(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "mail x@example.org"), (2, "b", "none"), (3, None, "y@example.org")], "id INT, part STRING, text STRING")
    masked, found, vault = (str(tmp_path / n) for n in ("masked", "found", "vault"))
    write_scan(scan(df, "text", ["id", "part"]), masked, found, vault, partition_by=["part"])
    assert {n for n in os.listdir(masked) if "=" in n} == {"part=a", "part=b", "part=__HIVE_DEFAULT_PARTITION__"}
    assert {(r.id, r.part, r.masked) for r in spark.read.parquet(masked).collect()} == {(1, "a", "mail EMAIL_1"), (2, "b", "none"), (3, None, "EMAIL_1")}
    with pytest.raises(Exception):  # the vault is there already: nothing is replaced
        write_scan(scan(df.limit(0), "text", ["id", "part"]), masked, found, vault)
    assert spark.read.parquet(masked).count() == 3 and spark.read.parquet(found).count() == 2
    write_scan(scan(df.where("id = 2"), "text", ["id", "part"]), masked, found)
    assert spark.read.parquet(masked).count() == 1 and not [n for n in os.listdir(tmp_path) if ".new-" in n]
    with pytest.raises(ValueError):
        write_scan(scan(df, "text", ["id"]), masked, found, partition_by=["part"])


def test_leaks_are_looked_for_in_the_row(spark):
    df = spark.createDataFrame([(1, "mail x@example.org, twice x@example.org"), (2, "nothing"), (3, None)], "id INT, text STRING")
    more = F.array(F.struct(F.lit("hide").alias("must"), F.lit("twice").alias("value")), F.struct(F.lit("keep").alias("must"), F.lit("mail").alias("value")))
    result = scan(df, "text", ["id"])
    audit = audits.leak_audit_in_rows(result, more)
    assert {tuple(r) for r in audit.collect()} == {(1, "hide", "twice"), (2, "keep", "mail")}
    assert "Exchange " not in audit._jdf.queryExecution().executedPlan().toString()
    assert audits.leak_audit_in_rows(result).count() == 0
    wanted = spark.createDataFrame([(1, "hide", "twice"), (1, "hide", "example"), (2, "keep", "mail"), (9, "keep", "x")], "id INT, must STRING, value STRING")
    assert {tuple(r) for r in audits.leak_audit(result.masked, wanted, ["id"]).collect()} == {(1, "hide", "twice"), (2, "keep", "mail")}


def test_scope_shares_names_and_splits_rows(spark):
    rows = [("c1", 0, "mail a@x.org"), ("c1", 1, "EMAIL_2 is taken; b@x.org"), ("c1", 2, "b@x.org and c@x.org, a@x.org"), ("c2", 0, "c@x.org"), ("c2", 1, "none")]
    df = spark.createDataFrame(rows, "conv STRING, turn INT, text STRING")
    result = scan(df, "text", ["conv", "turn"], scope="conv", order=["turn"])
    got = {(r["conv"], r["turn"]): r["masked"] for r in result.masked.collect()}
    assert got == {
        ("c1", 0): "mail EMAIL_1", ("c1", 1): "EMAIL_2 is taken; EMAIL_3", ("c1", 2): "EMAIL_3 and EMAIL_4, EMAIL_1",
        ("c2", 0): "EMAIL_1", ("c2", 1): "none",
    }
    assert result.map.count() == 4
    back = restore(result.masked, "masked", result.map, ["conv", "turn"], "conv")
    # a word that was in the text before keeps its place; it is not in the map
    assert {(r["conv"], r["turn"]): r["restored"] for r in back.collect()} == {(c, t): x for c, t, x in rows}


def test_checkpoints_hold_no_value(spark):
    before = "far.from.home@example.org"
    df = spark.createDataFrame([(1, 0, f"mail {before}"), (1, 1, f"again {before} and here@example.net")], "conv INT, turn INT, text STRING")
    result = scan(df, "text", ["conv", "turn"], scope="conv", order=["turn"])
    assert {(r["placeholder"], r["value"]) for r in result.map.collect()} == {("EMAIL_1", before), ("EMAIL_2", "here@example.net")}
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = [os.path.join(path, name) for path, _, names in os.walk(folder) for name in names]
    assert files and not any(b"far.from" in open(f, "rb").read() or b"here@" in open(f, "rb").read() for f in files)


def test_kept_rows_give_the_same_results_and_hold_no_value(spark):
    rows = [
        (1, "mail far.off@example.org, 198.51.100.23 and far.off@example.org"), (2, "plain"), (3, ""), (4, None),
        (5, "😀 EMAIL_1 x" * 900 + " edge@example.net"), (None, "no.id@example.org"), (1, "twice@example.org"),
    ]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    lazy = scan(df, "text", ["id"])
    kept = lazy.kept()
    for name in ("masked", "findings", "occurrences", "map", "segments", "rows"):
        one, two = getattr(lazy, name), getattr(kept, name)
        assert one.columns == two.columns
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())), name
    stored = spark.read.parquet(kept.folder)
    assert not stored.where("exists(_gaps, g -> contains(g, 'example.org')) OR exists(_spans, s -> contains(cast(s.value AS STRING), 'example'))").count()
    kept.discard()
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(kept.folder).count()


def test_a_scope_masks_rows_without_or_with_equal_ids(spark):
    rows = [("c", 0, "a@x.org"), ("c", 0, "b@x.org a@x.org"), (None, None, "a@x.org EMAIL_1"), ("c", 1, None), ("c", 2, "")]
    df = spark.createDataFrame(rows, "conv STRING, turn INT, text STRING")
    got = scan(df, "text", ["conv", "turn"], scope="conv", order=["turn"]).masked.collect()
    assert len(got) == 5 and not any("@" in (r["masked"] or "") for r in got)
    assert {r["masked"] for r in got if r["conv"] is None} == {"EMAIL_2 EMAIL_1"}


def test_restore_shuffles_only_texts_with_placeholders(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail EMAIL_1"), (2, "plain"), (3, None), (None, "x")], "id INT, masked STRING")
    df.write.parquet(str(tmp_path / "m"))
    names = spark.createDataFrame([(1, "EMAIL_1", "a@x.org")], "id INT, placeholder STRING, value STRING")
    back = restore(spark.read.parquet(str(tmp_path / "m")), "masked", names, ["id"], "id")
    assert {(r["id"], r["restored"]) for r in back.collect()} == {(1, "mail a@x.org"), (2, "plain"), (3, None), (None, "x")}
    with pytest.raises(ValueError):
        reports.top_rows(df.withColumn("category", F.lit("email")), [F.col("id")], 10**6)


def test_sealed_values_are_alike_and_open(spark):
    seal, unseal = keeping.sealing()
    df = spark.createDataFrame([("a",), ("a",), ("",), ("é" * 5000,), (None,)], "v STRING").repartition(3)
    sealed = df.select("v", seal(F.col("v")).alias("s"))
    assert sealed.select("s").distinct().count() == 4
    assert sealed.where(~F.col("v").eqNullSafe(unseal(F.col("s")))).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([(1, "a@x.org b@x.org 198.51.100.23 a@x.org"), (2, "nothing"), (3, "c@x.org")], "id INT, text STRING")
    result = scan(df, "text", ["id"])
    counts = {r["category"]: (r["n_values"], r["n_matches"]) for r in reports.category_counts(result.findings, ["id"]).collect()}
    assert counts["email"] == (3, 4) and counts["ip"] == (1, 1) and counts["iban"] == (0, 0) and len(counts) == 8
    assert {r["id"]: r["summary"] for r in reports.share_summary(result.rows, ["id"]).collect()} == {1: "2 emails and 1 IP address", 3: "1 email"}
    by_value = result.occurrences.groupBy("category", "value").agg(F.count("*").alias("n"))
    top = {(r["category"], r["value"]): r["n_more"] for r in reports.top_rows(by_value, [F.desc("n"), F.col("value")], 1).collect()}
    assert top == {("email", "a@x.org"): 2, ("ip", "198.51.100.23"): 0}
    long = spark.createDataFrame([("x" * 70,), ("first\nsecond",), ("short",)], "v STRING")
    assert [r[0] for r in long.select(reports.preview(F.col("v"))).collect()] == ["x" * 61 + "...", "first ...", "short"]
    parts = [(r["part"], r["original"], r["placeholder"]) for r in result.segments.where("id = 3").collect()]
    assert parts == [(0, "c@x.org", "EMAIL_1")]
    stats = reports.document_stats(spark.createDataFrame([(1, ""), (2, "a\nb")], "id INT, text STRING"), "text", ["id"]).orderBy("id").collect()
    assert [(r["n_lines"], r["lines_text"], r["size_text"]) for r in stats] == [(0, "0 lines", "0 B"), (2, "2 lines", "3 B")]


def test_counts_and_lists_of_each_text(spark):
    mails = " ".join(f"u{i}@x.org" for i in range(5))
    df = spark.createDataFrame([(1, f"{mails} u3@x.org 198.51.100.23"), (2, "nothing"), (3, ""), (4, None)], "id INT, text STRING")
    rows = scan(df, "text", ["id"]).rows
    counts = {(r["id"], r["category"]): (r["n_values"], r["n_matches"]) for r in reports.document_category_counts(rows, ["id"]).collect()}
    assert len(counts) == 32 and {k: v for k, v in counts.items() if v != (0, 0)} == {(1, "email"): (5, 6), (1, "ip"): (1, 1)}
    total = {r["category"]: (r["n_values"], r["n_matches"]) for r in reports.table_category_counts(rows).collect()}
    assert len(total) == 8 and total["email"] == (5, 6) and total["ip"] == (1, 1) and total["card"] == (0, 0)
    nothing = scan(df.where("id > 9"), "text", ["id"]).rows
    assert {(r["n_values"], r["n_matches"]) for r in reports.table_category_counts(nothing).collect()} == {(0, 0)}
    assert reports.document_top_values(nothing, ["id"]).count() == 0
    top = sorted(tuple(r) for r in reports.document_top_values(rows, ["id"], 4).collect())
    assert top == [(1, "email", i + 1, f"EMAIL_{i + 1}", f"u{i}@x.org", "email", 2 if i == 3 else 1, 1) for i in range(4)] + [
        (1, "ip", 1, "IP_1", "198.51.100.23", "ip", 1, 0)
    ]


def test_a_value_of_two_categories_counts_where_it_is_first(spark):
    schema = "id INT, _spans ARRAY<STRUCT<start INT, end INT, category STRING, label STRING, rule STRING, value STRING, placeholder STRING>>"
    spans = [(0, 1, "keys", "K", "r1", "v", "K_1"), (3, 4, "email", "E", "r2", "w", "E_1"), (5, 6, "passwords", "K", "r3", "v", "K_1")]
    rows = spark.createDataFrame([(1, spans)], schema)
    found = rows.select("id", F.inline("_spans"))
    by_row = {(r["category"], r["n_values"], r["n_matches"]) for r in reports.table_category_counts(rows).collect()}
    assert by_row == {(r["category"], r["n_values"], r["n_matches"]) for r in reports.category_counts(found, ["id"]).collect()}
    assert ("keys", 1, 2) in by_row and ("passwords", 0, 0) in by_row


def test_audits(spark):
    df = spark.createDataFrame([(1, "a@x.org keep me"), (2, "plain")], "id INT, text STRING")
    result = scan(df, "text", ["id"])
    wanted = spark.createDataFrame([(1, "hide", "a@x.org"), (1, "keep", "keep me"), (2, "hide", "plain"), (2, "keep", "gone")], "id INT, must STRING, value STRING")
    broken = {(r["id"], r["must"]) for r in audits.leak_audit(result.masked, wanted, ["id"]).collect()}
    assert broken == {(2, "hide"), (2, "keep")}
    assert all(r["same"] for r in audits.roundtrip_audit(df, result.masked, result.map, ["id"], "id").collect())
    assert all(r["same"] for r in audits.roundtrip_in_rows(result).collect())


def test_known_misses_stay(spark):
    """Encoded emails, dotted phones and cards, Redis URLs without a user, escaped JSON, plain prose."""
    texts = [
        "jane%40example.com", "call 415.555.0132", "card 4242.4242.4242.4242", "redis://:hunter2secret@cache:6379",
        "the password is hunter2secret",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    assert [r["masked"] for r in scan(df, "text", ["id"]).masked.orderBy("id").collect()] == texts


def test_entropy_and_sql_function(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("0123456789abcdef",), ("é\U0001f600",)], "s STRING")
    want = [0.0, 0.0, 2.0, 4.0, 1.0]
    assert [r[0] for r in df.select(entropy("s")).collect()] == want
    spark.sql(ENTROPY_SQL)
    df.createOrReplaceTempView("strings")
    assert [r[0] for r in spark.sql("SELECT entropy(s) FROM strings").collect()] == want


def test_scan_plan_has_no_shuffle(spark, tmp_path):
    spark.range(200).selectExpr("id", "concat('mail u', id, '@example.com') AS text").write.parquet(str(tmp_path / "t"))
    df = documents.read_documents(spark, str(tmp_path / "t"), ["id"])
    result = scan(df, "text", ["id"])
    for table in (result.masked, result.findings, result.map, result.segments):
        plan = table._jdf.queryExecution().executedPlan().toString()
        nodes = [line.strip(" :+-*()0123456789").split(" ")[0] for line in plan.splitlines()]
        assert not {n for n in nodes if "Exchange" in n or "Python" in n or "Sort" in n}
    assert result.findings.count() == 200
