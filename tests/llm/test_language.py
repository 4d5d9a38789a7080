from pyspark.sql import functions as F

from veilspark.llm import language

SF = "/root/testdata/sf0.1"


def test_evidence_of_all_kinds(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    samples = {r.lang: r.text for r in texts.where("length(text) between 400 and 800").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    rows = [(i, f"http://h{i % 3}.example.de/x/{i}", f"<html lang=de><body><p>{samples['de']}</p></body>") for i in range(60)]
    rows += [(100 + i, f"http://e.example.com/en/{i}", f"<html lang='en-GB'><p>{samples['en']}</p>") for i in range(60)]
    rows += [(200, "http://h1.example.de/x/1", ""), (201, "http://e.example.com/en/2", None), (202, None, f"<p>{samples['fr']}</p>"), (203, "no address", "<html lang=de>"),
             (204, "http://e.example.com/en/9", f"<html lang=en><p>{samples['es']}</p>"), (None, None, None), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language.identify(pages, texts).collect()}
    assert {got[i].lang for i in range(60)} == {"de"} and {got[100 + i].lang for i in range(60)} == {"en"}
    assert got[200].lang == "de" and got[201].lang == "en" and got[202].lang == "fr" and got[203].lang == "de"  # each without text or declaration
    assert got[204].lang == "es"  # a long text outweighs the rest
    assert got[100].declared == "en" and got[100].suffix == "en" and got[0].suffix == "de"
    assert language.identify(pages, texts).count() == len(rows)
    assert all(abs(sum(r.shares.values()) - 1) < 1e-6 and 0 < r.confidence <= 1 for r in got.values())
    assert language.identify(pages.limit(0), texts).count() == 0
    assert {r.lang for r in language.identify(pages, texts.limit(0)).collect()} == {None}


def test_many_languages_and_odd_columns(spark):
    """Each made language has words of its own; a map column is not read; copies of a text do not fill the sample."""
    def words(i, at):
        return " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + j) % 26)}{'xyz'[(at + j) % 3]}" for j in range(40))

    rows = [(i * 10 + at, words(i, at), f"l{i:02}", {"k": i}) for i in range(70) for at in range(3)] + [(9000 + i, words(0, 0), "l00", None) for i in range(300)]
    rows += [(None, words(1, 1), "l01", None), (9999, None, "l02", None), (9998, "words without a language", None, None), (9997, "long " * 60_000, "l69", None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string, odd map<string,int>")
    names, table = language.learn(texts)
    assert sorted(names) == [f"l{i:02}" for i in range(70)] and table.shape == (70, language.BUCKETS)
    pages = spark.createDataFrame([(i, None, f"<p>{words(i, 5)}</p>") for i in range(69)], "page_id long, url string, html string")
    got = {r.page_id: r.text_lang for r in language.identify(pages, texts).collect()}
    assert sum(got[i] == f"l{i:02}" for i in range(69)) >= 66


def test_held_out_texts(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    pages = texts.where(held).select("doc_id", F.lit("http://x.example/1").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.col("lang").alias("want"))
    got = language.identify(pages, texts.where(~held), keys=("doc_id",)).join(pages.select("doc_id", "want"), "doc_id").toPandas()
    long = got[got.doc_id.isin([r.doc_id for r in texts.where("n_chars > 60").select("doc_id").collect()])]
    assert (long.lang == long.want).mean() > 0.99
