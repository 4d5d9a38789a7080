"""Counts and review lists over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, positions
from veilspark.functions.patterns import CATEGORIES
from veilspark.functions.text import counted, size_text

# Singular and plural of every category, and the limits of a large text.
NOUNS = {
    "keys": ("API key", "API keys"),
    "privateKeys": ("private key", "private keys"),
    "passwords": ("password or secret", "passwords and secrets"),
    "email": ("email", "emails"),
    "ip": ("IP address", "IP addresses"),
    "card": ("card number", "card numbers"),
    "iban": ("IBAN", "IBANs"),
    "phone": ("phone number", "phone numbers"),
}
BIG_CHARS = 300 * 1024
BIG_LINES = 5000
ROWS_PER_CATEGORY = 200


def categories_table(spark: SparkSession) -> DataFrame:
    """The eight categories in display order."""
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "position INT, category STRING")


def line_count(text: Column) -> Column:
    """Line feeds plus one; an empty text has no line."""
    return F.when(text == "", F.lit(0)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    )


def document_stats(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    t = F.col(text)
    size = F.octet_length(t)
    return df.select(
        *ids,
        line_count(t).alias("n_lines"),
        size.alias("n_bytes"),
        counted(line_count(t), "line", "lines").alias("lines_text"),
        size_text(size).alias("size_text"),
    )


def is_big(text: Column) -> Column:
    """Over 300 KB of characters or over 5,000 lines."""
    return (F.length(text) > BIG_CHARS) | ((F.length(text) > BIG_LINES) & (line_count(text) > BIG_LINES))


def placeholder_hits(findings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Occurrences of every placeholder; category and rule come from the first one."""
    return findings.groupBy(*ids, "placeholder").agg(
        F.count("*").alias("n_hits"),
        F.min("start").alias("first_start"),
        F.min_by("category", "start").alias("category"),
        F.min_by("rule", "start").alias("rule"),
    )


def category_counts(findings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Unique values and matches per category over the whole table, zero-filled.

    Placeholders are counted once per document first, so the second aggregation
    only adds numbers and its eight groups are combined before the shuffle.
    """
    hits = placeholder_hits(findings, ids)
    totals = hits.groupBy("category").agg(
        F.count("*").alias("n_values"), F.sum("n_hits").alias("n_matches")
    )
    return (
        categories_table(findings.sparkSession)
        .join(totals, "category", "left")
        .select(
            "position",
            "category",
            F.coalesce("n_values", F.lit(0)).alias("n_values"),
            F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        )
    )


def counts_by(findings: DataFrame, ids: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Unique values and matches per category and every roll-up of ``by``."""
    hits = placeholder_hits(findings, [*dict.fromkeys([*ids, *by])])
    return hits.rollup("category", *by).agg(
        F.count("*").alias("n_values"), F.sum("n_hits").alias("n_matches")
    )


def unique_per_category(spans: Column) -> Column:
    """``array<struct<category, n>>`` in display order, from the named spans of one row."""
    def firsts(s: Column) -> Column:
        return F.transform(
            F.array(*[F.lit(c) for c in CATEGORIES]),
            lambda c: F.struct(
                c.alias("category"), F.size(F.filter(s, lambda x: x["category"] == c)).alias("n")
            ),
        )

    # a placeholder counts where it appears first
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda x, i: F.struct(
                x["placeholder"].alias("placeholder"), i.alias("at"), x["category"].alias("category")
            ),
        )
    )
    return let(
        let(
            ordered,
            lambda o: F.filter(
                o, lambda x, i: (i == 0) | (F.get(o, i - 1)["placeholder"] != x["placeholder"])
            ),
        ),
        firsts,
    )


def values_of(spans: Column) -> Column:
    """The distinct values of one row in first-seen order, from its named spans.

    ``array<struct<at, category, placeholder, rule, value, n_hits>>``; category and rule come from the first use.
    Two sorts, so n log n in the number of spans. No spans give an empty array.
    """
    fields = ("category", "placeholder", "rule", "value")
    # only names and places are sorted: what a sort holds is copied
    ordered = F.sort_array(
        F.transform(spans, lambda x, i: F.struct(x["placeholder"].alias("name"), i.alias("at")))
    )

    def counted_runs(o: Column) -> Column:
        heads = positions(o, lambda i: (i == 0) | (F.get(o, i - 1)["name"] != F.get(o, i)["name"]))

        def one(h: Column, run: Column, begins: Column) -> Column:
            hits = F.coalesce(F.get(begins, run + 1), F.size(o)) - h
            return F.struct(F.get(o, h)["at"].alias("at"), hits.alias("n_hits"))

        def told(x: Column) -> Column:
            return let(
                F.get(spans, x["at"]),
                lambda first: F.struct(x["at"].alias("at"), *[first[f].alias(f) for f in fields], x["n_hits"].alias("n_hits")),
            )

        uses = let(heads, lambda begins: F.sort_array(F.transform(begins, lambda h, run: one(h, run, begins))))
        return F.transform(uses, told)

    none = "ARRAY<STRUCT<at INT, category STRING, placeholder STRING, rule STRING, value STRING, n_hits INT>>"
    return F.when(F.size(spans) > 0, let(ordered, counted_runs)).otherwise(F.array().cast(none))


def document_category_counts(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Unique values and matches of every text and category, zero-filled; counted in the row, without a shuffle."""

    def counts(values: Column) -> Column:
        def one(category: Column, position: Column) -> Column:
            hits = F.transform(F.filter(values, lambda v: v["category"] == category), lambda v: v["n_hits"])
            return let(
                hits,
                lambda h: F.struct(
                    position.alias("position"),
                    category.alias("category"),
                    F.size(h).cast("bigint").alias("n_values"),
                    F.aggregate(h, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("n_matches"),
                ),
            )

        return F.transform(F.array(*[F.lit(c) for c in CATEGORIES]), one)

    return rows.select(*ids, F.explode(let(values_of(F.col("_spans")), counts)).alias("_c")).select(*ids, "_c.*")


def table_category_counts(rows: DataFrame) -> DataFrame:
    """The same over the whole table: a task shuffles eight sums. An empty table has its eight zeros too."""
    totals = document_category_counts(rows, []).groupBy("category").agg(
        F.sum("n_values").alias("n_values"), F.sum("n_matches").alias("n_matches")
    )
    return categories_table(rows.sparkSession).join(totals, "category", "left").select(
        "position", "category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_values", "n_matches")]
    )


def document_top_values(rows: DataFrame, ids: Sequence[str], limit: int = ROWS_PER_CATEGORY) -> DataFrame:
    """The review list of every text: the first ``limit`` values of a category as they appear, and how many more.

    ``(ids, category, place, placeholder, preview, rule, n_hits, n_more)``; in the row, without a shuffle.
    """

    def lists(values: Column) -> Column:
        def one(category: Column) -> Column:
            def placed(own: Column) -> Column:
                return F.transform(
                    F.slice(own, 1, limit),
                    lambda v, i: F.struct(
                        category.alias("category"),
                        (i + 1).alias("place"),
                        v["placeholder"].alias("placeholder"),
                        preview(v["value"]).alias("preview"),
                        v["rule"].alias("rule"),
                        v["n_hits"].alias("n_hits"),
                        F.greatest(F.size(own) - limit, F.lit(0)).alias("n_more"),
                    ),
                )

            return let(F.filter(values, lambda v: v["category"] == category), placed)

        return F.flatten(F.transform(F.array(*[F.lit(c) for c in CATEGORIES]), one))

    listed = rows.select(*ids, F.explode_outer(let(values_of(F.col("_spans")), lists)).alias("_v"))
    return listed.where(F.col("_v").isNotNull()).select(*ids, "_v.*")


def _of_found(rows: DataFrame, ids: Sequence[str], values: Column) -> DataFrame:
    """``values`` of the documents with findings.

    A plain filter on the spans would be pushed below the scan and evaluate it
    twice; an exploded array of no or one element is not.
    """
    one = F.when(F.size("_spans") > 0, F.array(values))
    return rows.select(*ids, F.explode_outer(one).alias("_v")).where(F.col("_v").isNotNull()).select(*ids, "_v.*")


def scan_totals(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Unique values and matches of every document that has any; no shuffle."""
    return _of_found(
        rows,
        ids,
        F.struct(
            F.size(F.array_distinct(F.transform("_spans", lambda s: s["placeholder"]))).alias("n_values"),
            F.size("_spans").alias("n_matches"),
        ),
    )


def share_summary(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A sentence part such as ``2 API keys, 1 email and 3 IP addresses``; counts only."""

    def phrase(x: Column) -> Column:
        noun = F.lit("")
        for category, (one, many) in NOUNS.items():
            noun = F.when(
                x["category"] == category, F.when(x["n"] == 1, F.lit(one)).otherwise(F.lit(many))
            ).otherwise(noun)
        return F.concat(x["n"].cast("string"), F.lit(" "), noun)

    def joined(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(n < 2, F.array_join(parts, "")).otherwise(
            F.concat(
                F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(parts, n - 1)
            )
        )

    parts = F.transform(
        F.filter(unique_per_category(F.col("_spans")), lambda x: x["n"] > 0), phrase
    )
    return _of_found(rows, ids, F.struct(let(parts, joined).alias("summary")))


def preview(value: Column) -> Column:
    """First line, cut to 64 characters; `` ...`` marks further lines."""
    first = F.substring_index(value, "\n", 1)
    more = F.when(F.contains(value, F.lit("\n")), F.lit(" ...")).otherwise(F.lit(""))
    return F.when(F.length(first) > 64, F.concat(F.substr(first, F.lit(1), F.lit(61)), F.lit("..."))).otherwise(
        F.concat(first, more)
    )


def finding_rows(findings: DataFrame, mapping: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Review rows from stored tables: placeholder, preview of the value, hits, rule."""
    hits = placeholder_hits(findings, ids)
    return hits.join(mapping, [*ids, "placeholder"]).select(
        *ids, "category", "placeholder", preview(F.col("value")).alias("preview"), "n_hits", "rule"
    )


def review_rows(occurrences: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The same rows straight from a scan, whose occurrences carry the values: one pass, no join."""
    return occurrences.groupBy(*ids, "placeholder").agg(
        F.count("*").alias("n_hits"),
        F.min_by("category", "start").alias("category"),
        F.min_by("rule", "start").alias("rule"),
        F.first("value").alias("value"),
    ).select(*ids, "category", "placeholder", preview(F.col("value")).alias("preview"), "n_hits", "rule")


def top_rows(rows: DataFrame, order: Sequence[Column], limit: int = ROWS_PER_CATEGORY) -> DataFrame:
    """The first rows of every category and how many more there are.

    The rank filter cuts every task to ``limit`` rows per category before the
    shuffle, which Spark does up to a limit of its own; a higher one is refused.
    The remainder comes from a count that is combined the same way. ``rows`` is
    read twice: take it from ``ScanResult.kept``.
    """
    bound = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if limit > bound:
        raise ValueError(f"at most {bound} rows of a category")
    ranked = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy("category").orderBy(*order))
    ).where(F.col("place") <= limit)
    totals = rows.groupBy("category").agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(totals), "category").select(
        *ranked.columns, F.greatest(F.col("_n") - limit, F.lit(0)).alias("n_more")
    )
