"""Rebuild texts around named spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.functions.text import chunked, cut


def with_values(text: Column, spans: Column) -> Column:
    """Add the covered text to every span."""
    return F.when(
        F.size(spans) > 0,
        let(
            chunked(text),
            lambda chunks: F.transform(
                spans,
                lambda s: F.struct(
                    *[s[f].alias(f) for f in ("start", "end", "category", "label", "tier", "rule")],
                    cut(chunks, s["start"], s["end"]).alias("value"),
                ),
            ),
        ),
    )


def segments(text: Column, named_spans: Column) -> Column:
    """Alternating plain and masked parts: ``array<struct<original, shown, placeholder>>``.

    ``placeholder`` is null for a plain part. Empty plain parts are left out.
    """

    def build(chunks: Column) -> Column:
        def pieces(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(named_spans, i - 1)["end"]).otherwise(F.lit(0))
            plain = cut(chunks, begin, s["start"])
            return F.array(
                F.struct(plain.alias("original"), plain.alias("shown"), F.lit(None).cast("string").alias("placeholder")),
                F.struct(
                    s["value"].alias("original"),
                    s["placeholder"].alias("shown"),
                    s["placeholder"].alias("placeholder"),
                ),
            )

        last = F.get(named_spans, F.size(named_spans) - 1)["end"]
        tail = cut(chunks, last, F.length(text))
        rows = F.concat(
            F.flatten(F.transform(named_spans, pieces)),
            F.array(
                F.struct(tail.alias("original"), tail.alias("shown"), F.lit(None).cast("string").alias("placeholder"))
            ),
        )
        return F.filter(rows, lambda r: r["original"] != "")

    whole = F.filter(
        F.array(F.struct(text.alias("original"), text.alias("shown"), F.lit(None).cast("string").alias("placeholder"))),
        lambda r: r["original"] != "",
    )
    return F.when(F.coalesce(F.size(named_spans), F.lit(0)) > 0, let(chunked(text), build)).otherwise(whole)


def masked(text: Column, named_spans: Column) -> Column:
    """The text with every span replaced by its placeholder."""
    return F.when(
        F.coalesce(F.size(named_spans), F.lit(0)) > 0,
        F.array_join(F.transform(segments(text, named_spans), lambda p: p["shown"]), ""),
    ).otherwise(text)
