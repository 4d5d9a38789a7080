"""The row shape every detector produces, and the helpers to build it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.functions.text import chunked, cut, quoted, widen

CANDIDATE = "struct<start:int,end:int,category:string,label:string,tier:int,rule:string,seq:int>"

# Insertion order of the detectors after the rules; it breaks ties between equal spans.
SEQ = {
    "assignment": 1000,
    "auth_header": 1001,
    "url_login": 1002,
    "email": 1003,
    "ipv4": 1004,
    "ipv6": 1005,
    "card": 1006,
    "iban": 1007,
    "phone": 1008,
}


def none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def candidate(
    value: Column,
    start: Column,
    end: Column,
    category: Column | str,
    label: Column | str,
    tier: Column | int,
    rule: Column | str,
    seq: Column | int,
) -> Column:
    """One candidate; a pair of quotes around the value stays outside the span."""

    def col(x: Column | str | int) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    def at(first: Column, last: Column) -> Column:
        return F.struct(
            first.alias("start"),
            last.alias("end"),
            col(category).alias("category"),
            col(label).alias("label"),
            col(tier).cast("int").alias("tier"),
            col(rule).alias("rule"),
            col(seq).cast("int").alias("seq"),
        )

    return F.when(quoted(value), at(start + 1, end - 1)).otherwise(at(start, end))


def gather(parts: list[Column]) -> Column:
    """Union of the detectors' arrays; a detector without a match gives null."""
    return F.concat(none(), *[F.coalesce(p.cast(f"array<{CANDIDATE}>"), none()) for p in parts])


def widened(text: Column, found: Column) -> Column:
    """Grow every candidate to ASCII word boundaries.

    Most have no word character beside them and stay as they are: one look tells. A blank on both sides of the text
    spares the questions for its ends.
    """

    def grow(chunks: Column) -> Column:
        def one(c: Column) -> Column:
            longer = let(
                widen(chunks, F.length(text) + 2, c["start"] + 1, c["end"] + 1),
                lambda w: F.struct(
                    (w["start"] - 1).alias("start"),
                    (w["end"] - 1).alias("end"),
                    *[c[f].alias(f) for f in ("category", "label", "tier", "rule", "seq")],
                ),
            )
            return F.when(cut(chunks, c["start"], c["end"] + 2).rlike(r"\A(?:\w|(?s:.*+)(?<=\w))"), longer).otherwise(c)

        return F.transform(found, one)

    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.when(F.size(found) > 0, let(chunked(padded), grow)).otherwise(none())
