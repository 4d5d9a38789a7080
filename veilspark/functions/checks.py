"""Checksums and predicates that decide whether a match is a real value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.arrays import let
from veilspark.functions.text import contains_any, digits, entropy


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def card_valid(value: Column) -> Column:
    return let(
        digits(value),
        lambda d: d.rlike(P.CARD_ISSUER)
        & (F.length(d) >= 13)
        & ~d.rlike(r"\A(\d)\1+\z")
        & luhn(d),
    )


def mod97(value: Column) -> Column:
    """Remainder by 97 of a string of digits and letters; letters stand for 10 to 35."""
    return F.aggregate(
        F.split(value, ""),
        F.lit(0),
        lambda r, c: F.when(c.rlike(r"\A[A-Z]\z"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(
            (r * 10 + F.ascii(c) - 48) % 97
        ),
    )


def iban_valid(value: Column) -> Column:
    """Length 15 to 34 without blanks, and ISO 13616 remainder 1."""
    return let(
        F.replace(value, F.lit(" "), F.lit("")),
        lambda s: F.length(s).between(15, 34)
        & (
            mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4))))
            == 1
        ),
    )


def ipv6_valid(value: Column) -> Column:
    """Eight groups, or at most seven around one ``::``; three groups and a digit at least."""

    def check(halves: Column) -> Column:
        groups = F.filter(
            F.flatten(F.transform(halves, lambda h: F.split(h, ":"))), lambda g: g != ""
        )
        no_gap = F.forall(
            halves, lambda h: (h == "") | ~h.rlike(r"\A:|:\z|::")
        )
        return let(
            groups,
            lambda g: (F.size(halves) <= 2)
            & no_gap
            & F.forall(g, lambda x: x.rlike(r"(?i)\A[0-9a-f]{1,4}\z"))
            & F.when(F.size(halves) == 1, F.size(g) == 8).otherwise(F.size(g) <= 7)
            & (F.size(g) >= 3),
        )

    return value.rlike(r"[0-9]") & let(F.split(value, "::", -1), check)


def ipv4_public(value: Column, before: Column) -> Column:
    """Not loopback, unspecified or broadcast, and not right after the word version."""
    return ~value.rlike(P.IPV4_NO_INFORMATION) & ~F.right(before, F.lit(12)).rlike(P.IPV4_IS_VERSION)


def email_valid(value: Column, before: Column) -> Column:
    """Not a file name such as icon@2x.png, and not the login part of a URL."""
    return ~value.rlike(P.EMAIL_FILE_ENDING) & ~F.right(before, F.lit(200)).rlike(P.EMAIL_INSIDE_URL)


def phone_valid(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def is_placeholder(value: Column) -> Column:
    return value.rlike(P.IS_PLACEHOLDER)


def globally_allowed(value: Column) -> Column:
    """One search for the first pattern, which is not anchored, and one for all others, whose anchor is tested once."""
    first, *anchored = P.GLOBAL_ALLOW
    others = r"\A(?:" + "|".join(f"(?:{p.replace(r'\A', '', 1)})" for p in anchored) + ")"
    return value.rlike(P.GLOBAL_ALLOW_GATE) & (value.rlike(first) | value.rlike(others))


def has_global_stopword(value: Column) -> Column:
    return value.rlike(P.GLOBAL_STOPWORD_GATE) & contains_any(value, P.GLOBAL_STOPWORDS)


def is_secret_name(key: Column) -> Column:
    """A name such as DB_PASSWORD, apiKey or client-secret, unless it is public."""
    upper = F.upper(key)
    segments = F.split(key, P.NAME_SEGMENTS)
    return ~upper.rlike(P.PUBLIC_NAME) & (
        upper.rlike(P.SECRET_NAME)
        | (upper.rlike(P.SECRET_SEGMENT_GATE) & F.exists(segments, lambda s: F.upper(s).rlike(P.SECRET_SEGMENT)))
    )


def is_password_name(key: Column) -> Column:
    return key.rlike(r"(?i)PASS|PWD")


def is_identifier_name(key: Column) -> Column:
    return key.rlike(P.IDENTIFIER_NAME)


def is_plain_value(value: Column) -> Column:
    """A real value: no template, no mask, no constant, no allow-listed text."""
    return ~value.rlike(P.NOT_A_VALUE) & ~globally_allowed(value)


def is_code(value: Column, next_char: Column) -> Column:
    """A call, an index or a dotted name rather than a literal."""
    return (next_char == "(") | value.rlike(P.DOTTED_NAME) | value.rlike(P.CALL_OR_INDEX)


def is_high_entropy(value: Column) -> Column:
    return (
        F.length(value).between(20, 1000)
        & value.rlike(P.OPAQUE_VALUE)
        & value.rlike(r"[0-9]")
        & value.rlike(r"[A-Za-z]")
        & ~value.startswith("/")
        & ~value.rlike(P.HEX_ONLY)
        & ~value.rlike(P.DOTTED_NAME)
        & (entropy(value) >= 3.7)
    )
