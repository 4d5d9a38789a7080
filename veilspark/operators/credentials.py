"""Tokens in authorization headers and passwords in addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions import patterns as P
from veilspark.functions.text import entropy, find_all
from veilspark.operators.candidates import SEQ, candidate


def auth_headers(text: Column) -> Column:
    """``Authorization: Bearer|Basic|Token <value>`` and a bare ``Bearer <value>``."""
    found = find_all(
        text,
        P.AUTH_HEADER,
        {"prefix": 1, "scheme": 2, "value": 4},
        keep=lambda m: ~checks.is_placeholder(m["value"]) & (entropy(m["value"]) > 3),
    )

    def row(m: Column) -> Column:
        label = F.when(F.lower(m["scheme"]) == "basic", F.lit("BASIC_AUTH")).otherwise(F.lit("BEARER_TOKEN"))
        start = m["start"] + F.length(m["prefix"])
        return candidate(
            m["value"], start, start + F.length(m["value"]), "keys", label, 3, F.lower(label), SEQ["auth_header"]
        )

    return F.when(text.rlike(P.AUTH_GATE), F.transform(found, row))


def url_logins(text: Column) -> Column:
    """The password of ``scheme://user:password@``."""
    found = find_all(
        text,
        P.URL_LOGIN,
        {"prefix": 1, "scheme": 2, "value": 3},
        keep=lambda m: ~checks.is_placeholder(m["value"]),
    )

    def row(m: Column) -> Column:
        label = F.when(m["scheme"].rlike(P.DATABASE_SCHEME), F.lit("DB_PASSWORD")).otherwise(F.lit("PASSWORD"))
        start = m["start"] + F.length(m["prefix"])
        return candidate(
            m["value"], start, start + F.length(m["value"]), "passwords", label, 3, F.lower(label), SEQ["url_login"]
        )

    return F.when(text.contains("://"), F.transform(found, row))
