"""Emails, IP addresses, card numbers, IBANs and phone numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions import patterns as P
from veilspark.functions.text import find_all
from veilspark.operators.candidates import SEQ, candidate


def _detector(
    text: Column,
    pattern: str,
    category: str,
    label: str,
    seq: int,
    valid: Callable[[Column], Column],
    gate: Column,
) -> Column:
    found = F.transform(
        find_all(text, pattern, keep=lambda m: ~checks.is_placeholder(m["match"]) & valid(m)),
        lambda m: candidate(m["match"], m["start"], m["end"], category, label, 2, category, seq),
    )
    return F.when(gate, found)


def emails(text: Column) -> Column:
    return _detector(
        text, P.EMAIL, "email", "EMAIL", SEQ["email"],
        lambda m: checks.email_valid(m["match"], m["before"]),
        text.contains("@"),
    )


def ipv4(text: Column) -> Column:
    return _detector(
        text, P.IPV4, "ip", "IP", SEQ["ipv4"], lambda m: checks.ipv4_public(m["match"], m["before"]),
        text.rlike(P.IPV4_GATE),
    )


def ipv6(text: Column) -> Column:
    return _detector(
        text, P.IPV6, "ip", "IP", SEQ["ipv6"], lambda m: checks.ipv6_valid(m["match"]),
        text.rlike(P.IPV6_GATE),
    )


def cards(text: Column) -> Column:
    return _detector(
        text, P.CARD, "card", "CARD", SEQ["card"], lambda m: checks.card_valid(m["match"]),
        text.rlike(P.CARD_GATE),
    )


def ibans(text: Column) -> Column:
    return _detector(
        text, P.IBAN, "iban", "IBAN", SEQ["iban"], lambda m: checks.iban_valid(m["match"]),
        text.rlike(P.IBAN_GATE),
    )


def phones(text: Column) -> Column:
    return _detector(
        text, P.PHONE, "phone", "PHONE", SEQ["phone"], lambda m: checks.phone_valid(m["match"]),
        text.rlike(P.PHONE_GATE),
    )
