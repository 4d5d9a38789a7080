"""``key = value`` pairs: named secrets and values of high entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions import patterns as P
from veilspark.functions.text import find_all
from veilspark.operators.candidates import SEQ, candidate

def _has_operator(text: Column) -> Column:
    return text.contains("=") | text.contains(":")


def pairs(text: Column) -> Column:
    """All pairs as ``array<struct<key, value, start, end, next_char, form>>``.

    Three forms: a whole line ``[export] key = value`` or ``key: value``, a JSON
    string member, and an inline ``key=value``. Pairs inside the value of a whole
    line are found as well.
    """

    def row(m: Column) -> Column:
        match = m["match"]
        whole, member = m["line_value"] != "", match.startswith('"')
        key = F.when(member, F.regexp_extract(match, P.MEMBER, 1)).otherwise(
            F.regexp_extract(match, P.ASSIGNED_KEY, 1)
        )
        value = (
            F.when(whole, m["line_value"])
            .when(member, F.regexp_extract(match, P.MEMBER, 2))
            .otherwise(
                F.concat(F.regexp_extract(match, P.PAIR_VALUE, 2), F.regexp_extract(match, P.PAIR_VALUE, 3))
            )
        )
        quoted = F.regexp_extract(match, P.PAIR_VALUE, 1) != ""
        end = (
            F.when(whole, m["end"] + F.length(value)).when(member | quoted, m["end"] - 1).otherwise(m["end"])
        )
        return F.struct(
            key.alias("key"),
            value.alias("value"),
            (end - F.length(value)).alias("start"),
            end.alias("end"),
            F.when(whole | member | quoted, F.lit("")).otherwise(m["after"]).alias("next_char"),
            F.when(whole, F.lit("line")).when(member, F.lit("json")).otherwise(F.lit("inline")).alias("form"),
        )

    found = F.filter(F.transform(find_all(text, P.ASSIGNMENT, {"line_value": 1}), row), lambda p: p["value"] != "")
    return F.when(_has_operator(text), found)


def is_named_secret(p: Column) -> Column:
    """A secret name with at least four characters; short numbers only for passwords."""
    return (
        checks.is_secret_name(p["key"])
        & (F.length(p["value"]) >= 4)
        & (checks.is_password_name(p["key"]) | ~p["value"].rlike(r"\A[0-9]{1,8}\z"))
    )


def is_opaque(p: Column) -> Column:
    """A value of high entropy under a name that is neither secret nor an identifier."""
    return (
        ~checks.is_secret_name(p["key"])
        & ~checks.is_identifier_name(p["key"])
        & checks.is_high_entropy(p["value"])
    )


def is_literal(p: Column) -> Column:
    """A real value rather than a template, a constant or code."""
    return checks.is_plain_value(p["value"]) & ~checks.is_code(p["value"], p["next_char"])


def assigned(text: Column, passwords: bool = True, keys: bool = True) -> Column:
    """Candidates of the enabled categories, in text order."""

    def keep(p: Column) -> Column:
        hit = F.lit(False)
        if passwords:
            hit = hit | is_named_secret(p)
        if keys:
            hit = hit | is_opaque(p)
        return is_literal(p) & hit

    def row(p: Column) -> Column:
        named = checks.is_secret_name(p["key"])
        return candidate(
            p["value"], p["start"], p["end"],
            F.when(named, F.lit("passwords")).otherwise(F.lit("keys")),
            F.when(named & checks.is_password_name(p["key"]), F.lit("PASSWORD")).otherwise(F.lit("SECRET")),
            F.when(named, F.lit(3)).otherwise(F.lit(1)),
            F.when(named, F.lit("env-secret")).otherwise(F.lit("high-entropy")),
            SEQ["assignment"],
        )

    return F.when(_has_operator(text) & text.rlike(P.ASSIGNMENT_GATE), F.transform(F.filter(pairs(text), keep), row))
