"""One text for every rule of the catalogue, made from the grammar of its pattern.

The same SQL fragments build a text in Spark and the expected value in DuckDB: letters of a value
are taken from md5 digests of a row's key and moved into the alphabet that the pattern allows at that place. Of
alternatives the first is written, of repetitions the smallest number, but ``BODY`` characters of an open one.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass, field
from re import _parser as grammar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.sources.rules import Catalogue, Rule

#: Characters of a value whose pattern leaves the length open.
BODY = 20
#: Digests of a key behind one another; a value begins at a place of its rule's own and goes round.
DIGESTS = 12
POOL = " || ".join(f"md5(k || '~{i}')" for i in range(DIGESTS))
HEX = "0123456789abcdef"
_WORD = frozenset(string.ascii_letters + string.digits + "_")
_SETS = {
    "CATEGORY_WORD": _WORD, "CATEGORY_DIGIT": frozenset(string.digits), "CATEGORY_SPACE": frozenset(" \t\n"),
    "CATEGORY_NOT_WORD": frozenset(string.printable) - _WORD, "CATEGORY_NOT_SPACE": frozenset(string.printable) - frozenset(string.whitespace),
    "CATEGORY_NOT_DIGIT": frozenset(string.printable) - frozenset(string.digits),
}


@dataclass
class Sample:
    """A text before the value, the value and the text after it, each a list of texts and ``(alphabet, length)``."""

    parts: tuple[list, list, list] = field(default_factory=lambda: ([], [], []))
    at: int = 0

    def add(self, piece: str | tuple[str, int]) -> None:
        self.parts[self.at].append(piece)


def _members(items: list, alone: bool = False) -> str:
    """Characters of a class, letters and digits if it has some; ``alone``: the class is not repeated."""
    found: set[str] = set()
    negated = False
    for kind, value in items:
        name = str(kind)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            found.add(chr(value))
        elif name == "RANGE":
            found |= {chr(c) for c in range(value[0], min(value[1], 126) + 1)}
        elif name == "CATEGORY":
            found |= _SETS[str(value)]
    if negated:
        found = set(string.printable) - found
        if alone and "." in found:  # all but a few: a dot, which hosts need
            return "."
    plain = sorted(c for c in found if c in string.ascii_letters + string.digits)
    return "".join(plain or sorted(found, key=lambda c: (c != " ", c)))


def _write(tree, sample: Sample) -> None:
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            sample.add(chr(value))
        elif name in ("ANY", "NOT_LITERAL"):
            sample.add("x")
        elif name == "IN":
            known = _members(value, alone=True)
            sample.add((known, 1) if sample.at == 1 and len(known) > 1 else known[0])
        elif name == "BRANCH":
            _write(value[1][0], sample)
        elif name == "SUBPATTERN":
            inside = value[0] == 2
            sample.at = 1 if inside else sample.at
            _write(value[3], sample)
            sample.at = 2 if inside else sample.at
        elif name == "ATOMIC_GROUP":
            _write(value, sample)
        elif name.endswith("_REPEAT"):
            low, high, what = value
            one = list(what)
            if len(one) == 1 and str(one[0][0]) == "NOT_LITERAL":  # a class of all but one
                one = [("IN", [("NEGATE", None), ("LITERAL", one[0][1])])]
            single = len(one) == 1 and str(one[0][0]) == "IN"
            if sample.at != 1 and single and low == 0 and high >= 100 and _members(one[0][1]).isalnum():  # anything may stand between two words
                sample.add("\n")
            elif sample.at == 1 and single and low > 0 and high > 1:
                length = int(low) if low == high or low >= BODY else min(BODY, int(high))
                sample.add((_members(one[0][1]), length))
            else:
                for _ in range(int(low)):
                    _write(what, sample)


def sample(rule: Rule) -> Sample:
    made = Sample()
    _write(grammar.parse(rule.pattern.replace(r"\z", r"\Z")), made)
    return made


def pieces(parts: list, place: int) -> list[tuple[str, int, int]]:
    """Of a list of parts ``(text, 0, 0)`` or ``(letters for the 16 digits, place in the digests, length)``."""
    out: list[tuple[str, int, int]] = []
    for part in parts:
        if isinstance(part, str):
            if out and not out[-1][2]:
                out[-1] = (out[-1][0] + part, 0, 0)
            else:
                out.append((part, 0, 0))
            continue
        known, length = part
        halves = (known[:16], known[-16:]) if len(known) > 16 else (known,)
        while length > 0:  # runs of both halves of a large alphabet in turn
            for half in halves[: max(1, length)]:
                n = min(8, length)
                if n:
                    place = 1 + (place + 11) % (32 * DIGESTS - 8)
                    out.append(((half * 16)[:16], place, n))
                    length -= n
    return out


@dataclass(frozen=True)
class RuleText:
    rule: Rule
    before: list[tuple[str, int, int]]
    value: list[tuple[str, int, int]]
    after: list[tuple[str, int, int]]


def rule_texts(catalogue: Catalogue | None = None) -> list[RuleText]:
    """For every rule the pieces of its text."""
    texts = []
    for i, rule in enumerate((catalogue or Catalogue()).rules):
        before, value, after = sample(rule).parts
        if value and isinstance(value[0], str) and value[0] == value[-1] == '"':  # quotes stay outside of a finding
            before, value, after = [*before, '"'], value[1:-1], ['"', *after]
        fixed = "".join(x if isinstance(x, str) else "\0" for x in [*before, *value, *after]).lower()
        named = "" if any(k in fixed for k in rule.keywords) else f"{rule.keywords[0]} "
        texts.append(RuleText(rule, pieces([f"see {named}", *before], i), pieces(value, 13 * i), pieces([*after, " end"], i)))
    return texts


def texts_sql(table: str, key: str) -> str:
    """DuckDB: ``(key, rule_id, start, made, value, least)`` of the texts of all rules for every row of a table.

    A finding grows to the end of a word that its value does not end.
    """

    def text(char: str) -> str:
        return "'" + char.replace("'", "''") + "'"

    def listed(found: list[tuple[str, int, int]]) -> str:
        return "[" + ", ".join(f"{{'x': {text(x)}, 'at': {at}, 'n': {n}}}" for x, at, n in found) + "]"

    def joined(column: str) -> str:
        moved = f"CASE WHEN p.n = 0 THEN p.x ELSE translate(substr(pool, p.at, p.n), '{HEX}', p.x) END"
        return f"array_to_string(list_transform({column}, lambda p: {moved}), '')"

    rows = ", ".join(f"('{t.rule.id}', {listed(t.before)}, {listed(t.value)}, {listed(t.after)}, {float(t.rule.entropy or -1)})" for t in rule_texts())
    return f"""WITH pools AS (SELECT {key}, {POOL} AS pool FROM (SELECT {key}, CAST({key} AS STRING) AS k FROM {table})),
      rules (rule_id, before, made, behind, least) AS MATERIALIZED (VALUES {rows}),
      texts AS MATERIALIZED (SELECT {key}, rule_id, {joined("before")} AS b, {joined("made")} AS made, {joined("behind")} AS a, least FROM pools, rules),
      shapes AS (SELECT {key}, rule_id, length(b) AS start, made, made || regexp_extract(a, '^[A-Za-z0-9_]*') AS value, least FROM texts)"""


def texts_of(df: DataFrame, key: str) -> DataFrame:
    """``(key, rule_id, text)``: the texts of all rules for every row."""
    known = [{"rule_id": t.rule.id, "p": [{"x": x, "at": at, "n": n} for x, at, n in [*t.before, *t.value, *t.after]]} for t in rule_texts()]
    rules = F.from_json(F.lit(json.dumps(known)), "array<struct<rule_id:string,p:array<struct<x:string,at:int,n:int>>>>")
    pools = df.select(key, F.col(key).cast("string").alias("k")).select(key, F.expr(POOL).alias("pool"))
    rows = pools.select(key, "pool", F.explode(rules).alias("r"))

    def moved(p: Column) -> Column:
        return F.when(p["n"] == 0, p["x"]).otherwise(F.call_function("translate", F.substr("pool", p["at"], p["n"]), F.lit(HEX), p["x"]))

    return rows.select(key, "r.rule_id", F.array_join(F.transform("r.p", moved), "").alias("text"))
