"""The keyword join: which rules are worth trying on which line."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.secrets import keyword_pattern
from veilspark.sources.rules import Catalogue


def keywords_in(low: Column, words: Sequence[str]) -> Column:
    """Distinct words that occur in a lower-cased text, found in one regex pass."""
    known = sorted(set(words))
    # the longest word at a position stands for the shorter ones it begins with
    shorter = {w: [k for k in known if w.startswith(k)] for w in known}
    table = F.from_json(F.lit(json.dumps(shorter)), "MAP<STRING, ARRAY<STRING>>")
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(keyword_pattern(known)), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(table, w))))


def line_keywords(lines: DataFrame, ids: Sequence[str], catalogue: Catalogue | None = None) -> DataFrame:
    """``(ids, keyword)``: the catalogue keywords of every line."""
    rules = catalogue or Catalogue()
    found = keywords_in(F.lower("line"), [k for r in rules.line_rules for k in r.keywords])
    return lines.select(*ids, F.explode_outer(found).alias("keyword")).where(F.col("keyword").isNotNull())


def keyword_candidates(lines: DataFrame, ids: Sequence[str], catalogue: Catalogue | None = None) -> DataFrame:
    """``(ids, rule_id)``: each rule once per line that holds one of its keywords.

    Keywords are turned into rules inside the row by a table of the catalogue's size: no join, no shuffle.
    """
    rules = catalogue or Catalogue()
    rules_of: dict[str, list[str]] = {}
    for rule in rules.line_rules:
        for keyword in rule.keywords:
            rules_of.setdefault(keyword, []).append(rule.id)
    table = F.from_json(F.lit(json.dumps(rules_of)), "MAP<STRING, ARRAY<STRING>>")
    found = F.transform(keywords_in(F.lower("line"), list(rules_of)), lambda w: F.element_at(table, w))
    return lines.select(*ids, F.explode_outer(F.array_distinct(F.flatten(found))).alias("rule_id")).where(
        F.col("rule_id").isNotNull()
    )
