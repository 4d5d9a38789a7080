"""Matching of the rule catalogue inside one text.

Three steps keep the cost of 221 expressions low:

1. keywords of texts with long lines are only looked up in the parts where a rule
   can match;
2. only the rules of the keywords that occur are tried, and a rule that stays on
   one line only on the lines that hold one of its keywords, found in one pass a line;
3. offsets and filters are computed for the matches.

Patterns are constants of the plan: a rule's number picks its expression by halving.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions.arrays import let, running_sum
from veilspark.functions.text import entropy, find_all
from veilspark.operators.candidates import candidate
from veilspark.sources.rules import AROUND_VALUE, NAME_REACH, TOKEN_RUN, Catalogue

#: Mean characters of a line up to which the rules of its keywords are tried without a look at their places.
SHORT_LINE = 128


def _hit(rule: Column, m: Column) -> Column:
    """The secret of a match, its position and the whole match."""
    start = m["start"] + F.length(m["prefix"])
    # the words joined to the front of a name count as part of the match
    lead = F.when(rule["with_lead"], F.regexp_extract(F.right(m["before"], F.lit(50)), r"[\w.-]*\z", 0))
    return F.struct(
        m["secret"].alias("value"),
        start.alias("start"),
        (start + F.length(m["secret"])).alias("end"),
        F.concat(F.coalesce(lead, F.lit("")), m["match"]).alias("match"),
    )


def by_rule(number: Column, cases: dict[int, Column], default: Column | None = None) -> Column:
    """The expression of the rule with this number, found by halving.

    Each rule has expressions of its own with constant patterns, so every pattern is compiled once a task. Without
    ``default`` the number is one of the cases.
    """
    known = sorted(cases)

    def half(part: list[int]) -> Column:
        if len(part) == 1:
            case = cases[part[0]]
            return case if default is None else F.when(number == part[0], case).otherwise(default)
        middle = len(part) // 2
        return F.when(number < part[middle], half(part[:middle])).otherwise(half(part[middle:]))

    if not known:
        raise ValueError("no rule")
    return half(known)


def rejected(line: Column, number: Column, rule: Column, hit: Column, rows: list[dict]) -> Column:
    """True when the entropy, the global list or the rule's own lists drop a hit; ``number`` counts in ``rows``."""
    value = hit["value"]
    own: dict[int, Column] = {}
    for i, row in enumerate(rows):
        tests = [
            F.coalesce(target.rlike(row[f"allow_{name}"]), F.lit(False))
            for name, target in (("secret", value), ("match", hit["match"]), ("line", line))
            if row[f"allow_{name}"]
        ]
        if row["stopwords"]:
            tests.append(F.lower(value).rlike(keyword_pattern(row["stopwords"])))
        if tests:
            own[i] = reduce(lambda a, b: a | b, tests)
    return (
        (value == "")
        | (by_rule(number, own, F.lit(False)) if own else F.lit(False))
        | checks.globally_allowed(value)
        | checks.has_global_stopword(value)
        | (rule["entropy"].isNotNull() & (entropy(value) <= rule["entropy"]))
    )


def rule_matches(line: Column, number: Column, rule: Column, rows: list[dict]) -> Column:
    """All matches of one rule, number ``number`` of ``rows``, in one line, with the position of the secret."""

    def guarded(row: dict) -> str:
        # most positions fail at this look, before a group is opened
        return rf"(?=[{row['begins']}])(?:{row['pattern']})" if row["begins"] else row["pattern"]

    def marked(template: Callable[[bool], str]) -> Column:
        return by_rule(
            number,
            {i: F.regexp_replace(line, F.lit(guarded(r)), F.lit(template(r["branches"] == 2))) for i, r in enumerate(rows)},
        )

    return F.transform(find_all(line, marked, {"prefix": 1, "secret": 2}), lambda m: _hit(rule, m))


def numbered_lines(text: Column) -> Column:
    """``array<struct<start, line>>`` of a text."""

    def placed(parts: Column) -> Column:
        ends = running_sum(F.transform(parts, lambda line: F.length(line) + 1))
        return F.transform(
            ends,
            lambda e, i: F.struct(
                (e - F.length(F.get(parts, i)) - 1).alias("start"),
                F.get(parts, i).alias("line"),
            ),
        )

    return let(F.split(text, "\n", -1), placed)


def keyword_pattern(words: list[str]) -> str:
    """A look-ahead that captures the longest keyword at a position.

    Words share their common beginnings. First letters are tested in groups, so
    most positions fail after a few comparisons.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def either(node: dict, group: int = 0) -> str:
        branches = [(c, re.escape(c) + tail(n)) for c, n in sorted(node.items()) if c]
        if len(branches) == 1:
            return branches[0][1]
        if not group or len(branches) <= group:
            return "(?:" + "|".join(b for _, b in branches) + ")"
        parts = [branches[i : i + group] for i in range(0, len(branches), group)]
        return "(?:" + "|".join(
            "(?=[" + "".join(re.escape(c) for c, _ in part) + "])(?:" + "|".join(b for _, b in part) + ")" for part in parts
        ) + ")"

    def tail(node: dict) -> str:
        if len(node) == 1 and "" in node:
            return ""
        body = either({c: n for c, n in node.items() if c})
        return f"(?:{body})?+" if "" in node else body

    first = "".join(re.escape(c) for c in sorted(tree))
    return f"(?=[{first}])(?=({either(tree, 6)}))"


def condensed(text: Column) -> Column:
    """What the rules need of a text to look for their keywords.

    ``named``: the text around operators that have a value behind them;
    ``tokens``: the runs of 12 or more characters that may be a token;
    ``text``: everything. All in lower case.
    """

    def around(found: Column) -> Column:
        gaps = F.split(text, AROUND_VALUE, F.lit(-1))
        return let(
            gaps,
            lambda g: F.array_join(
                F.transform(
                    found,
                    lambda m, i: let(
                        F.get(g, i),
                        lambda gap: F.concat(
                            F.when(F.length(gap) > NAME_REACH, F.concat(F.lit("\n"), F.right(gap, F.lit(NAME_REACH))))
                            .otherwise(gap),
                            m,
                        ),
                    ),
                ),
                "",
            ),
        )

    operators = F.regexp_extract_all(text, F.lit(AROUND_VALUE), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_RUN), F.lit(0))
    return F.struct(
        F.lower(let(operators, lambda o: F.when(F.size(o) > 0, around(o)).otherwise(F.lit("")))).alias("named"),
        F.lower(F.array_join(tokens, "\n")).alias("tokens"),
        F.lower(text).alias("text"),
    )


def rule_candidates(text: Column, catalogue: Catalogue, categories: set[str]) -> Column:
    """Matches of all rules of the categories, after all their filters."""
    # rules that stay on one line come first, so a number tells them apart
    rows = sorted((r for r in catalogue.as_rows() if r["category"] in categories), key=lambda r: r["multiline"])
    on_line = sum(not r["multiline"] for r in rows)
    table = catalogue.literal(rows)
    words: dict[str, dict[str, list[int]]] = {"named": {}, "tokens": {}, "text": {}}
    anywhere: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        for word in row["trigger"]:
            anywhere.setdefault(word, []).append(i)
            for place in row["keyword_places"]:
                words[place].setdefault(word, []).append(i)

    def numbers(low: Column, rules_of: dict[str, list[int]]) -> Column:
        """Numbers of the rules whose keywords occur in a text in lower case."""
        known = sorted(rules_of)
        # the longest keyword at a position brings the rules of the shorter ones along
        rules = {w: sorted({i for k in known if w.startswith(k) for i in rules_of[k]}) for w in known}
        entries = F.from_json(F.lit(json.dumps(rules)), "MAP<STRING, ARRAY<INT>>")
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(keyword_pattern(known)), F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(entries, w))))

    def worth_trying(source: Column) -> Column:
        """Numbers of the rules whose keywords occur in their places of a text."""
        found = [F.when(source[p] != "", numbers(source[p], words[p])) for p in words if words[p]]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))

    def tries(tried: Column) -> Column:
        """``array<struct<rule, start, line>>``: the rules of each line and those of the whole text; null tries all."""

        def of_line(x: Column) -> Column:
            found = numbers(F.lower(x["line"]), anywhere)
            return F.struct(
                x["start"].alias("start"),
                x["line"].alias("line"),
                F.when(tried.isNull(), found).otherwise(F.array_intersect(found, tried)).alias("rules"),
            )

        def of_lines(lines: Column) -> Column:
            def on(i: Column, start: Column, line: Column) -> Column:
                return F.struct(i.alias("rule"), start.alias("start"), line.alias("line"))

            single = F.transform(
                lines,
                lambda x: F.transform(
                    F.filter(x["rules"], lambda i: i < on_line), lambda i: on(i, x["start"], x["line"])
                ),
            )
            whole = F.filter(F.array_distinct(F.flatten(F.transform(lines, lambda x: x["rules"]))), lambda i: i >= on_line)
            return F.concat(F.flatten(single), F.transform(whole, lambda i: on(i, F.lit(0), text)))

        found = F.filter(F.transform(numbered_lines(text), of_line), lambda x: F.size(x["rules"]) > 0)
        return F.when(tried.isNull() | (F.size(tried) > 0), let(found, of_lines))

    def hits(t: Column) -> Column:
        # the facts of a rule are only looked up for its matches
        rule = F.get(table, t["rule"])
        kept = F.filter(
            rule_matches(t["line"], t["rule"], rule, rows), lambda h: ~rejected(t["line"], t["rule"], rule, h, rows)
        )
        return F.transform(
            kept,
            lambda h: candidate(
                h["value"], t["start"] + h["start"], t["start"] + h["end"],
                rule["category"], rule["label"], rule["tier"], rule["rule_id"], rule["seq"],
            ),
        )

    # lines that are short on average are tried as they are: finding the places would cost more than it saves
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    gated = F.when(F.length(text) > SHORT_LINE * n_lines, let(condensed(text), worth_trying))
    return F.flatten(F.array_compact(F.transform(let(gated, tries), hits)))
