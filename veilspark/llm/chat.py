"""Chat formatting: layouts told by a fingerprint of their field paths, one template, exact reading back.

A record is a JSON object in some layout: prompt and completion, instruction with an optional
input, or a list of messages under one of several names. One parse with the fields of all
layouts tells which field paths a record has; the hash of these paths selects a declarative
mapping, which gives canonical turns ``array<struct<role, text>>``. Fields that no layout knows do not count.

The template marks each turn. Control strings inside texts and roles are escaped so that a text can
never end its turn, and unescaped when read: ``<`` and ``|`` get one more backslash between them.
Only column expressions are used.

Defined results: null texts and roles are empty; a record whose paths match no layout, or that is no
JSON object, has null turns and the layout ``unknown``; rows of a conversation are ordered by turn (null
first), then role and text, and repeated rows are repeated turns; a conversation is formatted in one row;
rows without a conversation id are one conversation; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, running_sum

BEGIN, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Field paths that a record of this layout has, and how they become turns.

    ``turns`` lists ``(role, field)``; with ``each`` the fields are those of the elements of that list
    and the role is a field too.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None


# The layouts and the role names of their makers.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (("role", "content"),), "messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (("from", "value"),), "conversations"),
    Layout("turns", ("turns[].role", "turns[].text"), (("role", "text"),), "turns"),
    Layout("system messages", ("system", "messages[].role", "messages[].content"), (("role", "content"),), "messages"),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction and input", ("instruction", "input", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Layout("prompt and completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("system prompt", ("system", "prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "ai": "assistant"}


def _all_paths() -> list[str]:
    return sorted({p for layout in LAYOUTS for p in layout.paths})


def _parsed(raw: Column) -> Column:
    """The record with the fields of all layouts; fields that it lacks are null."""
    lists: dict[str, list[str]] = {}
    plain = []
    for path in _all_paths():
        if "[]." in path:
            name, field = path.split("[].")
            lists.setdefault(name, []).append(field)
        else:
            plain.append(path)
    fields = [f"`{p}` STRING" for p in plain]
    fields += [f"`{n}` ARRAY<STRUCT<{', '.join(f'`{f}`: STRING' for f in own)}>>" for n, own in lists.items()]
    return F.from_json(raw, ", ".join(fields), {"maxStringLen": str(2**31 - 1)})  # the parser's own limit is 20 million characters


def _has(record: Column, path: str) -> Column:
    if "[]." not in path:
        return record[path].isNotNull()
    name, field = path.split("[].")
    return F.coalesce(F.exists(record[name], lambda x: x[field].isNotNull()), F.lit(False))


def paths_print(paths: Sequence[str]) -> str:
    """The fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """The same for a parsed record."""
    present = F.array(*[F.when(_has(record, p), F.lit(p)) for p in _all_paths()])
    return F.sha2(F.array_join(present, "\n"), 256)


def _role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    plain = F.coalesce(name, F.lit(""))
    return F.coalesce(F.try_element_at(known, F.lower(plain)), plain)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, layout: Layout) -> Column:
    if layout.each:
        (role, text), = layout.turns
        turns = F.transform(record[layout.each], lambda x: _turn(_role(x[role]), x[text]))
    else:
        def value(fields: str) -> Column:
            return F.array_join(F.array(*[record[f] for f in fields.split("+")]), "\n\n")

        turns = F.array(*[_turn(F.lit(role), value(fields)) for role, fields in layout.turns])
    if "system" in layout.paths:
        turns = F.concat(F.array(_turn(F.lit("system"), record["system"])), turns)
    return turns


def canonical_turns(records: DataFrame, raw: str, ids: Sequence[str]) -> DataFrame:
    """``(ids, layout, turns)`` of JSON records in any of the layouts."""
    parsed = records.select(*ids, _parsed(F.col(raw)).alias("_record")).withColumn("_print", fingerprint(F.col("_record")))
    layout, turns = F.lit("unknown"), F.lit(None)
    for one in LAYOUTS:
        fits = F.col("_print") == paths_print(one.paths)
        layout = F.when(fits, one.name).otherwise(layout)
        turns = F.when(fits, _mapped(F.col("_record"), one)).otherwise(turns)
    return parsed.select(*ids, layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _header(role: Column) -> Column:
    """A role in one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_of(header: Column) -> Column:
    parts = F.transform(F.split(header, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def formatted(turns: Column) -> Column:
    """``struct<formatted, loss array<struct<start, end>>>``: the marked text and the spans of assistant texts.

    Spans count code points of the formatted text and are half-open.
    """
    heads = lambda t: F.concat(F.lit(BEGIN), _header(t["role"]), F.lit("\n"))
    parts = F.transform(turns, lambda t: F.struct(heads(t).alias("head"), escaped(t["text"]).alias("body"), t["role"].alias("role")))
    tail = END + "\n"

    def build(p: Column) -> Column:
        ends = running_sum(F.transform(p, lambda x: F.length(x["head"]) + F.length(x["body"]) + len(tail)))
        text = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
        spans = let(ends, lambda e: F.transform(
            p,
            lambda x, i: F.struct(
                (F.get(e, i) - len(tail) - F.length(x["body"])).alias("start"),
                (F.get(e, i) - len(tail)).alias("end"),
                x["role"].alias("role"),
            ),
        ))
        learned = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(text.alias("formatted"), learned.alias("loss"))

    return let(parts, build)


def turns_of(text: Column) -> Column:
    """The turns read back from a formatted text."""
    parts = F.split(text, r"<\|im_start\|>")

    def one(p: Column) -> Column:
        header = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(header) + 2, F.length(p) - F.length(header) - 1 - len(END + "\n"))
        return F.struct(_role_of(header).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def learned_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, record)``: the rows of each conversation, in order, as one JSON record."""
    turns = F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )))
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("turns")).select(
        "conv_id", F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record")
    )


def format_chats(records: DataFrame, raw: str, ids: Sequence[str]) -> DataFrame:
    """``(ids, layout, formatted, loss)`` of JSON records; null where the layout is unknown."""
    turns = canonical_turns(records, raw, ids)
    return turns.select(*ids, "layout", formatted(F.col("turns")).alias("_f")).select(*ids, "layout", "_f.formatted", "_f.loss")


def digests(chats: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Counts and digests, all of them read back from the formatted text and its mask."""
    read = chats.select(*ids, "formatted", turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        *ids,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
