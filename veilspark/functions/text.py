"""Text helpers: matches with offsets, entropy, context slices and word widening.

Offsets are zero-based, half-open and count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.arrays import let, running_sum

#: Characters of a chunk, as a power of two: a cut walks through a chunk from its start.
_CHUNK_BITS = 7
_WINDOW = 256
#: What a span is widened by, mostly; longer words are looked at once more.
_NEAR = 32


def searchable(text: Column) -> Column:
    """A copy of the same length without Unicode blanks and without the marks of ``find_all``.

    Texts in ASCII, told by their size in bytes, are taken as they are.
    """
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.translate(text, P.REPLACED, P.STAND_INS)
    )


def find_all(
    text: Column,
    pattern: str | Column | Callable[[Callable[[bool], str]], Column],
    groups: Mapping[str, int] | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """All matches as ``array<struct<start, end, match, before, after, <groups>>>``.

    One regex pass writes every match with its groups between marks; the rest is
    plain splitting. Offsets are running lengths of the pieces. ``before`` holds up
    to 256 characters between the previous match and this one, ``after`` the next
    character before the following match. A text without a match gives null. ``text`` is a searchable copy and ``pattern`` does not match empty
    text. Instead of a pattern, a function may make the marked text: it gets the replacement to write, with True the one
    for a pattern of two branches, whose groups n and n + 2 are alternatives of each other and are joined.
    """
    groups = dict(groups or {})

    def template(two_branches: bool) -> str:
        fields = ["$0", *(f"${g}${g + 2}" if two_branches else f"${g}" for g in groups.values())]
        return P.MARK + P.FIELD.join(fields) + P.FIELD

    n_fields = len(groups) + 2

    def build(pieces: Column) -> Column:
        fields = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda x: F.split(x, P.FIELD, -1))

        def rows(f: Column) -> Column:
            def before(i: Column) -> Column:
                return F.when(i == 0, F.get(pieces, F.lit(0))).otherwise(F.get(F.get(f, i - 1), F.lit(n_fields - 1)))

            ends = running_sum(F.transform(f, lambda x, i: F.length(before(i)) + F.length(F.get(x, F.lit(0)))))
            found = F.transform(
                ends,
                lambda e, i: let(
                    F.get(f, i),
                    lambda x: F.struct(
                        (e - F.length(F.get(x, F.lit(0)))).alias("start"),
                        e.alias("end"),
                        F.get(x, F.lit(0)).alias("match"),
                        F.substr(before(i), F.lit(-_WINDOW), F.lit(_WINDOW)).alias("before"),
                        F.substr(F.get(x, F.lit(n_fields - 1)), F.lit(1), F.lit(1)).alias("after"),
                        *[F.get(x, F.lit(j + 1)).alias(name) for j, name in enumerate(groups)],
                    ),
                ),
            )
            return F.filter(found, keep) if keep is not None else found

        return let(fields, rows)

    plain = isinstance(pattern, str | Column)
    marked = F.regexp_replace(text, pattern, F.lit(template(False))) if plain else pattern(template)
    return let(
        marked,
        lambda m: F.when(F.contains(m, F.lit(P.MARK)), let(F.split(m, P.MARK, -1), build)),
    )


def entropy(value: Column | str) -> Column:
    """Shannon entropy in bits per character."""
    v = F.col(value) if isinstance(value, str) else value

    def bits(n: Column) -> Column:
        shares = F.transform(
            F.array_distinct(F.split(v, "")), lambda char: (n - F.length(F.replace(v, char, F.lit("")))) / n
        )
        return F.aggregate(shares, F.lit(0.0), lambda e, p: e - p * F.log2(p))

    return F.when(F.length(v) == 0, F.lit(0.0)).otherwise(let(F.length(v).cast("double"), bits))


# Each character is taken out of what is left of the text, so a text is copied once for a few of its characters only.
ENTROPY_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION entropy(s STRING) RETURNS DOUBLE RETURN
  CASE WHEN length(s) = 0 THEN 0D ELSE aggregate(
    array_distinct(split(s, '')),
    named_struct('bits', 0D, 'rest', s, 'left', length(s), 'total', length(s)),
    (e, c) -> element_at(transform(array(replace(e.rest, c, '')), rest -> element_at(transform(array(length(rest)), left -> named_struct(
        'bits', e.bits - ((e.left - left) / e.total) * log2((e.left - left) / e.total),
        'rest', rest, 'left', left, 'total', e.total)), 1)), 1),
    e -> e.bits)
  END
"""


def chunked(text: Column) -> Column:
    """The text cut into pieces of 128 characters, for cheap random access."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % (1 << _CHUNK_BITS)), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` read from the chunks that hold it."""
    first = F.shiftright(start, _CHUNK_BITS)
    last = F.shiftright(F.greatest(end - 1, start), _CHUNK_BITS)
    # a slice copies all chunks of the text, whatever it takes: most spans lie in one chunk or two
    near = (
        F.when((last == first) & (last < F.size(chunks)), F.get(chunks, first))
        .when((last == first + 1) & (last < F.size(chunks)), F.concat(F.get(chunks, first), F.get(chunks, last)))
        .otherwise(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""))
    )
    return F.substr(near, start - F.shiftleft(first, _CHUNK_BITS) + 1, end - start)


def widen(chunks: Column, length: Column, start: Column, end: Column) -> Column:
    """Grow a span to ASCII word boundaries on both sides: ``struct<start, end>``.

    Looks at 32 characters on each side, at 256 only when all of them are word
    characters, and at the whole side only when those are as well.
    """

    def left_run(context: Column) -> Column:
        return F.length(
            F.regexp_extract(context, r"(?<!\w)\w*+\z", 0)
        )

    def right_run(context: Column) -> Column:
        return F.length(F.regexp_extract(context, r"\A\w*+", 0))

    def grown(run: Callable[[int], Column], whole: Callable[[], Column]) -> Column:
        def longer() -> Column:
            return let(run(_WINDOW), lambda r: F.when(r < _WINDOW, r).otherwise(whole()))

        return let(run(_NEAR), lambda r: F.when(r < _NEAR, r).otherwise(longer()))

    # the look to the left is only needed next to a word character
    left = F.when(
        (start > 0) & cut(chunks, start - 1, start).rlike(r"\w"),
        grown(
            lambda n: left_run(cut(chunks, F.greatest(start - n, F.lit(0)), start)),
            lambda: left_run(cut(chunks, F.lit(0), start)),
        ),
    ).otherwise(F.lit(0))
    right = grown(
        lambda n: right_run(cut(chunks, end, F.least(end + n, length))),
        lambda: right_run(cut(chunks, end, length)),
    )
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def quoted(value: Column) -> Column:
    """True when one pair of equal quotes is around a value longer than two characters."""
    first = F.substr(value, F.lit(1), F.lit(1))
    return first.isin('"', "'") & (F.length(value) > 2) & (F.substr(value, F.length(value), F.lit(1)) == first)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def contains_any(value: Column, words: tuple[str, ...]) -> Column:
    """True when the lower-cased value contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(value), F.lit(w)) for w in words])


def size_text(n: Column) -> Column:
    """A byte count as B, KB or MB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))
    )


def counted(n: Column, one: str, many: str) -> Column:
    """``1,234 things`` or ``1 thing``."""
    return F.concat(
        F.format_number(n, 0), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))
    )
