"""Stable placeholders: one per distinct value, numbered per label by first appearance.

``named`` numbers the values of one row without a shuffle. ``number_values``
numbers the values of a scope that spans many rows; a scope may hold any share
of the table, so its ranks are computed in range slices and not in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.arrays import let, positions, running_max, running_sum
from veilspark.operators.keeping import checkpointed

# A number a placeholder can have: no leading zero, at most 18 digits.
_CANONICAL = r"\A(.*)_([1-9][0-9]{0,17})\z"


def existing_placeholders(text: Column) -> Column:
    """Distinct placeholder-shaped words of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0)))


def _heads(items: Column, value: Callable[[Column, Column], Column]) -> Column:
    """For every item of an array sorted by label the ``value`` at the first item of its label, which never falls."""
    return running_max(
        F.transform(
            items,
            lambda x, i: F.when((i > 0) & (F.get(items, i - 1)["label"] == x["label"]), 0).otherwise(value(x, i)),
        )
    )


def _skips(ranks: Column, taken: Column) -> Column:
    """For every (label, rank) of a sorted array, how many numbers its placeholder has to skip.

    The n-th value of a label gets the n-th number that is not taken. With the taken numbers r0 < r1 < ... of the
    label that is n plus the count of j with rj - j - 1 < n. Marks and ranks are merged once, for all labels together:
    n log n in the number of both.
    """
    canonical = F.filter(taken, lambda t: t.rlike(_CANONICAL))
    numbers = F.sort_array(
        F.transform(
            canonical,
            lambda t: F.struct(
                F.regexp_extract(t, _CANONICAL, 1).alias("label"),
                F.regexp_extract(t, _CANONICAL, 2).cast("bigint").alias("number"),
            ),
        )
    )

    def point(label: Column, at: Column, mark: int) -> Column:
        return F.struct(label.alias("label"), at.cast("bigint").alias("at"), F.lit(mark).alias("mark"))

    def marks(n: Column) -> Column:
        first = _heads(n, lambda x, i: i)
        return let(first, lambda f: F.transform(n, lambda x, i: point(x["label"], x["number"] - (i - F.get(f, i)) - 1, 1)))

    def counted(points: Column) -> Column:
        def of_values(total: Column) -> Column:
            before = _heads(points, lambda x, i: F.get(total, i) - x["mark"])
            kept = let(
                before,
                lambda b: F.filter(
                    F.transform(points, lambda x, i: F.struct(x["mark"].alias("mark"), (F.get(total, i) - F.get(b, i)).alias("n"))),
                    lambda x: x["mark"] == 0,
                ),
            )
            return F.transform(kept, lambda x: x["n"])

        return let(running_sum(F.transform(points, lambda x: x["mark"])), of_values)

    # at equal places values come before marks: a mark counts for the ranks above it
    values = F.transform(ranks, lambda r: point(r["label"], r["rank"], 0))
    return let(F.sort_array(F.concat(values, let(numbers, marks))), counted)


def named(spans: Column, taken: Column) -> Column:
    """Add a placeholder to every span of one row; spans carry ``label`` and ``value``.

    Sorting by value finds equal values, sorting by label and first position
    numbers them, so the work is n log n in the number of spans.
    """

    def flags(items: Column, same: str) -> Column:
        return F.transform(
            items,
            lambda x, i: F.when((i > 0) & (F.get(items, i - 1)[same] == x[same]), 0).otherwise(1),
        )

    def by_value(s: Column) -> Column:
        return F.sort_array(
            F.transform(
                s,
                lambda x, i: F.struct(x["value"].alias("value"), i.alias("at"), x["label"].alias("label")),
            )
        )

    def number(occurrences: Column, run: Column) -> Column:
        firsts = F.transform(
            positions(occurrences, lambda i: (i == 0) | (F.get(run, i) != F.get(run, i - 1))),
            lambda p, r: F.struct(
                F.get(occurrences, p)["label"].alias("label"),
                F.get(occurrences, p)["at"].alias("at"),
                r.alias("run"),
            ),
        )

        def per_label(u: Column) -> Column:
            def ranked(b: Column) -> Column:
                return F.transform(
                    u,
                    lambda x, i: F.struct(
                        x["label"].alias("label"), (i - F.get(b, i) + 1).cast("bigint").alias("rank"), x["run"].alias("run")
                    ),
                )

            def issue(r: Column) -> Column:
                def one(x: Column, skip: Column) -> Column:
                    number = (x["rank"] + skip).cast("string")
                    return F.struct(x["run"].alias("run"), F.concat(x["label"], F.lit("_"), number).alias("placeholder"))

                fresh = F.transform(r, lambda x: one(x, F.lit(0)))
                beside = let(_skips(r, taken), lambda k: F.transform(r, lambda x, i: one(x, F.get(k, i))))
                return F.sort_array(F.when(F.size(taken) == 0, fresh).otherwise(beside))

            return let(let(_heads(u, lambda x, i: i), ranked), issue)

        def back(names: Column) -> Column:
            return F.sort_array(
                F.transform(
                    occurrences,
                    lambda o, j: F.struct(
                        o["at"].alias("at"),
                        F.get(names, F.get(run, j) - 1)["placeholder"].alias("placeholder"),
                    ),
                )
            )

        return let(let(F.sort_array(firsts), per_label), back)

    def attach(s: Column) -> Column:
        order = let(by_value(s), lambda o: let(running_sum(flags(o, "value")), lambda r: number(o, r)))
        return let(
            order,
            lambda names: F.transform(
                s,
                lambda x, i: F.struct(
                    *[x[f].alias(f) for f in ("start", "end", "category", "label", "rule", "value")],
                    F.get(names, i)["placeholder"].alias("placeholder"),
                ),
            ),
        )

    return let(spans, attach)


def named_in(text: Column, spans: Column) -> Column:
    """Named spans of one text; numbers of placeholders it already holds are skipped."""
    return let(existing_placeholders(text), lambda taken: named(spans, taken))


def first_uses(named_spans: Column) -> Column:
    """``[placeholder, value]`` pairs of one row, in first-seen order."""
    return F.array_distinct(
        F.transform(
            named_spans,
            lambda x: F.struct(x["placeholder"].alias("placeholder"), x["value"].alias("value")),
        )
    )


# ---- numbering across rows ----


def running_count(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, name: str, slices: int | None = None
) -> DataFrame:
    """Running total of ``weight`` within each group, in the given order.

    Rows are range-partitioned by group and order, so a group that holds a third
    of the table is spread over many tasks. Each slice is summed on its own; the
    few slice totals of a group give the offsets.
    """
    n = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = checkpointed(
        df.withColumn("_weight", weight)
        .repartitionByRange(n, *group, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(*group, "_slice").agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = sliced.withColumn("_inside", F.sum("_weight").over(inside))
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        counted.join(offsets, same)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_weight", "_slice", "_inside", "_offset", "_s", *[f"_g{i}" for i in range(len(group))])
    )


def unique_values(occurrences: DataFrame, scope: str, order: Sequence[str]) -> DataFrame:
    """Distinct values of a scope with the label and position of their first use.

    Grouped by scope and value with partial aggregation, so neither a large
    scope nor a frequent value ends up in one task.
    """
    first = F.struct(*[F.col(c) for c in order])
    return occurrences.groupBy(scope, "value").agg(
        F.min_by(F.struct("label", "category"), first).alias("_named"),
        F.min(first).alias("first"),
        F.count("*").alias("n_matches"),
    ).select(scope, "value", "_named.label", "_named.category", "first", "n_matches")


def reserved_numbers(texts: DataFrame, text: str, scope: str) -> DataFrame:
    """Placeholder numbers that already occur in the texts of a scope."""
    words = texts.select(scope, F.explode_outer(existing_placeholders(F.col(text))).alias("word"))
    return (
        words.where(F.col("word").rlike(_CANONICAL))
        .select(
            scope,
            F.regexp_extract("word", _CANONICAL, 1).alias("label"),
            F.regexp_extract("word", _CANONICAL, 2).cast("bigint").alias("number"),
        )
        .distinct()
    )


def number_values(
    unique: DataFrame, reserved: DataFrame, scope: str, slices: int | None = None
) -> DataFrame:
    """Placeholder of every distinct value: ``(scope, placeholder, value, label, category, ...)``.

    The n-th value of a label gets the n-th number that is not reserved. With the
    reserved numbers r1 < r2 < ... that is n plus the count of j with rj - j < n,
    which a second running count over both kinds of rows delivers.
    """
    ranked = running_count(unique, [scope, "label"], ["first"], F.lit(1), "rank", slices)
    held = unique.select(F.col(scope).alias("_scope"), F.col("label").alias("_label")).distinct()
    used = reserved.join(held, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("label") == F.col("_label")), "left_semi")
    marks = running_count(used, [scope, "label"], ["number"], F.lit(1), "_nth", slices).select(
        scope, "label", (F.col("number") - F.col("_nth")).alias("rank"), F.lit(1).alias("_mark")
    )
    # A mark counts for the ranks above it, a rank never for itself: order by rank, values first.
    both = ranked.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    skipped = running_count(both, [scope, "label"], ["rank", "_mark"], F.col("_mark"), "_skipped", slices)
    number = F.col("rank") + F.col("_skipped")
    return skipped.where("_mark = 0").select(
        scope,
        F.concat("label", F.lit("_"), number.cast("string")).alias("placeholder"),
        "value", "label", "category", "first", "n_matches",
    )
