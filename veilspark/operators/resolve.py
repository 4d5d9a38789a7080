"""From overlapping candidates to the spans that are masked.

Two forms of the same operators. The array form works inside one row, so a scan
needs no shuffle at all. The table form works on a candidates table with one row
per candidate and uses windows over each document.

Priority: higher tier, then longer, then earlier, then the detector order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, positions, running_max, split_at

_FIELDS = ("start", "end", "category", "label", "tier", "rule", "seq")


def _copy(c: Column) -> Column:
    return F.struct(*[c[f].alias(f) for f in _FIELDS])


def _apart(spans: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """True when ``holds(end, start)`` for the end of every span and the start of the next one in the array."""
    further = F.greatest(F.size(spans) - 1, F.lit(0))
    ends, starts = F.slice(spans["end"], F.lit(1), further), F.slice(spans["start"], F.lit(2), further)
    return (F.size(spans) <= 1) | F.forall(F.zip_with(ends, starts, holds), lambda x: x)


def _greedy(island: Column) -> Column:
    """Accept by priority whatever does not touch an accepted position.

    Accepted spans share no position and are kept in text order, so their ends ascend: a binary search finds the first one that
    ends behind a candidate's start, the only one to compare with, and the place to insert at.
    """
    by_priority = F.sort_array(
        F.transform(
            island,
            lambda c: F.struct(
                (-c["tier"]).alias("tier"),
                (c["start"] - c["end"]).alias("length"),
                c["start"].alias("start"),
                c["seq"].alias("seq"),
                _copy(c).alias("candidate"),
            ),
        )
    )

    def accepted(strides: Column) -> Column:
        def accept(taken: Column, item: Column) -> Column:
            c = item["candidate"]

            def step(low: Column, stride: Column) -> Column:
                further = (low + stride <= F.size(taken)) & (F.get(taken, low + stride - 1)["end"] <= c["start"])
                return F.when(further, low + stride).otherwise(low)

            def put(at: Column) -> Column:
                clash = F.coalesce(F.get(taken, at)["start"] < c["end"], F.lit(False))
                longer = F.concat(
                    F.slice(taken, F.lit(1), at), F.array(_copy(c)), F.slice(taken, at + 1, F.size(taken) - at)
                )
                return F.when(clash, taken).otherwise(longer)

            return let(F.aggregate(strides, F.lit(0), step), put)

        return let(by_priority, lambda p: F.aggregate(p, F.slice(island, 1, 0), accept))

    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.when(F.size(island) == 1, island).otherwise(let(F.filter(powers, lambda p: p <= F.size(island)), accepted))


def resolved(candidates: Column) -> Column:
    """Non-overlapping spans of one row, ordered by start.

    Sorting by start and a running maximum of the ends cut the candidates into
    islands that share no position; the greedy choice only looks at one island.
    """

    def islands(c: Column) -> Column:
        def heads(reach: Column) -> Column:
            return positions(
                c, lambda i: (i == 0) | (F.get(c, i)["start"] >= F.get(reach, i - 1))
            )

        firsts = let(running_max(F.transform(c, lambda x: x["end"])), heads)
        return F.flatten(F.transform(let(firsts, lambda h: split_at(c, h)), _greedy))

    # what one detector finds is in order and apart, mostly: one look tells, and nothing is sorted
    ordered = F.sort_array(F.transform(candidates, _copy))
    return F.when(_apart(candidates, lambda end, start: end <= start), candidates).otherwise(let(ordered, islands))


def merged(spans: Column) -> Column:
    """Touching spans become one; the first span of the highest tier names it."""

    def join(group: Column) -> Column:
        best = F.get(
            F.sort_array(
                F.transform(
                    group, lambda c: F.struct((-c["tier"]).alias("tier"), c["start"].alias("start"), _copy(c).alias("c"))
                )
            ),
            F.lit(0),
        )["c"]
        whole = let(
            best,
            lambda b: F.struct(
                F.get(group, F.lit(0))["start"].alias("start"),
                F.get(group, F.size(group) - 1)["end"].alias("end"),
                *[b[f].alias(f) for f in _FIELDS[2:]],
            ),
        )
        return F.when(F.size(group) == 1, F.get(group, F.lit(0))).otherwise(whole)

    def groups(s: Column) -> Column:
        heads = positions(
            s, lambda i: (i == 0) | (F.get(s, i)["start"] != F.get(s, i - 1)["end"])
        )
        return F.transform(let(heads, lambda h: split_at(s, h)), join)

    return let(spans, lambda s: F.when(_apart(s, lambda end, start: end != start), s).otherwise(groups(s)))


# ---- table form ----


def priority(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rank of every candidate within its document."""
    order = Window.partitionBy(*ids).orderBy(
        F.desc("tier"), F.desc(F.col("end") - F.col("start")), "start", "seq"
    )
    return candidates.withColumn("priority", F.row_number().over(order))


def overlap_islands(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Number the groups of candidates that are linked by shared positions."""
    by_start = Window.partitionBy(*ids).orderBy("start", "end", "seq")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return (
        candidates.withColumn("_head", head)
        .withColumn("island", F.sum("_head").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_head")
    )


def overlapping_pairs(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Each candidate with the number of earlier candidates it shares a position with.

    Counted per island, so a document is never crossed with itself.
    """
    marked = overlap_islands(candidates, ids)
    group = F.collect_list(F.struct("start", "end", "seq"))
    islands = marked.groupBy(*ids, "island").agg(F.array_sort(group).alias("members"))
    member = F.col("member")
    return (
        islands.where(F.size("members") > 1)
        .select(*ids, "island", "members", F.posexplode("members").alias("_place", "member"))
        .select(
            *ids,
            "island",
            member["start"].alias("start"),
            member["end"].alias("end"),
            member["seq"].alias("seq"),
            F.size(
                F.filter(
                    F.slice("members", F.lit(1), F.col("_place")), lambda m: m["end"] > member["start"]
                )
            ).alias("n_overlaps"),
        )
        .where("n_overlaps > 0")
    )


def resolved_table(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Spans that survive the overlap resolution, one row each."""
    islands = overlap_islands(candidates, ids).groupBy(*ids, "island").agg(
        F.collect_list(F.struct(*_FIELDS)).alias("_members")
    )
    return islands.select(*ids, F.inline(_greedy(F.col("_members"))))


def merged_table(spans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Touching spans merged by gaps and islands over a spans table."""
    by_start = Window.partitionBy(*ids).orderBy("start")
    gap = F.coalesce(F.col("start") != F.lag("end").over(by_start), F.lit(True))
    names = F.min_by(
        F.struct("category", "label", "tier", "rule", "seq"),
        F.struct(-F.col("tier"), F.col("start")),
    )
    return (
        spans.withColumn("_head", gap.cast("int"))
        .withColumn("_group", F.sum("_head").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*ids, "_group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), names.alias("_names"))
        .select(*ids, "start", "end", "_names.*")
    )
