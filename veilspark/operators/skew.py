"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are 500 hot keys at most, whatever the table.
HOT_SHARE = 0.002
#: A key with fewer rows is never hot.
HOT_LEAST = 64


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """The keys with more than ``share`` of the rows of ``df`` and their numbers of rows, counted now.

    At most ``1 / share`` rows come to the driver by that definition.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    limit = max(float(least), df.count() * share)
    found = counts.where(F.col("n_rows") > F.lit(limit))
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def split_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", share: float = HOT_SHARE, least: int = HOT_LEAST
) -> DataFrame:
    """Join ``left`` with a ``right`` that holds every key once, by pairs of column names; null equals null.

    The rows of the hot keys of ``left`` stay where they are and meet the few rows of ``right`` with these keys by a
    broadcast of at most ``1 / share`` rows; only the other rows are exchanged, so no task gets more than that
    share of them for one key, without help of adaptive execution. ``left`` is read several times: give a written table.
    ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    mine, theirs = [a for a, _ in on], [b for _, b in on]
    hot = hot_keys(left, mine, share, least).select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(mine)])
    if hot.isEmpty():
        return left.join(right, _same(mine, theirs), how)
    names = hot.columns
    few = F.broadcast(hot)
    hot_right = right.join(few, _same(theirs, names), "left_semi")
    fast = left.join(few, _same(mine, names), "left_semi").join(F.broadcast(hot_right), _same(mine, theirs), how)
    slow = left.join(few, _same(mine, names), "left_anti").join(right, _same(mine, theirs), how)
    return fast.unionByName(slow)
