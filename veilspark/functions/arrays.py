"""Array helpers: local bindings, running totals and slices inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS_OF_TWO = [1 << k for k in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    An aggregate over no items hands its start to ``body`` and the result on as they are; a transform copies its result
    with all that is nested in it.
    """
    return F.aggregate(F.array(), value, lambda start, _: start, body)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running ``combine`` over an array, in n log n by doubling strides."""
    strides = F.array(*[F.lit(p) for p in _POWERS_OF_TWO])

    def add_stride(done: Column, stride: Column) -> Column:
        return F.transform(
            done,
            lambda x, i: F.when(i >= stride, combine(F.get(done, i - stride), x)).otherwise(x),
        )

    def doubled(v: Column) -> Column:
        # the strides below the size are as many as the binary digits of the last position
        below = F.slice(strides, F.lit(1), F.length(F.bin(F.size(v) - 1)))
        return F.when(F.size(v) > 1, F.aggregate(below, v, add_stride)).otherwise(v)

    return let(values, doubled)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def split_at(items: Column, heads: Column) -> Column:
    """Cut ``items`` into sub-arrays that begin at the ascending positions ``heads``."""
    return F.transform(
        heads,
        lambda h, j: F.slice(
            items, h + 1, F.coalesce(F.get(heads, j + 1), F.size(items)) - h
        ),
    )


def positions(items: Column, keep: Callable[[Column], Column]) -> Column:
    """Zero-based positions of a non-empty array for which ``keep(position)`` holds."""
    return F.filter(F.sequence(F.lit(0), F.size(items) - 1), keep)
