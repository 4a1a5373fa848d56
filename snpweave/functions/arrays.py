"""Column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold appends to its result; folds copy what they have, so longer arrays are folded in parts.
PART = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` refers to it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold_sums(x: Column) -> Column:
    """Running sums of a short array, by appending."""
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        total = acc["sum"] + v
        return F.struct(total.cast("long").alias("sum"), F.concat(acc["out"], F.array(total.cast("long"))).alias("out"))

    return F.aggregate(x, begin, step, lambda acc: acc["out"])


def running_sums(x: Column) -> Column:
    """Running sums of an array of whole numbers, as ``array<bigint>``; parts of ``PART`` are summed and then moved by the
    sums of the parts before, so the work grows in proportion for any length that a row can have."""

    def summed(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / PART).cast("int"))
        parts = F.transform(starts, lambda i: _fold_sums(F.slice(all_, i * PART + 1, PART)))

        def moved(done: Column) -> Column:
            before = _fold_sums(F.transform(done, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
            return let(before, lambda b: F.flatten(F.transform(done, lambda p, i: F.transform(p, lambda v: v + F.coalesce(F.get(b, i - 1), F.lit(0))))))

        return let(parts, moved)

    return let(x, summed)
