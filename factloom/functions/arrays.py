"""Array functions that Spark lacks, built from native ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; without it the value's expression would be repeated at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``merge`` of ``zero`` and the values up to each place, that one included; ``merge`` must be associative and ``zero`` its
    neutral element.

    Arrays have no running fold, and appending to an array copies it. So the values are folded in blocks of about sqrt(n):
    n * sqrt(n) copied references instead of n * n / 2.
    """
    nothing = F.slice(F.array(zero), F.lit(1), F.lit(0))

    def folded(part: Column, first: Column) -> Column:
        def step(state: Column, v: Column) -> Column:
            return let(merge(state["last"], v), lambda x: F.struct(x.alias("last"), F.concat(state["out"], F.array(x)).alias("out")))

        return F.aggregate(part, F.struct(first.alias("last"), nothing.alias("out")), step, lambda state: state["out"])

    def in_blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["v"]) - 1) / x["b"]).cast("int")), lambda i: F.slice(x["v"], i * x["b"] + 1, x["b"]))
        return F.struct(parts.alias("parts"))

    def with_starts(x: Column) -> Column:
        sums = F.transform(x["parts"], lambda part: F.aggregate(part, zero, merge))
        return F.struct(x["parts"].alias("parts"), F.concat(F.array(zero), folded(sums, zero)).alias("starts"))

    def joined(x: Column) -> Column:
        return F.flatten(F.transform(x["parts"], lambda part, i: folded(part, F.get(x["starts"], i))))

    block = F.ceil(F.sqrt(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    many = let(let(let(F.struct(values.alias("v"), block.alias("b")), in_blocks), with_starts), joined)
    return F.when(F.size(values) > 0, many).otherwise(nothing)
