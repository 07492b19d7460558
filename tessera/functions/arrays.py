"""Folds over arrays that stay linear, or nearly, in long ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once, even if body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def sums_before(x: Column) -> Column:
    """For each element of an array of int, the sum of those before it, by sums of blocks."""

    def placed(lens: Column) -> Column:
        count = F.ceil(F.size(lens) / _BLOCK).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda b: _total(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b)))
        each = lambda starts: F.transform(lens, lambda _, i: F.get(starts, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(lens, i - i % _BLOCK + 1, i % _BLOCK)))
        return let(blocks, lambda sums: let(before(sums), each))

    return let(x, placed)


def kept_in_turn(x: Column, free: Callable[[Column, Column], Column], none: Column) -> Column:
    """Elements of an array, in turn, for which free(last one kept, element) holds, and the first; none is an empty array of them.

    What is kept is built a block at a time, so a long array isn't copied for each element.
    """
    blocks = F.filter(F.array(none), lambda _: F.lit(False))  # an empty array of arrays

    def fold(items: Column) -> Column:
        numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        zero = F.struct(F.get(none, F.lit(0)).alias("last"), blocks.alias("done"))

        def step(acc: Column, b: Column) -> Column:
            def one(kept: Column, y: Column) -> Column:
                last = F.coalesce(F.try_element_at(kept, F.lit(-1)), acc["last"])
                return F.when(last.isNull() | free(last, y), F.concat(kept, F.array(y))).otherwise(kept)

            kept = F.aggregate(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)), none, one)
            return let(kept, lambda k: F.struct(F.coalesce(F.try_element_at(k, F.lit(-1)), acc["last"]).alias("last"), F.concat(acc["done"], F.array(k)).alias("done")))

        return F.flatten(F.aggregate(numbers, zero, step, lambda a: a["done"]))

    return let(x, fold)
