"""Array expressions that keep per-file work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_totals(numbers: Column, block: int = 1024) -> Column:
    """Sum of all earlier elements for each element of an array of bigint.

    Blocks are summed on their own and shifted by the totals of the blocks before, which keeps the
    copying of growing arrays small on long inputs.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def sums(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def blocks(all_numbers: Column) -> Column:
        last = F.floor((F.size(all_numbers) - 1) / F.lit(block)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                           lambda i: sums(F.slice(all_numbers, i * block + 1, block)))

    def shifted(parts: Column) -> Column:
        return let(sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda bases: F.flatten(F.transform(
            parts, lambda p, i: let(F.get(bases, i), lambda base: F.transform(
                F.slice(p, 1, F.size(p) - 1), lambda v: v + base)))))

    return let(numbers, lambda n: F.when(F.size(n) < 2, F.slice(zero, F.lit(1), F.size(n))).otherwise(let(blocks(n), shifted)))


def unnest(df: DataFrame, keep: list, array: Column, pos: str, value: str) -> DataFrame:
    """``keep`` columns with one row per array element.

    The outer form keeps the optimizer from computing the array twice more in an inferred
    "array is not empty" filter below the generator.  What is kept is worked out once per row, not once per element.
    """
    ready = df.select(*keep, array.alias("_elements"))
    return ready.select(*ready.columns[:-1], F.posexplode_outer("_elements").alias(pos, value)).filter(F.col(pos).isNotNull())
