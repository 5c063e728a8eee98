"""MINUS and DISTINCT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b``; NULLs are equal.

    Both sides are made distinct first (combined before the shuffle), so repeated rows do not pile
    up in the anti join.
    """
    left, right = a.distinct().alias("l"), b.distinct().toDF(*a.columns).alias("r")
    same = reduce(
        lambda x, y: x & y,
        [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in a.columns],
    )
    return left.join(right, same, "left_anti")


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
