"""Vectors as exact integers, and blocks of them that meet as units of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components (after scaling) stay below this, so that sums over some thousand dimensions fit in 64 bits.
LARGEST = 1 << 25


def usable(vec_col: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    x = F.col(vec_col).cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def integers(vec_col: str, scale: int) -> Column:
    """floor(scale * component) of every component; a component that large that sums could overflow is an error, not a wrong number."""
    big = F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("int")
    return F.transform(F.col(vec_col).cast("array<double>"),
                       lambda c: F.when(F.abs(c * F.lit(float(scale))) < LARGEST, F.floor(c * F.lit(float(scale))).cast("int")).otherwise(big))


def matrix(values: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Integer rows in the number type that multiplies them exactly: floats while every sum is below 2**53, else 64-bit integers."""
    x = values.reshape(rows, size) if size else np.zeros((rows, 0), np.int64)
    top = int(np.abs(x.astype(np.int64)).max(initial=0))
    return x.astype(np.float64 if size * top * top < 1 << 53 else np.int64)


def same_type(*arrays: np.ndarray) -> list[np.ndarray]:
    """Both sides of a product in the wider exact type, also where only their product is too large for floats."""
    top = [int(np.abs(a).max(initial=0)) for a in arrays]
    exact = all(a.dtype == np.float64 for a in arrays) and arrays[0].shape[-1] * top[0] * top[-1] < 1 << 53
    return [a if exact else a.astype(np.int64) for a in arrays]


def blocked(rows: DataFrame, by: list[str], block: str, columns: list[str]) -> DataFrame:
    """One row per (size, ``by``, block): the blocks' columns as arrays, the vectors one after the other."""
    got = rows.groupBy("size", *by, block).agg(F.collect_list(F.struct(*columns, "vec")).alias("r"))
    return got.select("size", *by, block, *(F.col(f"r.{c}").alias(c) for c in columns), F.flatten("r.vec").alias("vec"))


def numbered(count: Column) -> Column:
    """0 .. count - 1, nothing for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
