"""Sequence numbers over whole tables without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.session import materialize

# monotonically_increasing_id() puts the partition number above these bits.
_ROW_BITS = 33


def range_numbered(df: DataFrame, order: Sequence, mark: str = "_mark") -> DataFrame:
    """``df`` globally sorted and stored once, each row marked with (partition, position).

    The mark rises with the order.  The rows are stored because a second pass counts them per
    partition, and both passes must see the same range boundaries.
    """
    return materialize(df.orderBy(*order).withColumn(mark, F.monotonically_increasing_id()), "ranges")


def dense_index(df: DataFrame, order: Sequence, name: str = "row_index") -> DataFrame:
    """0-based dense position of every row in a total order.

    Range partitions number their own rows; the counts per partition (one row each) turn local
    numbers into global ones.  No step handles more than one range of rows per task.
    """
    marked = range_numbered(df, order)
    part = F.shiftright(F.col("_mark"), _ROW_BITS)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_mark") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .select(*df.columns, (F.col("_offset") + local).alias(name))
    )


def nextval(df: DataFrame, order: Sequence, start: int = 1, inc: int = 1, minv: int | None = None,
            maxv: int | None = None, cycle: bool = False, name: str = "nextval") -> DataFrame:
    """NEXTVAL for every row, dense and in the stated order.

    Past the limit a cycling sequence goes on from its other end (MINVALUE when rising, MAXVALUE
    when falling); a non-cycling one fails.
    """
    if inc == 0:
        raise ValueError("INCREMENT BY must not be 0")
    index = F.col("_index")
    value = F.lit(start) + index * F.lit(inc)
    limit, restart = (maxv, 1 if minv is None else minv) if inc > 0 else (minv, -1 if maxv is None else maxv)
    if limit is not None:
        first = (limit - start) // inc + 1
        if first < 1:
            raise ValueError("START WITH lies beyond the sequence limit")
        if cycle:
            period = (limit - restart) // inc + 1
            again = F.lit(restart) + F.pmod(index - first, F.lit(period)) * F.lit(inc)
        else:
            again = F.raise_error(F.lit(f"sequence exceeds {limit} and does not cycle"))
        value = F.when(index < first, value).otherwise(again)
    numbered = dense_index(df, order, "_index")
    return numbered.select(*df.columns, value.cast("bigint").alias(name))


def nextval_blocks(df: DataFrame, cache: int, start: int = 1, name: str = "nextval") -> DataFrame:
    """Unique ids handed out in blocks of ``cache`` per task: gaps, no order, and no shuffle."""
    mark = F.monotonically_increasing_id()
    part = F.shiftright(mark, _ROW_BITS)
    local = mark - F.shiftleft(part, _ROW_BITS)
    stride = 1 << 20  # upper bound of partitions in one job
    block = F.floor(local / F.lit(cache)) * F.lit(stride) + part
    guarded = F.when(part >= stride, F.raise_error(F.lit("too many partitions"))).otherwise(block)
    return df.withColumn(name, (F.lit(start) + guarded * F.lit(cache) + local % F.lit(cache)).cast("bigint"))
