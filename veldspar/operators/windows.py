"""ROWNUM, top-n per group, previous/next values in a change feed, running depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.sequences import dense_index, range_numbered
from veldspar.operators.skew import HOT_ROWS, largest_group, maybe_broadcast
from veldspar.session import materialize


def rownum(df: DataFrame, order: Sequence, name: str = "rn") -> DataFrame:
    """ROWNUM over a stated total order, numbered by ranges rather than in one partition."""
    return dense_index(df, order, "_index").select(*df.columns, (F.col("_index") + 1).alias(name))


def top_n_by(df: DataFrame, part: Sequence, order: Sequence, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each group; the limit is applied per task before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn(name, number).filter(F.col(name) <= n)


def old_new(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str],
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each change with the previous values of its key as ``old_<col>`` (NULL for the first).

    ``order`` is total within a key.  Keys with more than ``hot_rows`` changes are cut into ranges.
    """
    key, order, cols = list(key), list(order), list(cols)
    if largest_group(df, key) > hot_rows:
        return _old_new_ranges(df, key, order, cols)
    w = Window.partitionBy(*key).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in cols])


def _old_new_ranges(df: DataFrame, key: list, order: list, cols: list) -> DataFrame:
    """``old_new`` over range partitions: a window inside each range, stitched at the range edges.

    Rows are sorted by (key, order), so only a range's first row can need a value from outside, and
    it needs the last row of the range before: one edge row per range.
    """
    marked = range_numbered(df, [*key, *order]).withColumn("_part", F.shiftright("_mark", 33))
    inside = Window.partitionBy("_part", *key).orderBy("_mark")
    whole_range = Window.orderBy("_part")
    last = F.struct(F.struct(*key).alias("k"), F.struct(*cols).alias("v"))
    edges = (
        marked.groupBy("_part")
        .agg(F.min("_mark").alias("_first"), F.max_by(last, "_mark").alias("_last"))
        .select("_part", "_first", F.lag("_last").over(whole_range).alias("_before"))
    )
    at_edge = F.col("_mark") == F.col("_first")
    follows = F.col("_before.k").eqNullSafe(F.struct(*key))
    old = [
        F.when(at_edge, F.when(follows, F.col(f"_before.v.{c}")))
        .otherwise(F.lag(c).over(inside))
        .alias(f"old_{c}")
        for c in cols
    ]
    edges = maybe_broadcast(materialize(edges, "edges"))  # one row per range
    return marked.join(edges, "_part").select(*df.columns, *old)


def running_depth(lines: DataFrame, part: Sequence[str], order: Sequence[str], delta: Column,
                  name: str = "depth") -> DataFrame:
    """Running sum of ``delta`` within each group, such as BEGIN minus END over a file's lines."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(delta).over(w))
