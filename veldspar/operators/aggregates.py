"""Grouped aggregates with Oracle defaults, and ordered string aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.skew import maybe_broadcast
from veldspar.session import materialize


def agg_nvl(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Column]) -> DataFrame:
    """Grouped aggregates, each with NVL(agg, 0)."""
    return df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in spec.items()])


def summary(parents: DataFrame, children: DataFrame, keys: Sequence[str],
            spec: Mapping[str, Column]) -> DataFrame:
    """Every parent with its children's aggregates; parents without children get 0.

    The children are aggregated before the join, so a hot parent costs one combined row per task.
    """
    grouped = children.groupBy(*keys).agg(*[c.alias(n) for n, c in spec.items()])
    joined = parents.join(grouped, list(keys), "left")
    return joined.select(
        *parents.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in spec]
    )


def count_or_zero(df: DataFrame, keys: Sequence[str], keys_df: DataFrame,
                  name: str = "n") -> DataFrame:
    """Count per key for every key of ``keys_df``; absent keys count 0."""
    wanted = keys_df.select(*keys).distinct()
    return summary(wanted, df, keys, {name: F.count(F.lit(1))})


# Bytes of a group's text up to which one task joins it at once, bytes of a slice of a larger one, and the most a string may hold.
SMALL_BYTES, SLICE_BYTES, MOST_BYTES = 8 << 20, 16 << 20, 2**31 - 64


def listagg(df: DataFrame, keys: Sequence[str], value: str, sep: str = ",",
            order: str | None = None, name: str = "listagg") -> DataFrame:
    """LISTAGG(value, sep) WITHIN GROUP (ORDER BY order) per key; NULL values are skipped.

    The bytes of each group are added up first, with a combined aggregate.  A group that could not be one string is an error before anything is joined.  Small
    groups are collected and joined in one aggregate.  Equal (key, order, value) rows of the others are counted, then range-partitioned on key and
    order into slices sized by bytes; each slice joins its part of a group, and only the finished parts meet.
    """
    keys = list(keys)
    by = order or value
    text = F.col(value).cast("string")
    rows = df.select(*keys, F.col(by).alias("_by"), text.alias("_value")).withColumn("_last", F.col("_by").isNull())  # NULL order values come last
    sizes = materialize(rows.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length("_value") + F.lit(len(sep.encode()))), F.lit(0)).alias("_bytes")), "group-bytes")
    most = sizes.agg(F.coalesce(F.max("_bytes"), F.lit(0))).first()[0]
    if most > MOST_BYTES:
        raise ValueError(f"LISTAGG: a group of {most} bytes cannot be one string (at most {MOST_BYTES})")
    if most <= SMALL_BYTES:
        return _listed(rows, keys, sep, name)
    large = materialize(sizes.filter(F.col("_bytes") > SMALL_BYTES), "large-groups")
    total = large.agg(F.sum("_bytes")).first()[0]
    marked = large.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    small = _listed(rows.join(maybe_broadcast(marked), same, "left_anti"), keys, sep, name)
    return small.unionByName(_sliced(rows.join(maybe_broadcast(marked), same, "left_semi"), keys, sep, name, -(-total // SLICE_BYTES)))


def _listed(rows: DataFrame, keys: list[str], sep: str, name: str) -> DataFrame:
    """Whole groups in one aggregate."""
    item = F.when(F.col("_value").isNotNull(), F.struct("_last", "_by", "_value"))
    ordered = F.array_sort(F.collect_list(item))
    joined = F.array_join(F.transform(ordered, lambda s: s["_value"]), sep)
    return rows.groupBy(*keys).agg(F.count("_value").alias("_n"), joined.alias("_text")).select(*keys, F.when(F.col("_n") > 0, F.col("_text")).alias(name))


def _sliced(rows: DataFrame, keys: list[str], sep: str, name: str, slices: int) -> DataFrame:
    runs = rows.filter("_value IS NOT NULL").groupBy(*keys, "_last", "_by", "_value").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    run_text = F.repeat(F.concat(F.col("_value"), F.lit(sep)), F.col("_times"))
    parts = (
        runs.repartitionByRange(max(1, slices), *keys, "_last", "_by", "_value")
        .withColumn("_slice", F.spark_partition_id())
        .groupBy(*keys, "_slice")
        .agg(_joined(run_text, F.struct("_last", "_by", "_value")).alias("_text"))
    )
    whole = parts.groupBy(*keys).agg(_joined(F.col("_text"), F.col("_slice")).alias(name))
    return whole.select(*keys, F.substring(F.col(name), F.lit(1), F.char_length(name) - F.lit(len(sep))).alias(name))


def _joined(text: Column, order: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda s: s["t"]), "")


def wm_concat(df: DataFrame, keys: Sequence[str], value: str, name: str = "wm_concat") -> DataFrame:
    """WM_CONCAT: comma-joined values; sorted here so that the result is stable."""
    return listagg(df, keys, value, ",", name=name)


def currval(df: DataFrame, column: str, name: str = "currval") -> DataFrame:
    """The last value a rising sequence has given to ``column``."""
    return df.agg(F.max(column).alias(name))
