"""Joins and checks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.session import materialize

# A key group above this many rows is treated as hot and spread over several tasks.
HOT_ROWS = 2_000_000
# Bounds under which a side may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _wide_bytes(field: T.StructField) -> Column | None:
    """Size of a variable-width value, None for fixed-width types."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(F.col(field.name))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(field.name)))
    return None


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """True if ``df`` is within the row and the byte bound, by counting it.

    The row count needs no columns; only a small row count is followed by a sum of value sizes.
    """
    if df.count() > (BROADCAST_ROWS if max_rows is None else max_rows):
        return False
    wide = [w for w in map(_wide_bytes, df.schema) if w is not None]
    if not wide:
        return True
    total = sum((F.coalesce(w, F.lit(0)).cast("bigint") for w in wide), F.lit(0))
    size = df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]
    return size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small; a stored table is cheap to count."""
    return F.broadcast(df) if fits_broadcast(df) else df


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Size of the largest key group, from map-side combined counts over the key columns only."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys owning more than ``hot_rows`` rows, at most total / hot_rows of them, with the parts ``_parts`` each is cut into."""
    present = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    counted = present.groupBy(*keys).count().filter(F.col("count") > hot_rows)
    return counted.select(*keys, F.ceil(F.col("count") / F.lit(max(hot_rows, 1))).cast("int").alias("_parts"))


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, stored: bool = False) -> DataFrame:
    """Join ``df`` with a lookup that has one row per key, whatever the spread of keys in ``df``.

    The lookup is stored once (unless it is read from storage already: ``stored``), so that counting it doesn't work it out again.  One within the broadcast bounds is
    broadcast.  Otherwise, if some key owns more than ``hot_rows`` rows, the rows of hot keys get a salt and meet one copy
    of their lookup row per salt, while all other rows are joined by key as usual.
    """
    keys = list(keys)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the rows of its left side, not {how!r}")
    lookup = lookup if stored else materialize(lookup, "lookup")
    if fits_broadcast(lookup):
        return df.join(F.broadcast(lookup), keys, how)
    largest = largest_group(df, keys)
    if largest <= hot_rows:
        return df.join(lookup, keys, how)
    return _salted_join(df, lookup, keys, how, hot_rows, -(-largest // max(hot_rows, 1)))


def row_salt(df: DataFrame, salts: Column) -> Column:
    """A number below ``salts`` from the row's own values: the same if a task runs again, whatever partition the row is in."""
    hashed = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*hashed), salts.cast("bigint")).cast("int")


def _salted_join(df: DataFrame, lookup: DataFrame, keys: list[str], how: str, hot_rows: int, most: int) -> DataFrame:
    hot = maybe_broadcast(materialize(hot_keys(df, keys, hot_rows), "hot-keys"))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])  # matches nothing, goes anywhere
    parts = F.when(no_key, F.lit(most)).otherwise(F.coalesce("_parts", F.lit(1)))
    left = df.join(hot, keys, "left").withColumn("_salt", row_salt(df, parts)).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def unique_or_raise(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """``df`` unchanged, failing when read if two rows share a key.

    Keys are counted with a combined aggregate, so a key repeated very often is noticed without gathering its rows.
    """
    keys = list(keys)
    others = [F.first(c).alias(c) for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), *others)
    guard = F.when(F.col("_count") > 1, F.raise_error(F.lit(message))).otherwise(F.lit(True))
    return counted.filter(guard).select(*df.columns)
