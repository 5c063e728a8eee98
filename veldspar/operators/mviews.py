"""Materialized views: build, complete refresh, and incremental refresh of stored aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.skew import maybe_broadcast
from veldspar.session import materialize


def materialize_view(df: DataFrame, path: str, build: str = "IMMEDIATE") -> DataFrame:
    """BUILD IMMEDIATE stores the rows, BUILD DEFERRED an empty table of the same schema."""
    if build.upper() not in ("IMMEDIATE", "DEFERRED"):
        raise ValueError("build is IMMEDIATE or DEFERRED")
    rows = df if build.upper() == "IMMEDIATE" else df.limit(0)
    version = f"version={uuid.uuid4().hex}"
    # written beside the versions there are, so a refresh may read the view; named only when it is complete
    rows.write.parquet(f"{path}/{version}")
    named = df.sparkSession.createDataFrame([(version,)], "version string")
    named.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{version}")


def refresh_complete(df: DataFrame, path: str) -> DataFrame:
    """REFRESH COMPLETE: recompute and replace."""
    return materialize_view(df, path, "IMMEDIATE")


def read_view(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The version named last; older ones stay readable for those who have them open."""
    names = spark.read.schema("version string").parquet(f"{path}/versions")
    named = names.select("version", F.col("_metadata.file_modification_time").alias("at"))
    last = named.orderBy(F.desc("at"), F.desc("version")).first()["version"]
    return spark.read.schema(like.schema).parquet(f"{path}/{last}")


def aggregate_state(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Mergeable state per key: row count ``n`` and the named sums."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(s) for s, c in sums.items()])


def refresh_fast(mv: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """REFRESH FAST: merge a delta state (same columns; negative ``n`` for deletes) into the view.

    Averages are kept as sum and count.  Groups left without rows disappear.
    """
    measures = [c for c in mv.columns if c not in keys]
    merged = mv.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])
    return merged.filter(F.col("n") > 0).select(*mv.columns)


# --- a left join with aggregates, refreshed by what changed on either side ------------------

def join_state(parents: DataFrame, children: DataFrame, key: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Stored state of ``parents LEFT JOIN children GROUP BY parents.*``: the parent's columns, ``copies`` of the row, and per copy ``n`` and the named sums."""
    names = ["n", *sums]
    grouped = parents.groupBy(*parents.columns).agg(F.count(F.lit(1)).alias("copies"))
    joined = grouped.join(aggregate_state(children, key, sums), list(key), "left")
    return joined.select(*parents.columns, "copies", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def join_view(state: DataFrame) -> DataFrame:
    """The view's rows: counts and sums over all copies of a parent."""
    at = state.columns.index("copies")
    return state.select(*state.columns[:at], *[(F.col(c) * F.col("copies")).alias(c) for c in state.columns[at + 1:]])


def refresh_join(state: DataFrame, parents_delta: DataFrame, children: DataFrame, children_delta: DataFrame, key: Sequence[str], sums: Mapping[str, Column],
                 sign: str = "sign") -> DataFrame:
    """The state after inserts (``sign`` 1) and deletes (-1) on both sides; ``children`` is the table before its changes.

    Changed parents meet the children there were, the parents there were meet the changed children, and changed parents the changed children; both changes are
    combined per parent and per key before they meet anything.  Of ``children`` only the keys of new parents are read on; rows of the state that nothing touches pass through a
    join with the changes, which is a broadcast while these are small.  A key that is NULL joins nothing.
    """
    key, names = list(key), ["n", *sums]
    at = state.columns.index("copies")
    own = state.columns[:at]
    signed = parents_delta.groupBy(*own).agg(F.sum(sign).alias("_more")).filter("_more <> 0")
    change = materialize(signed.select(*[F.col(c).alias(f"_d_{c}") for c in own], "_more"), "parent-changes")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in own])
    moved = state.join(maybe_broadcast(change), same, "left").select(*own, (F.col("copies") + F.coalesce("_more", F.lit(0))).alias("copies"), *names)
    # parents the state doesn't know yet bring the children that were there before them
    fresh = materialize(change.join(state.select(*own), same, "left_anti").select(*[F.col(f"_d_{c}").alias(c) for c in own], F.col("_more").alias("copies")), "new-parents")
    base = aggregate_state(children.join(maybe_broadcast(materialize(fresh.select(*key).distinct(), "new-keys")), key, "left_semi"), key, sums)
    grown = moved.unionByName(fresh.join(base, key, "left").select(*own, "copies", *[F.coalesce(F.col(c), F.lit(0)).cast(state.schema[c].dataType).alias(c) for c in names]))
    weight = F.col(sign)
    more = children_delta.groupBy(*key).agg(F.sum(weight).alias("_n"), *[F.sum(c * weight).alias(f"_{s}") for s, c in sums.items()])
    more = maybe_broadcast(materialize(more, "child-changes"))
    after = grown.join(more, key, "left").select(*own, "copies", *[
        (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(state.schema[c].dataType).alias(c) for c in names])
    return after.filter("copies > 0")
