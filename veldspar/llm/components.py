"""Connected components with DataFrame joins only.

Alternating stars: every node hangs its larger neighbours on the smallest node it knows, then itself and its smaller
neighbours on the smallest of those, until only stars are left; the number of rounds grows with the logarithm of the
longest path.  Each round is stored in the shared folder, so lineage stays short and lost executors cost one round.
Minima are combined before the shuffle; the joins that follow have both sides shuffled by the node, so a hub's rows are
split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.tables import stored


def _state(edges: DataFrame) -> tuple:
    # a sum of hashes in decimal: equal sets of edges give equal sums
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node.

    Null ends and loops are no edges; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y")
    e = stored(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
