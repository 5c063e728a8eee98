"""Verify candidate pairs inside groups of any size without emitting them.

Items that share a bucket are candidates.  Components over "shares a bucket" keep all candidate pairs together; a component is cut
into blocks of bounded load, and every two blocks that share a bucket become one unit of work (small components share a unit).
A unit verifies its pairs in one task and returns one row per item: how many links it found and the smallest item it is linked with, so
results grow with the items, not with the pairs.  Each pair is verified in one unit only.

An item is copied once for every block that shares a bucket with its own; a group of n items alike costs n * n / block
rows, the price of counting its links exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.components import connected_components
from veldspar.llm.tables import prepare_workers, stored

# Load (of the caller's unit) and items of one block.
BLOCK_LOAD = 400_000
BLOCK_ITEMS = 1_500

Verify = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def candidates(tokens: DataFrame) -> DataFrame:
    """(item, component) of the items that share a bucket with another one; ``tokens`` has item and bucket, stored."""
    heads = tokens.groupBy("bucket").agg(F.min("item").alias("head"), F.max("item").alias("last")).filter("head <> last")
    star = tokens.join(heads.select("bucket", "head"), "bucket").filter("item <> head").select("item", "head")
    return connected_components(star, "item", "head").withColumnRenamed("node", "item")


def units(items: DataFrame, block_load: int = BLOCK_LOAD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, unit, side) for stored ``items`` (item, component, load, buckets).

    With a column ``band``, a whole number, blocks hold items of one band, so if few bands share buckets few blocks do.
    """
    totals = items.groupBy("component").agg(F.sum("load").alias("load"), F.count("*").alias("n"))
    need = F.ceil(F.greatest(F.col("load") / block_load, F.col("n") / block_items)).cast("long")
    totals = stored(totals.withColumn("blocks", F.greatest(need, F.lit(1))), "components")
    small = totals.filter("blocks = 1").agg(F.coalesce(F.sum("load"), F.lit(0)).alias("load"), F.count("*").alias("c"),
                                            F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    shards = max(1, -(-small["load"] // block_load), -(-small["n"] // block_items))
    placed = items.join(totals.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    alone = placed.filter("blocks = 1").select("item", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(shards))).alias("unit"),
                                               F.lit(0).alias("side"))
    if not totals.filter("blocks > 1").limit(1).count():
        return alone
    large = placed.filter("blocks > 1")
    if "band" in items.columns:
        sizes = large.groupBy("component", "band").agg(F.sum("load").alias("l"), F.count("*").alias("n"))
        sizes = sizes.select("component", "band", F.ceil(F.greatest(F.col("l") / block_load, F.col("n") / block_items)).cast("long").alias("of"))
        large = large.join(sizes, ["component", "band"])
        large = large.withColumn("block", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("item"), F.greatest("of", F.lit(1))))
    seen = stored(large.select("component", "block", F.explode("buckets").alias("bucket")).distinct(), "bucket-blocks")
    other = seen.select("component", "bucket", F.col("block").alias("to"))
    pairs = seen.join(other, ["component", "bucket"]).filter(F.col("block") < F.col("to")).select("component", "block", "to")
    own = seen.select("component", "block", F.col("block").alias("to"))
    pairs = stored(pairs.union(own).distinct(), "block-pairs").withColumn("unit", F.concat_ws("-", "component", "block", "to"))
    sides = pairs.select("component", "block", "unit", F.lit(0).alias("side")).union(
        pairs.filter(F.col("block") < F.col("to")).select("component", F.col("to").alias("block"), "unit", F.lit(1).alias("side")))
    return alone.union(large.join(sides, ["component", "block"]).select("item", "unit", "side"))


def _candidate_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = table.num_rows
    side = table["side"].to_numpy()
    lists = table["buckets"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    ends = np.append(starts[1:], len(flat))
    cross = bool(side.any())
    marked = np.zeros((n, n), bool)
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        group = row[a:b]
        if cross:
            marked[np.ix_(group[side[group] == 0], group[side[group] == 1])] = True
        else:
            marked[np.ix_(group, group)] = True
    if not cross:
        marked |= marked.T
        marked = np.triu(marked, 1)
    return np.nonzero(marked)


def link(rows: DataFrame, verify: Verify) -> DataFrame:
    """(item, root, links, linked_copies) of ``rows`` (unit, side, item, copies, buckets, and what ``verify`` reads)."""
    prepare_workers(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        i, j = _candidate_pairs(table)
        good = verify(table, i, j) if len(i) else np.zeros(0, bool)
        i, j = i[good], j[good]
        item, copies = table["item"].to_numpy(), table["copies"].to_numpy()
        links, linked = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for a, b in ((i, j), (j, i)):
            np.add.at(links, a, 1)
            np.add.at(linked, a, copies[b])
        root = item.copy()
        while True:  # smallest item within the unit's links
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (before == root).all():
                break
        some = links > 0
        return pa.table({"item": item[some], "root": root[some], "links": links[some], "linked_copies": linked[some]})

    return rows.groupBy("unit").applyInArrow(run, "item long, root long, links long, linked_copies long")
