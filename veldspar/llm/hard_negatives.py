"""Hard negatives by Fagin's threshold algorithm.

Each anchor's first rows of its own label are its positives; its negatives for a positive are the best rows of other labels whose score lies in a window below the
positive's score.  Both are top-k searches by integer inner product.  A block of candidates holds one list per dimension, sorted by that component.  For an anchor the
lists are read in step, from the end its component's sign asks for; every row seen first is scored by random access, and the scores the rows at the reading
places would add up to are the threshold no unseen row can exceed.  A search ends once the threshold is strictly below the k-th score of every window (below the window's
floor, where the window holds fewer), so ties are never cut off.

Positives meet within their label: blocks are of one label, and the units are (label, block of anchors, block of candidates).  Negatives meet as (block of anchors,
block of candidates).  Blocks are dealt by a hash of the row and bounded, so a label with a third of all rows is only more blocks; a unit returns at most k rows per
window.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part; vectors of different length are not compared; an anchor is not
its own positive, a repeated row is; equal scores go by id, null ids last, then by row; an anchor without a positive, a positive without a negative and an empty table
give no rows; components too large for exact sums are an error (``vectors.LARGEST``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.tables import keyed, prepare_workers, stored
from veldspar.llm.vectors import blocked, integers, matrix, numbered, same_type, usable

SCALE = 256
# Rows of a block of candidates and of anchors, and rows read from each list at first.
BLOCK, ANCHORS, FIRST_READ = 4096, 512, 8
NO_ID = np.iinfo(np.int64).max


class Lists:
    """A block's rows and, for each dimension, their numbers sorted by that component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.sorted = np.argsort(x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(x, self.sorted.T, 0).T

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row numbers, scores) of the allowed rows seen until no unseen row can enter any window's first k, and how many rows were scored."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, self.x.dtype)]
        depth, step = 0, FIRST_READ if len(up) + len(down) else n
        while depth < n:
            to = min(n, depth + step)
            if step < n:
                fresh = np.zeros(n, bool)
                fresh[self.sorted[up, n - to:n - depth]] = True
                fresh[self.sorted[down, depth:to]] = True
                new = np.flatnonzero(fresh & ~seen)
            else:
                new = np.flatnonzero(~seen)
            seen[new] = True
            new = new[allowed[new]]
            rows.append(new)
            scores.append(self.x[new] @ anchor)
            depth, step = to, step * 2
            threshold = self.values[up, n - to] @ anchor[up] + self.values[down, to - 1] @ anchor[down]
            if depth < n and self._done(np.concatenate(scores), threshold, windows, k):
                break
        return np.concatenate(rows), np.concatenate(scores), int(seen.sum())

    @staticmethod
    def _done(scores: np.ndarray, threshold: float, windows: np.ndarray, k: int) -> bool:
        for low, high in windows:
            inside = scores[(scores >= low) & (scores <= high)]
            kth = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low
            if not threshold < kth:
                return False
        return True


def _first(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([keys, ids, -scores])[:k]


def _ids(column: pa.Array) -> np.ndarray:
    return np.where(np.asarray(column.is_null()), NO_ID, column.fill_null(0).to_numpy(zero_copy_only=False))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r] for name in batch.schema.names}
            size = row["size"].as_py()
            unit = {name: value.values if isinstance(value, pa.ListScalar) else value.as_py() for name, value in row.items()}
            for side in ("", "a_"):
                unit[side + "x"] = matrix(unit[side + "vec"].to_numpy(zero_copy_only=False), len(unit[side + "key"]), size)
            unit["x"], unit["a_x"] = same_type(unit["x"], unit["a_x"])
            yield unit, size


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in whole], names=names)


def _met(candidates: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Every block of candidates with every block of anchors; the pair of blocks is the key, so units spread whatever the number of blocks of one side."""
    c = candidates.withColumn("a_block", F.explode(numbered(F.col("a_blocks"))))
    a = anchors.withColumn("c_block", F.explode(numbered(F.col("c_blocks"))))
    return c.join(a.drop("a_blocks", "c_blocks"), ["size", *by, "a_block", "c_block"])


def _spread(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key"), blocks).cast("int")


def _positives(rows: DataFrame, k: int, block: int, anchors_in_block: int) -> DataFrame:
    """(a_key, anchor_id, label, p_key, positive_id, positive_score): the first k other rows of each anchor's label."""
    counts = stored(rows.groupBy("size", "label").agg(F.ceil(F.count("*") / block).alias("c_blocks"), F.ceil(F.count_if("is_anchor") / anchors_in_block).alias("a_blocks")),
                    "label-counts").filter("a_blocks > 0")
    known = rows.join(counts, ["size", "label"])
    c = blocked(known.withColumn("c_block", _spread(F.col("c_blocks"))), ["label", "a_blocks"], "c_block", ["key", "id"])
    a = known.filter("is_anchor").withColumn("a_block", _spread(F.col("a_blocks")))
    a = blocked(a, ["label", "c_blocks"], "a_block", ["key", "id"])
    a = a.select("size", "label", "c_blocks", "a_block", F.col("key").alias("a_key"), F.col("id").alias("a_id"), F.col("vec").alias("a_vec"))

    def search(batches):
        everything = np.array([[-np.inf, np.inf]])
        for unit, _ in _units(batches):
            lists, keys, ids = Lists(unit["x"]), unit["key"].to_numpy(), _ids(unit["id"])
            out = [[] for _ in range(4)]
            a_keys = unit["a_key"].to_numpy()
            for i, anchor in enumerate(unit["a_x"]):
                found, scores, _ = lists.search(anchor, keys != a_keys[i], everything, k)
                best = _first(scores, ids[found], keys[found], k)
                for column, values in zip(out, (np.full(len(best), a_keys[i]), keys[found[best]], ids[found[best]], scores[best])):
                    column.append(values)
            yield _batch(["a_key", "p_key", "p_id", "positive_score"], out)

    near = _met(c, a, ["label"]).mapInArrow(search, "a_key long, p_key long, p_id long, positive_score long")
    order = Window.partitionBy("a_key").orderBy(F.desc("positive_score"), "p_id", "p_key")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
    return near


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, block: int = BLOCK, anchors_in_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the first negatives with
    low * positive_score <= 100 * negative_score <= high * positive_score.  ``is_anchor`` is over the column ``id``."""
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = vectors.filter(usable(vec_col) & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(vec_col, scale).alias("vec"))
    rows = rows.withColumn("size", F.size("vec")).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = stored(keyed(rows), "labelled-vectors")
    positives = stored(_positives(rows, n_positives, block, anchors_in_block), "positives")

    # an anchor's windows, each score once
    wanted = positives.groupBy(F.col("a_key").alias("key")).agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    asked = stored(rows.filter("is_anchor").join(wanted, "key"), "anchors")
    sizes = stored(rows.groupBy("size").agg(F.ceil(F.count("*") / block).alias("c_blocks")).join(
        asked.groupBy("size").agg(F.ceil(F.count("*") / anchors_in_block).alias("a_blocks")), "size"), "sizes")
    c = blocked(rows.join(F.broadcast(sizes), "size").withColumn("c_block", _spread(F.col("c_blocks"))), ["a_blocks"], "c_block", ["key", "id", "label"])
    a = blocked(asked.join(F.broadcast(sizes), "size").withColumn("a_block", _spread(F.col("a_blocks"))), ["c_blocks"], "a_block", ["key", "label", "scores"])
    a = a.select("size", "c_blocks", "a_block", F.col("key").alias("a_key"), F.col("label").alias("a_label"), "scores", F.col("vec").alias("a_vec"))

    def search(batches):
        for unit, _ in _units(batches):
            lists, keys, ids = Lists(unit["x"]), unit["key"].to_numpy(), _ids(unit["id"])
            labels, a_labels, a_keys = unit["label"].to_numpy(), unit["a_label"].to_numpy(), unit["a_key"].to_numpy()
            out = [[] for _ in range(5)]
            for i, anchor in enumerate(unit["a_x"]):
                scores = unit["scores"][i].values.to_numpy()
                # whole scores between the window's ends: low * p <= 100 * n <= high * p
                windows = np.stack([-(-low * scores // 100), high * scores // 100], 1)
                asked_for = np.flatnonzero(windows[:, 0] <= windows[:, 1])
                found, got, _ = lists.search(anchor, labels != a_labels[i], windows[asked_for], n_negatives)
                for w in asked_for:
                    inside = np.flatnonzero((got >= windows[w, 0]) & (got <= windows[w, 1]))
                    best = inside[_first(got[inside], ids[found[inside]], keys[found[inside]], n_negatives)]
                    size = len(best)
                    for column, values in zip(out, (np.full(size, a_keys[i]), np.full(size, scores[w]), keys[found[best]], ids[found[best]], got[best])):
                        column.append(values)
            yield _batch(["a_key", "positive_score", "n_key", "n_id", "negative_score"], out)

    near = _met(c, a, []).mapInArrow(search, "a_key long, positive_score long, n_key long, n_id long, negative_score long")
    order = Window.partitionBy("a_key", "positive_score").orderBy(F.desc("negative_score"), "n_id", "n_key")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    named = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    anchor_ids = rows.filter("is_anchor").select(F.col("key").alias("a_key"), F.col("id").alias("anchor_id"))
    return positives.join(near, ["a_key", "positive_score"]).join(anchor_ids, "a_key").select(
        "anchor_id", named("p_id").alias("positive_id"), "rank", named("n_id").alias("negative_id"), "positive_score", "negative_score")
