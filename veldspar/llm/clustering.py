"""Centroid clustering with Orchard's search for the nearest centroid.

For each centroid the others are sorted by their distance to it.  A vector starts at one centroid and reads that centroid's list; a closer centroid takes over at once,
its list is read from the start, and centroids already measured are skipped (they are marked).  The search stops at the first entry strictly beyond twice the
current distance: by the triangle inequality nothing behind it can be closer or as close, so ties (the smaller number wins) are exact.  Distances are squares of
integers throughout: the stop is "squared distance between centroids > 4 times the squared distance".

A round is one pass over the stored integer vectors: tasks assign their rows and return one sum per centroid and component, Spark adds them, and the driver gets one row
per (centroid, component), whatever the number of vectors; so no centroid's vectors ever meet in one place.

Defined cases: vectors that are null, of another length or hold null or non-finite components are left out; equal or repeated vectors and ids are assigned row by row; fewer
vectors than centroids give as many centroids as vectors; a null id is a start only where ids run out; an empty centroid stays where it is; an empty table gives
no rows; components too large for exact sums are an error (``vectors.LARGEST``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.tables import prepare_workers, stored
from veldspar.llm.vectors import integers, usable

# Marks (rows x centroids) held at once.
MARKS = 1 << 24


class Orchard:
    """The centroids, their distances to each other and each one's list of the others, nearest first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        gap = self.centroids[:, None, :] - self.centroids[None, :, :] if len(centroids) <= 256 else None
        self.between = (gap * gap).sum(2) if gap is not None else np.stack([((self.centroids - c) ** 2).sum(1) for c in self.centroids])
        self.lists = np.argsort(self.between, axis=1, kind="stable")
        self.start = int(self.between.sum(1, dtype=np.float64).argmin()) if len(centroids) else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row, the squared distance, and how many distances were measured."""
        portion = max(1, MARKS // max(1, len(self.centroids)))
        parts = [self._nearest(x[k:k + portion]) for k in range(0, len(x), portion)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, k = len(x), len(self.centroids)
        current = np.full(n, self.start)
        distance = ((x - self.centroids[self.start]) ** 2).sum(1)
        measured = np.zeros((n, k), bool)
        measured[:, self.start] = True
        place = np.zeros(n, np.int64)
        active = np.arange(n)
        while len(active):
            entry = self.lists[current[active], place[active]]
            going = self.between[current[active], entry] <= 4 * distance[active]
            active, entry = active[going], entry[going]
            place[active] += 1
            new = ~measured[active, entry]
            rows, other = active[new], entry[new]
            measured[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (other < current[rows]))
            rows = rows[closer]
            current[rows], distance[rows], place[rows] = other[closer], d[closer], 0
            active = active[place[active] < k]
        return current, distance, int(measured.sum())


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def first_centroids(vectors: DataFrame, k: int, seed: str, id_col: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of "<seed>:<id>", in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [list(r["vec"]) for r in vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).select("vec").collect()]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, then the exact floor of each centroid's mean; an empty centroid stays."""
    size = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(Orchard(centroids))

    def sums(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _rows(batch.column("vec"), size)
            cluster = shared.value.nearest(x)[0]
            count += np.bincount(cluster, minlength=len(count))
            order = np.argsort(cluster, kind="stable")
            full, starts = np.unique(cluster[order], return_index=True)
            if len(full):
                total[full] += np.add.reduceat(x[order], starts, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, size)), pa.array(np.tile(np.arange(size), len(full))), pa.array(total[full].ravel()),
                                          pa.array(np.repeat(count[full], size))], names=["cluster", "component", "total", "n"])

    parts = vectors.select("vec").mapInArrow(sums, "cluster long, component long, total long, n long")
    parts = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in parts.collect():  # at most centroids x components rows
        out[r["cluster"], r["component"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id",
            vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector, the final centroids)."""
    spark = vectors.sparkSession
    prepare_workers(spark)
    kept = vectors.filter(usable(vec_col) & (F.size(vec_col) == size)).select(F.col(id_col).cast("long").alias(id_col), integers(vec_col, scale).alias("vec"))
    kept = stored(kept, "kept-vectors")
    centroids = np.array(first_centroids(kept, k, seed, id_col), np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    shared = spark.sparkContext.broadcast(Orchard(centroids))

    def assign(batches):
        for batch in batches:
            found, distance, _ = shared.value.nearest(_rows(batch.column("vec"), size))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found), pa.array(distance)], names=[id_col, "cluster", "distance"])

    assigned = stored(kept.mapInArrow(assign, f"`{id_col}` long, cluster long, distance long").withColumn("cluster", F.col("cluster").cast("int")), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    inertia = sum(r["cluster_inertia"] for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, digest[r["cluster"]]) for r in totals],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
