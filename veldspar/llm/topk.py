"""Exact top-k by inner product with pivot-table elimination.

Vectors become integers.  Distances of every vector to many pivots are computed once, with its block; for a query the
largest |d(query, pivot) - d(vector, pivot)| bounds their distance from below and so their inner product from above.  Candidates of a block are
evaluated in the order of that bound until the k-th best score is above every bound that is left.

Queries and candidates meet in blocks: vectors are packed into rows of at most ``BLOCK`` vectors each, and every block of queries is joined with every block of
candidates by the query block's number.  A task holds two blocks; it returns at most k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor as candidate; an empty vector's score with another empty
one is 0; vectors of different length are not compared; every row but the query's own is a candidate, also rows with the same id; ties go to the smaller id, then null
ids; a null id is no query; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.tables import keyed, prepare_workers, stored

SCALE = 1024
BLOCK = 2048
PIVOTS = 64
# Vectors among which the pivots are chosen.
PIVOT_SAMPLE = 2048
FIRST_EVALUATED = 64


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(key, id, vec) with floor(scale * x) as 64-bit integers; unusable vectors are left out.  Keys are stable once stored."""
    x = F.col(vec_col).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return stored(keyed(vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), ints.alias("vec"))), "vectors")


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """By dimension: rows of a bounded sample that are far from each other."""
    got = vectors.select("vec").orderBy(F.xxhash64("vec", "key")).limit(sample).toArrow()["vec"]
    by_size: dict[int, list] = {}
    for v in got:
        by_size.setdefault(len(v), []).append(v.values.to_numpy())
    out = {}
    for size, rows in by_size.items():
        x = np.array(rows, float).reshape(len(rows), size)
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[size] = x[chosen]
    return out


def _blocks(rows: DataFrame, number: Column, names: tuple[str, str, str, str, str]) -> DataFrame:
    """At most about BLOCK rows of equal length per block: size, block, keys, ids, values."""
    rows = rows.withColumn("size", F.size("vec")).withColumn("block", number)
    of = F.collect_list(F.struct("key", "id", "vec"))
    got = rows.groupBy("size", "block").agg(of.alias("r"))
    return got.select(F.col("size").alias(names[0]), F.col("block").alias(names[1]), F.col("r.key").alias(names[2]), F.col("r.id").alias(names[3]),
                      F.flatten("r.vec").alias(names[4]))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((len(x), len(pivots)))
    square = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def _best(q: np.ndarray, q_key: np.ndarray, q_far: np.ndarray, c: np.ndarray, c_key: np.ndarray, c_id: np.ndarray, c_far: np.ndarray, k: int):
    """(query, candidate, score) of the k best of a block for each query; candidates are evaluated in the order of their bounds."""
    low = np.zeros((len(q), len(c)))
    for p in range(q_far.shape[1]):
        np.maximum(low, np.abs(q_far[:, p, None] - c_far[None, :, p]), out=low)
    q_square, c_square = (q * q).sum(1), (c * c).sum(1)
    # Rounding is far below one unit in the score; the slack keeps the bound an upper one.
    slack = 1 + 1e-9 * (q_square.max(initial=0) + c_square.max(initial=0))
    high = (q_square[:, None] + c_square[None] - low * low * (1 - 1e-9)) / 2 + slack
    for i in range(len(q)):
        order = np.argsort(-high[i], kind="stable")
        at, step = 0, FIRST_EVALUATED
        found, score = np.zeros(0, int), np.zeros(0)
        while at < len(order):
            some = order[at:at + step]
            at, step = at + step, step * 2
            found = np.concatenate([found, some])
            score = np.concatenate([score, c[some] @ q[i]])
            keep = c_key[found] != q_key[i]
            found, score = found[keep], score[keep]
            best = np.lexsort([c_id[found], -score])[:k]
            found, score = found[best], score[best]
            # equal scores may win by their id, so stop only when every bound that is left is lower
            if len(found) == k and (at >= len(order) or high[i, order[at]] < score[-1]):
                break
        yield np.full(len(found), i), found, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which ``is_query`` (over the column ``id``) holds."""
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    total = rows.count()
    queries = rows.filter(F.coalesce(is_query, F.lit(False)))
    n_queries = queries.count()
    c_blocks, q_blocks = max(1, -(-total // BLOCK)), max(1, -(-n_queries // (BLOCK // 4)))
    spread = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    pivots = spark.sparkContext.broadcast(choose_pivots(rows))
    c = _blocks(rows, spread(c_blocks), ("size", "c_block", "c_key", "c_id", "c_vec"))
    # every block of queries is named in each block of candidates, so that they meet by equality
    c = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = _blocks(queries, spread(q_blocks), ("size", "q_block", "q_key", "q_id", "q_vec"))
    pairs = c.join(q, ["size", "q_block"])

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = {n: batch.column(n)[r] for n in batch.schema.names}
                size = at["size"].as_py()
                wide = lambda n: at[n].values.to_numpy(zero_copy_only=False)
                q_key, c_key = wide("q_key"), wide("c_key")
                q, c = (wide(n).astype(float).reshape(-1, size) if size else np.zeros((len(key), 0)) for n, key in (("q_vec", q_key), ("c_vec", c_key)))
                ids = at["c_id"].values
                c_id = np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
                p = pivots.value.get(size, np.zeros((0, size)))
                found = [np.concatenate(x) for x in zip(*_best(q, q_key, _distances(q, p), c, c_key, c_id, _distances(c, p), k))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_key[found[0]]), at["q_id"].values.take(pa.array(found[0])), ids.take(pa.array(found[1])), pa.array(c_key[found[1]]),
                     pa.array(np.rint(found[2]).astype(np.int64))], ["q_key", "query_id", "vec_id", "c_key", "score"])

    near = pairs.mapInArrow(search, "q_key long, query_id long, vec_id long, c_key long, score long")
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_key")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
