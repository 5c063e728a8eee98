"""N-gram Jaccard join by MinHash banding.

A document is the set of its ``N`` consecutive lower-cased words (all of its words if it has fewer); two documents are linked if the Jaccard
similarity of the sets reaches the threshold.  Texts with the same words are one class and are compared once.  Signatures are cut into
bands; their number and length follow from the wanted recall at the threshold.  Classes that share a band hash are candidates and are verified
on the full n-gram sets, inside the units of ``pairs``.

Documents are read twice: for the signatures, and for the n-grams of those classes that have a candidate.

Defined cases: null or empty text and texts without words have no n-grams, are linked with nothing and are groups of their own; repeated rows are copies of one
another, whatever their ids; a null id is kept, and a group is named by its smallest id (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm import pairs
from veldspar.llm.components import connected_components
from veldspar.llm.decontaminate import HashFilter
from veldspar.llm.tables import keyed, prepare_workers, stored
from veldspar.llm.text import Words, mix, signed, slices

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold meets in one of them with the wanted chance."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        meet = threshold ** rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def sets_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each document's different n-grams, sorted within the document."""
    hashes, whole = words.grams(n)
    size = np.diff(words.offsets)
    rows = np.repeat(np.arange(len(size)), size)
    short = np.flatnonzero((size > 0) & (size < n))
    hashes, rows = hashes[whole], rows[whole]
    extra = []
    for i in short:
        value = np.uint64(size[i])
        for h in words.hash[words.offsets[i]:words.offsets[i + 1]].tolist():
            value = np.uint64((int(value) * 0xD6E8FEB86659FD93 + h) & 0xFFFFFFFFFFFFFFFF)
        extra.append(value)
    hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
    rows = np.concatenate([rows, short])
    order = np.lexsort([hashes, rows])
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(len(size) + 1))


def _signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each document that has n-grams."""
    some = np.flatnonzero(np.diff(offsets))
    rng = np.random.default_rng(17)
    out = np.zeros((len(some), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(some), b + 1, np.uint64)
        for _ in range(rows):
            a, c = (rng.integers(1, 1 << 63, dtype=np.uint64) for _ in range(2))
            spread = (hashes ^ c) * (a | np.uint64(1))
            spread ^= spread >> np.uint64(32)
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(spread, offsets[:-1][some]))
        out[:, b] = value
    return out


def _class(words: Words, row: int) -> bytes:
    return hashlib.blake2b(words.hash[words.offsets[row]:words.offsets[row + 1]].tobytes(), digest_size=16).digest()


def _describe(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc, row, class, grams, bands) of every document."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches):
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                hashes, cut = sets_of(words, n)
                size = np.diff(cut)
                buckets = _signatures(hashes, cut, bands, rows)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(buckets.ravel())))
                classes = pa.array([_class(words, i) for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in names), classes, pa.array(size.astype(np.int64)), lists],
                                                 [*names, "class", "grams", "bands"])

    return docs.mapInArrow(run, f"{fields}, class binary, grams long, bands array<long>")


def _class_sets(docs: DataFrame, near: HashFilter, n: int) -> DataFrame:
    """(class, set) of the documents whose class passes the filter, each class once per batch."""
    shared = docs.sparkSession.sparkContext.broadcast(near)

    def run(batches):
        for batch in batches:
            sent: set[bytes] = set()
            for lo, hi, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets)
                classes = [_class(words, i) for i in range(hi - lo)]
                head = np.array([int.from_bytes(c[:8], "little") for c in classes], np.uint64)
                keep = np.zeros(hi - lo, bool)
                for i in shared.value.might_hold(head):
                    keep[i] = classes[i] not in sent
                    sent.add(classes[i])
                if not keep.any():
                    continue
                hashes, cut = sets_of(words, n)
                size = np.diff(cut)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]), pa.int32()), pa.array(signed(hashes[np.repeat(keep, size)])))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, k in zip(classes, keep) if k], pa.binary()), lists], ["class", "set"])

    return docs.select("text").mapInArrow(run, "class binary, set array<long>")


def jaccard_verifier(threshold: float) -> pairs.Verify:
    def verify(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lists = table["set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        size = np.diff(offsets)
        good = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        out = np.zeros(len(i), bool)
        has = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int32)
        at = np.flatnonzero(good)
        at = at[np.argsort(i[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(i[at], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(at))):
            first = i[at[lo]]
            own = ids[offsets[first]:offsets[first + 1]]
            has[own] = 1
            for part in range(lo, hi, 512):
                some = at[part:min(hi, part + 512)]
                others = j[some]
                take = np.repeat(offsets[others], size[others]) + np.arange(size[others].sum()) - np.repeat(np.cumsum(size[others]) - size[others], size[others])
                both = np.add.reduceat(has[ids[take]], np.cumsum(size[others]) - size[others])
                out[some] = both >= threshold * (len(own) + size[others] - both) - 1e-9
            has[own] = 0
        return out

    return verify


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
                   row_col: str | None = None) -> DataFrame:
    """id_col, [row_col], key, item (class), group_key, class_id (smallest id of the group), n_links, n_copies of every document row.

    n_links counts the other documents that are linked with this one, its copies included.
    """
    prepare_workers(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(F.col(id_col).alias("doc"), *([F.col(row_col).alias("row")] if row_col else []), F.col(text_col).cast("string").alias("text"))
    every = stored(keyed(_describe(own, n, bands, rows)), "signatures")
    classes = every.filter("grams > 0").groupBy("class", "bands").agg(F.min("key").alias("item"), F.count("*").alias("copies"), F.first("grams").alias("load"))
    classes = stored(classes, "classes")
    tokens = classes.select("item", F.explode("bands").alias("bucket"))
    found = pairs.candidates(tokens)
    items = stored(found.join(classes.withColumnRenamed("bands", "buckets"), "item"), "candidates")
    sets = _class_sets(own, _class_filter(items), n)
    sets = sets.join(items.select("class", "item"), "class").groupBy("item").agg(F.first("set").alias("set"))
    work = items.select("item", "copies", "buckets").join(sets, "item").join(pairs.units(items), "item")
    links = stored(pairs.link(work, jaccard_verifier(threshold)), "links")
    sums = links.groupBy("item").agg(F.sum("linked_copies").alias("linked"))
    groups = connected_components(links.filter("item <> root"), "item", "root").select(F.col("node").alias("item"), "component")
    of_class = classes.select("class", "item", "copies").join(sums, "item", "left").join(groups, "item", "left")
    rows_ = every.drop("bands").join(of_class, "class", "left").withColumn("group_key", F.coalesce("component", "item", "key"))
    rows_ = stored(rows_.select("doc", *(["row"] if row_col else []), "key", "item", "group_key", "copies", "linked"), "grouped")
    # stored, so that the join has two plain sides and a large group is split
    names = stored(rows_.groupBy("group_key").agg(F.min("doc").alias("class_id")), "group-names")
    n_links = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return rows_.join(names, "group_key").select(F.col("doc").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), "key", "item", "group_key",
                                                 "class_id", n_links.alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def _class_filter(items: DataFrame) -> HashFilter:
    """A filter over the classes of the candidates."""
    n = items.count()

    def build(batches):
        own = HashFilter(n)
        for batch in batches:
            own.add(np.array([int.from_bytes(c[:8], "little") for c in batch.column(0).to_pylist()], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], pa.binary())], ["bits"])

    whole = HashFilter(n)
    for row in items.select("class").coalesce(max(1, min(16, n // 100_000))).mapInArrow(build, "bits binary").toLocalIterator():
        whole.bits |= np.frombuffer(row["bits"], np.uint8)
    return whole
