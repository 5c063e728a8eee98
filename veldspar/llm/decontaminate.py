"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` words, one at each word; a shorter item is one window.  A window is the set of its shingles of
``SHINGLE`` words at their places (a window of fewer words is one shingle).  A document window of the same number of words contains all of them or isn't
a match, so for each window it is enough to join one shingle, the prefix: the rarest in the corpus, counted over all documents.  The shingle's place in
the window fixes where the document window would begin; length and position bounds drop those that don't fit into the document, and the rest is
compared word by word.

Documents are read twice, for the counts and for the candidates.  Tasks find places worth joining with a filter of fixed size over the
shingles of the benchmark (at most ``FILTER_BITS`` bits, false hits fall out at the join), so no part of the benchmark has to fit a
broadcast.  A candidate carries the words around it.

Defined cases: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null or empty text and a text without words have no words and no hits; an
item without words has no window; items with the same window all count; a null item id marks words but isn't listed; repeated documents and ids are judged
row by row; an empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.tables import keyed, prepare_workers, stored
from veldspar.llm.text import Words, signed, slices

WINDOW = 10
SHINGLE = 3
FILTER_BITS = 1 << 28
WORDS_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class HashFilter:
    """Bloom filter over 64-bit hashes: its size follows their number up to a fixed bound."""

    def __init__(self, expected: int, most_bits: int = FILTER_BITS, shifts: tuple[int, ...] = (0, 20)):
        self.shifts = shifts
        self.log = min(max(10, math.ceil(math.log2(max(1, expected) * 16))), int(math.log2(most_bits)))
        self.bits = np.zeros(1 << (self.log - 3), np.uint8)

    def _place(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes << np.uint64(shift) if shift else hashes) >> np.uint64(64 - self.log)).view(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for shift in self.shifts:
            place = self._place(hashes, shift)
            byte, bit = place >> 3, np.uint8(1) << (place & 7).astype(np.uint8)
            while len(byte):  # of several bits of one byte the last one is set, the others are tried again
                self.bits[byte] |= bit
                lost = np.flatnonzero((self.bits[byte] & bit) == 0)
                byte, bit = byte[lost], bit[lost]

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Positions that pass."""
        at = None
        for shift in self.shifts:
            place = self._place(hashes if at is None else hashes[at], shift)
            good = np.flatnonzero(self.bits.take(place >> 3) >> (place & 7).astype(np.uint8) & np.uint8(1))
            at = good if at is None else at[good]
        return at

    def folded(self) -> HashFilter:
        """The same hashes in an eighth of the space."""
        out = HashFilter(0, shifts=self.shifts)
        out.log, out.bits = self.log - 3, np.packbits(self.bits != 0, bitorder="little")
        return out


def filter_of(column: DataFrame) -> HashFilter:
    """A filter over a stored column of longs, joined from one filter per task."""
    n = column.count()
    name = column.columns[0]

    def build(batches):
        own = HashFilter(n)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], pa.binary())], ["bits"])

    parts = max(1, min(16, n // 100_000))  # each part sends a filter to the driver
    whole = HashFilter(n)
    for row in column.select(name).coalesce(parts).mapInArrow(build, "bits binary").toLocalIterator():
        whole.bits |= np.frombuffer(row["bits"], np.uint8)
    return whole


def _shingles(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the shingle, hashes at each word, whether it lies within the document) for 1 .. SHINGLE words."""
    out = []
    for n in range(1, SHINGLE + 1):
        hashes, whole = words.grams(n)
        out.append((n, hashes, whole))
    return out


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Different windows: window (key), words, and the shingles (hash, place) to choose from; with the ids of their items."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(text, F.lit(WORDS_PATTERN), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    rows = rows.withColumn("s", F.explode(starts)).select("item", F.slice("w", F.col("s"), WINDOW).alias("words")).distinct()
    return rows


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, words, shingle, place) for all shingles of stored windows (window, words)."""

    def cut(batches):
        for batch in batches:
            keys, texts = batch.column(0), pa.array([" ".join(w) for w in batch.column(1).to_pylist()], pa.string())
            for lo, hi, data, offsets in slices(texts):
                words = Words(data, offsets)
                size = np.diff(words.offsets)
                row = np.repeat(np.arange(hi - lo), size)
                place = np.arange(len(row)) - words.offsets[:-1][row]
                of, at, shingle = [], [], []
                for n, hashes, whole in _shingles(words):
                    good = whole & (np.minimum(size, SHINGLE)[row] == n)
                    of.append(row[good])
                    at.append(place[good])
                    shingle.append(hashes[good])
                of = lo + np.concatenate(of)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(signed(np.concatenate(shingle))),
                                                  pa.array(np.concatenate(at).astype(np.int32))], ["window", "words", "shingle", "place"])

    return windows.select("window", "words").mapInArrow(cut, "window long, words array<string>, shingle long, place int")


def _corpus_counts(docs: DataFrame, near: HashFilter) -> DataFrame:
    """(shingle, n) over all documents for the shingles that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(near)

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = []
                for _, hashes, whole in _shingles(Words(data, offsets)):
                    at = shared.value.might_hold(hashes)
                    found.append(hashes[at[whole[at]]])
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, near: HashFilter) -> DataFrame:
    """Every document with its number of words and the places whose shingle passes the filter, each with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(near)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def find(batches):
        item = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.string())])
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                low = words.data.tobytes()
                size = np.diff(words.offsets)
                row = np.repeat(np.arange(hi - lo), size)
                ats, hash_ = [], []
                for _, hashes, whole in _shingles(words):
                    at = shared.value.might_hold(hashes)
                    at = at[whole[at]]
                    ats.append(at)
                    hash_.append(hashes[at])
                at, hash_ = np.concatenate(ats), np.concatenate(hash_)
                order = np.argsort(at, kind="stable")
                at, hash_ = at[order], hash_[order]
                first, last = words.offsets[:-1][row[at]], words.offsets[1:][row[at]]
                a, b = np.maximum(first, at - WINDOW + 1), np.minimum(last, at + WINDOW)
                around = [" ".join([low[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[x:y].tolist(), words.ends[x:y].tolist())])
                          for x, y in zip(a.tolist(), b.tolist())]
                found = pa.StructArray.from_arrays([pa.array(signed(hash_)), pa.array((at - first).astype(np.int32)), pa.array((a - first).astype(np.int32)),
                                                    pa.array(around, pa.string())], fields=list(item))
                ends = np.searchsorted(row[at], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in names), pa.array(size.astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], [*names, "n_words", "found"])

    schema = f"{fields}, n_words long, found array<struct<shingle: long, at: int, first: int, words: string>>"
    return docs.mapInArrow(find, schema)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """key, id_col, [row_col], n_words, spans (array of first and end word of the hit runs), n_hit, items (sorted ids) of every document row."""
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)
    row = [F.col(row_col).alias("row")] if row_col else []
    docs = docs.select(F.col(id_col).alias("doc"), *row, F.col(text_col).cast("string").alias("text"))
    of_items = stored(item_windows(items, item_col, item_text_col), "item-windows")
    windows = stored(of_items.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    shingles = stored(_window_shingles(windows), "window-shingles")
    counts = _corpus_counts(docs, filter_of(shingles.select("shingle")))
    # The prefix of a window that must be contained whole is one shingle, the rarest.
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")
    prefix = shingles.join(counts, "shingle", "left").groupBy("window").agg(F.min(rarity).alias("p"), F.first("words").alias("needle"))
    prefix = stored(prefix.filter("p.n > 0").select("window", "needle", F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place")), "prefixes")
    found = stored(keyed(_candidates(docs, filter_of(prefix.select("shingle")))), "candidates")
    c = found.filter("size(found) > 0").select("key", "n_words", F.explode("found").alias("c")).select("key", "n_words", "c.*")
    start = F.col("at") - F.col("place")
    at = start - F.col("first")
    c = c.join(prefix, "shingle").filter((start >= 0) & (start + F.size("needle") <= F.col("n_words")))
    hits = c.filter(F.slice(F.split("words", " "), at + 1, F.size("needle")) == F.col("needle"))
    hits = stored(hits.select("key", "window", start.alias("a"), (start + F.size("needle")).alias("b")).distinct(), "hits")
    runs = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    # one pass over a document's own hits, sorted: join those that overlap or touch
    empty = F.expr("cast(array() as array<struct<a: int, b: int>>)")
    merge = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))
    ).otherwise(F.concat(acc, F.array(x)))
    runs = runs.select("key", F.aggregate("runs", empty, merge).alias("spans"))
    keys = of_items.join(windows, "words").select("window", "item").filter("item IS NOT NULL")
    listed = hits.select("key", "window").distinct().join(keys, "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    row = ["row"] if row_col else []
    out = found.select("key", "doc", *row, "n_words").join(runs, "key", "left").join(listed, "key", "left")
    n_hit = F.aggregate(F.coalesce("spans", empty), F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    row = [F.col("row").alias(row_col)] if row_col else []
    return out.select("key", F.col("doc").alias(id_col), *row, "n_words", F.coalesce("spans", empty).alias("spans"), n_hit.alias("n_hit"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
