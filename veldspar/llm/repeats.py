"""Repeated passages from suffix arrays, in bounded pieces.

Every string of ``length`` bytes is known by its anchor, the ``GRAM``-byte substring with the least hash in it; equal strings have equal anchors at the same
place.  Starts with the same anchor occurrence are a run, a run with the bytes its strings cover is a segment.  So equal strings lie in segments of equal
anchors and a suffix array is needed only over segments that share an anchor.

1. Count the anchors of all documents.  An anchor that occurs once is in no repeated string.
2. Read the documents again and keep those that hold a repeated anchor, with their runs.  Equal segments are counted; a segment that occurs
   twice is repeated as a whole.
3. Different segments with one anchor meet in units of bounded size (see ``pairs``).  A unit sorts the suffixes at the starts (prefix doubling), takes the lengths of common
   prefixes and scans them with a stack, which visits the interval tree: an interval of a common prefix of at least ``length`` bytes whose
   occurrences don't all have the same byte to their left is a maximal repeat, with all its occurrences.
4. A document's repeats are joined into spans and cut out.

Defined cases: null text is empty; texts shorter than ``length`` have no repeats; a string that occurs twice in one document is repeated, overlapping
or not; repeated rows are copies; an empty table gives no rows.  Everything counts bytes of UTF-8, so a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm import pairs
from veldspar.llm.decontaminate import HashFilter, filter_of
from veldspar.llm.tables import keyed, prepare_workers, stored
from veldspar.llm.text import Rolling, signed, slices

LENGTH = 200
GRAM = 64
# Bytes and segments of one block of a unit.
UNIT_BYTES = 600_000
UNIT_SEGMENTS = 4_000


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of the runs of starts with the same anchor occurrence."""
    total = len(data) - length + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - gram + 1)
    hashes = rolling.hash(at, at + gram)
    # hash above, place below: the least value is the leftmost of the least hashes
    least = ((hashes >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    anchor = (np.minimum(least[: len(least) - rest], least[rest:]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.repeat(offsets[1:], np.diff(offsets))[:total] - np.arange(total) >= length
    before = np.zeros(total, bool)
    before[1:] = whole[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(whole & ~before)
    stop = np.append(np.flatnonzero(~whole), total)
    end = np.minimum(np.append(first[1:], total), stop[np.searchsorted(stop, first)])
    return first, end - first, hashes[anchor[first]]


def _anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                keys, n = np.unique(runs_of(data, offsets, length, gram, Rolling(data))[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _segments(docs: DataFrame, near: HashFilter, length: int, gram: int) -> DataFrame:
    """(doc, n_bytes, sha256, text, runs) of every document; text only where an anchor passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(near)
    id_type = docs.schema["doc"].dataType
    kinds = [("lo", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64()), ("check", pa.int64())]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                rolling, second = Rolling(data), Rolling(data, True)
                first, n, anchor = runs_of(data, offsets, length, gram, rolling)
                at = shared.value.might_hold(anchor)
                first, n, anchor = first[at], n[at], anchor[at]
                end = first + n + length - 1
                row = np.searchsorted(offsets, first, "right") - 1
                found = pa.StructArray.from_arrays(
                    [pa.array(first - offsets[row]), pa.array(n.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(rolling.hash(first, end))),
                     pa.array(signed(second.hash(first, end)))], fields=[pa.field(*k) for k in kinds])
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                sums = [hashlib.sha256(t).hexdigest() for t in texts]
                kept = [t if some else None for t, some in zip(texts, np.diff(ends))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(sums, pa.string()), pa.array(kept, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["doc", "n_bytes", "sha256", "text", "runs"])

    item = "struct<lo: long, n: int, anchor: long, seg: long, check: long>"
    return docs.mapInArrow(run, f"doc {id_type.simpleString()}, n_bytes long, sha256 string, text binary, runs array<{item}>")


class SuffixArray:
    """Suffixes of ``text`` (bytes + 1, 0 ends a segment) ranked by their first ``depth`` values; ranks of each doubling are kept for common prefixes."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
        key = np.zeros(n, np.uint64)
        for k in range(7):  # nine bits a value
            key = (key << np.uint64(9)) | padded[k:n + k]
        self.text, self.steps, self.ranks = text, [7], [np.unique(key, return_inverse=True)[1]]
        while self.steps[-1] < depth:
            step, rank = self.steps[-1], self.ranks[-1]
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            self.ranks.append(np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1])
            self.steps.append(step * 2)

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``i`` and ``j``, at most ``most``."""
        n = len(self.text)
        out = np.zeros(len(i), np.int64)
        for step, rank in zip(self.steps[::-1], self.ranks[::-1]):
            a, b = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
            out += np.where((rank[a] == rank[b]) & (i + out < n) & (j + out < n), step, 0)
        for _ in range(6):
            a, b = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
            out += (self.text[a] == self.text[b]) & (out < most)
        return np.minimum(out, most)


def maximal_repeats(segments: list[bytes], starts: np.ndarray, length: int):
    """(common length, segments, places) of every maximal repeat with all its occurrences.

    Only places 0 .. starts - 1 of a segment begin a repeat.  A segment's first place counts as having a byte of its own to the left, since
    what lies further left belongs to another anchor.
    """
    size = np.array([len(s) for s in segments], np.int64)
    text = np.zeros(int(size.sum()) + len(segments), np.int64)
    base = np.cumsum(size + 1) - size - 1
    for b, s in zip(base.tolist(), segments):
        text[b:b + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
    seg = np.repeat(np.arange(len(segments)), starts)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = base[seg] + place
    array = SuffixArray(text, length)
    # starts in the order of their ranks; the order among equal ranks needs the bytes that follow, which the last doubling still tells apart
    deep = array.ranks[-1][at]
    follow = array.ranks[-1][np.minimum(at + array.steps[-1], len(text) - 1)]
    order = np.lexsort([follow, deep])
    at, seg, place = at[order], seg[order], place[order]
    left = size[seg] - place
    shared = array.common(at[:-1], at[1:], np.minimum(left[:-1], left[1:])) if len(at) > 1 else np.zeros(0, np.int64)
    # a byte to the left, or a value of its own
    prior = np.where(place > 0, text[np.maximum(at - 1, 0)], -1 - np.arange(len(at)))
    change = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.concatenate([[0], prior[1:] != prior[:-1]]) if len(at) else [], out=change[1:])
    long = shared >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # a maximal row of starts with the same first `length` bytes
        stack: list[list[int]] = []  # [common length, first index]
        for k in range(a, b + 1):
            value = int(shared[k]) if k < b else -1
            first = k
            while stack and stack[-1][0] > value:
                common, first = stack.pop()
                # left extension: some two neighbours in the interval differ to the left
                if change[k + 1] != change[first + 1]:
                    yield common, seg[first:k + 1], place[first:k + 1]
            if value >= 0 and (not stack or stack[-1][0] < value):
                stack.append([value, first])


def _repeated_runs(work: DataFrame, length: int) -> DataFrame:
    """(item, covered: array of (a, b)) of the segments of each unit that hold a maximal repeat."""

    def run(table: pa.Table) -> pa.Table:
        items = table["item"].to_numpy()
        segments, starts = table["bytes"].to_pylist(), table["n"].to_numpy()
        size = np.array([len(s) for s in segments], np.int64)
        base = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()) + 1, np.int64)
        for common, seg, place in maximal_repeats(segments, starts, length):
            np.add.at(flat, base[seg] + place, 1)
            np.add.at(flat, base[seg] + place + common, -1)
        # a repeat that ends with its segment must not reach into the next: the sums are zero again there
        inside = np.cumsum(flat[:-1]) > 0
        edge = np.zeros(len(inside) + 1, bool)
        edge[base] = edge[-1] = True
        begin = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
        end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
        of = np.searchsorted(base, begin, "right") - 1
        return pa.table({"item": items[of], "a": (begin - base[of]).astype(np.int64), "b": (end - base[of]).astype(np.int64)})

    return work.groupBy("unit").applyInArrow(run, "item long, a long, b long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, id_col, n_bytes, sha256 (of the whole text), text (null if it has no candidates) and spans of every document row."""
    prepare_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    repeated = stored(_anchor_counts(own, length, gram).filter("n > 1").select("anchor"), "anchors")
    every = stored(keyed(_segments(own, filter_of(repeated), length, gram)), "segments")
    occurrences = every.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    segments = occurrences.groupBy("anchor", "seg", "check").agg(F.count("*").alias("copies"), F.min(F.struct("key", "lo", "n")).alias("at"))
    segments = stored(keyed(segments, "item"), "different-segments")
    # anchors of several different segments: their segments are compared
    several = segments.groupBy("anchor").agg(F.min("item").alias("x"), F.max("item").alias("y")).filter("x <> y").select("anchor")
    load = (F.col("at.n") + length - 1).cast("long")
    open_ = segments.join(several, "anchor").select("item", F.col("anchor").alias("component"), load.alias("load"), F.array("anchor").alias("buckets"), "at")
    open_ = stored(open_, "open-segments")
    # units are known before the bytes are cut out, so the bytes are shuffled once, to their unit
    unit = pairs.units(open_.drop("at"), UNIT_BYTES, UNIT_SEGMENTS).select("item", "unit")
    wanted = open_.select("item", "at").join(unit, "item").select(
        F.col("at.key").alias("key"), F.struct("item", "unit", F.col("at.lo").alias("lo"), F.col("at.n").alias("n")).alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("w"))
    part = lambda w, text: F.struct(w["item"].alias("item"), w["unit"].alias("unit"), w["n"].alias("n"), F.substring(
        text, (w["lo"] + 1).cast("int"), w["n"] + F.lit(length - 1)).alias("bytes"))
    texts = every.filter("text IS NOT NULL").select("key", "text").join(wanted, "key")
    work = texts.select(F.explode(F.transform("w", lambda w: part(w, F.col("text")))).alias("s")).select("s.*")
    covered = _repeated_runs(work, length)
    whole = segments.filter("copies > 1").select("item", F.lit(0).cast("long").alias("a"), load.alias("b"))
    state = stored(covered.union(whole).distinct(), "repeated-runs").groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("ab"))
    state = segments.select("anchor", "seg", "check", "item").join(state, "item").drop("item")
    hits = occurrences.join(state, ["anchor", "seg", "check"])
    hits = hits.select("key", F.explode("ab").alias("x"), "lo").select("key", (F.col("lo") + F.col("x.a")).alias("a"), (F.col("lo") + F.col("x.b")).alias("b"))
    # one pass over a document's own runs, sorted: join those that overlap or touch
    runs = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    spans = _joined(runs)
    none = F.expr("cast(array() as array<struct<a: long, b: long>>)")
    return every.select("key", "doc", "n_bytes", "sha256", "text").join(spans, "key", "left").select(
        "key", F.col("doc").alias(id_col), "n_bytes", "sha256", F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"),
        F.coalesce("spans", none).alias("spans"))


def _joined(runs: DataFrame) -> DataFrame:
    """(key, spans) from (key, runs)."""

    def run(batches):
        kinds = [pa.field("a", pa.int64()), pa.field("b", pa.int64())]
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row = np.repeat(np.arange(len(size)), size)
            ends = np.concatenate([[0], np.cumsum(size)])
            reach = b.copy()
            for i in range(len(size)):
                reach[ends[i]:ends[i + 1]] = np.maximum.accumulate(b[ends[i]:ends[i + 1]])
            first = np.ones(len(a), bool)
            first[1:] = (row[1:] != row[:-1]) | (a[1:] > reach[:-1])
            at = np.flatnonzero(first)
            stop = np.append(at[1:], len(a)) - 1
            spans = pa.StructArray.from_arrays([pa.array(a[at]), pa.array(reach[stop])], fields=kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(size) + 1)), pa.int32()), spans)],
                                             ["key", "spans"])

    return runs.mapInArrow(run, "key long, spans array<struct<a: long, b: long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id_col, n_bytes, spans, kept (the remaining bytes, null if all of the text stays) and kept_sha256 of every document row."""
    found = repeated_spans(docs, id_col, text_col, length)
    # what lies between the spans
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["b"]))
    gaps = F.zip_with(stops, F.concat(F.transform("spans", lambda s: s["a"]), F.array("n_bytes")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = F.transform(gaps, lambda g: F.substring("text", (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    kept = F.when(F.size("spans") > 0, F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, x)))
    out = found.select(id_col, "n_bytes", "spans", kept.alias("kept"), "sha256")
    return out.select(id_col, "n_bytes", "spans", "kept", F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"))
