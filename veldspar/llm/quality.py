"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words, hashed, with the square root of their share; statistics of its structure, cut into
steps, one feature a step; and the stated length from the metadata.  The score adds a weight per feature and low-rank products of all pairs of
features, the latter in linear time as half the difference between squared sums and sums of squares.

The machine is fitted on the driver with at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_BYTES`` bytes each, taken in the order of
a hash of the id; only their sparse vectors travel.  Scoring reads whole texts.

Defined cases: null text is empty; an empty text has only structure features and gets a score like any other; null labels are not learnt
from; of repeated label rows for an id the largest label counts; with one class or none every score is the share of label 1 (0.5 if there are none);
a missing or null metadata column is a feature of its own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.tables import prepare_workers
from veldspar.llm.text import LOWER, WORD, Words, slices

WORD_BITS = 16
STEPS = 16
RANK = 8
EPOCHS = 6
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64 << 10
STATISTICS = ("length", "word length", "different words", "commonest word", "upper case", "digits", "marks", "white space", "not ASCII",
              "line length", "repeated lines", "stated length")
FEATURES = (1 << WORD_BITS) + len(STATISTICS) * STEPS


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array, stated: np.ndarray):
    """(first row, end row, features, values, offsets) slice by slice; ``stated`` is the metadata length or nan."""
    for lo, hi, data, offsets in slices(texts):
        rows = hi - lo
        words = Words(data, offsets)
        n_words = np.diff(words.offsets)
        row = np.repeat(np.arange(rows, dtype=np.uint64), n_words)
        # sort by (row, word hash), then count the runs
        key = (row << np.uint64(40)) | (words.hash >> np.uint64(24))
        key, n = np.unique(key, return_counts=True)
        of = (key >> np.uint64(40)).astype(np.int64)
        feature = ((key & np.uint64((1 << 40) - 1)) >> np.uint64(40 - WORD_BITS)).astype(np.int64)
        value = np.sqrt(n / np.maximum(n_words, 1)[of])
        most = np.zeros(rows)
        np.maximum.at(most, of, n)
        size = np.maximum(np.diff(offsets), 1)
        word_sum = np.bincount(row.astype(np.int64), words.ends - words.starts, minlength=rows)[:rows]
        newline = data == 10
        line_no = np.cumsum(newline) - newline
        n_lines = _per_row(newline, offsets) + 1
        # a line is told by the sum of its word hashes; lines without words count as one line
        line_key = (row << np.uint64(40)) | (line_no[words.starts].astype(np.uint64) if len(data) else row)
        at = np.flatnonzero(np.diff(line_key, prepend=np.uint64(1 << 63)))
        sums = np.add.reduceat(words.hash, at) if len(at) else words.hash
        distinct = np.bincount((np.unique((line_key[at] >> np.uint64(40) << np.uint64(40)) | (sums >> np.uint64(24))) >> np.uint64(40)).astype(np.int64),
                               minlength=rows)[:rows]
        with_words = np.bincount((line_key[at] >> np.uint64(40)).astype(np.int64), minlength=rows)[:rows]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        known = stated[lo:hi]
        stats = np.stack([
            np.log2(size) / 20, word_sum / np.maximum(n_words, 1) / 16, np.bincount(of, minlength=rows)[:rows] / np.maximum(n_words, 1),
            most / np.maximum(n_words, 1), _per_row(LOWER[data] != data, offsets) / size, _per_row((data >= 48) & (data <= 57), offsets) / size * 4,
            _per_row(~WORD[data] & ~space, offsets) / size * 3, _per_row(space, offsets) / size * 2, _per_row(data >= 128, offsets) / size,
            np.log2(size / n_lines + 1) / 16, 1 - distinct / np.maximum(with_words, 1),
            np.where(np.isnan(known), 1.0, np.log2(np.maximum(np.nan_to_num(known), 0) + 1) / 24)], 1)
        step = np.clip((stats * (STEPS - 1)).astype(np.int64), 0, STEPS - 1)
        step[:, -1] = np.where(np.isnan(known), STEPS - 1, np.minimum(step[:, -1], STEPS - 2))
        step += (1 << WORD_BITS) + np.arange(len(STATISTICS)) * STEPS
        of = np.concatenate([of, np.repeat(np.arange(rows), len(STATISTICS))])
        feature = np.concatenate([feature, step.ravel()])
        value = np.concatenate([value, np.full(step.size, 0.5)])
        order = np.argsort(of, kind="stable")
        yield lo, hi, feature[order], value[order].astype(np.float32), np.searchsorted(of[order], np.arange(rows + 1))


class FactorisationMachine:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        # column 0: the weights; the others: the factors
        self.table = np.hstack([np.zeros((FEATURES, 1)), rng.normal(0, 0.05, (FEATURES, RANK))]).astype(np.float32)
        self.constant: float | None = None

    def margin(self, feature: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.table[feature] * value[:, None]
        sums = np.add.reduceat(x, offsets[:-1], axis=0)
        squares = np.add.reduceat(np.square(x[:, 1:]).sum(1), offsets[:-1])
        return self.bias + sums[:, 0] + (np.square(sums[:, 1:]).sum(1) - squares) / 2

    def probability(self, feature, value, offsets) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(feature, value, offsets), -30, 30).astype(float)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.1, ridge: float = 1e-5, batch: int = 64) -> None:
        """Adaptive gradient steps on the logistic loss, both classes with equal weight in sum."""
        share = float(labels.mean()) if len(labels) else 0.5
        if share in (0.0, 1.0) or not len(labels):
            self.constant = share
            return
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        rng, seen, seen_bias = np.random.default_rng(3), np.full_like(self.table, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                feature, value = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
                size = np.array([len(rows[i][0]) for i in some])
                offsets = np.concatenate([[0], np.cumsum(size)])
                p = self.probability(feature, value, offsets)
                g = ((p - labels[some]) * weight[some]).astype(np.float32)
                x = self.table[feature] * value[:, None]
                sums = np.repeat(np.add.reduceat(x, offsets[:-1], axis=0), size, axis=0)
                step = np.repeat(g, size)[:, None] * value[:, None] * np.hstack([np.ones((len(x), 1), np.float32), sums[:, 1:] - x[:, 1:]])
                touched, inverse = np.unique(feature, return_inverse=True)
                grad = np.zeros((len(touched), RANK + 1), np.float32)
                np.add.at(grad, inverse, step)
                grad = grad / len(some) + ridge * self.table[touched]
                seen[touched] += grad * grad
                self.table[touched] -= rate * grad / np.sqrt(seen[touched])
                seen_bias += g.mean() ** 2
                self.bias -= rate * float(g.mean()) / seen_bias ** 0.5


def sample_labels(labels: DataFrame, label_col: str, id_col: str, where, rows: int) -> DataFrame:
    """(id, label) of at most ``rows`` ids to learn from, by the order of a hash."""
    label = F.col(label_col)
    known = labels.filter(where & label.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def _source(docs: DataFrame, id_col: str, text_col: str, stated_col: str | None) -> DataFrame:
    stated = F.col(stated_col).cast("double") if stated_col in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), stated.alias("stated"))


def fit(docs: DataFrame, labels: DataFrame, where, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        stated_col: str | None = "n_chars", rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` rows; ``where`` is the condition, on id_col of ``labels``, of rows to learn from."""
    prepare_workers(docs.sparkSession)
    sample = sample_labels(labels, label_col, id_col, where, rows)
    some = _source(docs, id_col, text_col, stated_col).join(F.broadcast(sample), "id").filter(  # at most `rows` rows
        F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES).select("text", "stated", "label")

    def vectors(batches):
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, feature, value, offsets in features(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)):
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(label[lo:hi], pa.int32())], ["feature", "value", "label"])

    got = some.mapInArrow(vectors, "feature array<int>, value array<float>, label int").limit(rows).toArrow()
    machine = FactorisationMachine()
    vectors_ = [(f.values.to_numpy(), v.values.to_numpy()) for f, v in zip(got["feature"], got["value"])]
    machine.fit(vectors_, got["label"].to_numpy())
    return machine


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", stated_col: str | None = "n_chars") -> DataFrame:
    """id_col and score of every row."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    source = _source(docs, id_col, text_col, stated_col)

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, feature, value, offsets in features(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(float)):
                out[lo:hi] = shared.value.probability(feature, value, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_col, "score"])

    return source.mapInArrow(run, f"{id_col} {source.schema['id'].dataType.simpleString()}, score double")
