"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, n-gram bucket) come from all rows to learn from, added up in each task before the shuffle.  The model is one matrix of
log probabilities, buckets x languages, which is sent to the tasks; its size depends on the number of languages only.
A batch is scored with numpy: one row of the matrix per n-gram, summed over each text.

Text is lower-cased, every run of characters that aren't letters counts as one border.  The score is the share of the best language when the
log likelihoods are scaled by one over the square root of the number of n-grams, so that long texts keep a graded score.

Defined cases: null text or a text without letters is ``und`` with score 0; null languages are not learnt from; if nothing can be learnt every
row is ``und``; ties go to the smallest language; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm.tables import prepare_workers
from veldspar.llm.text import mix

UND = "und"
BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# A model of more languages is refused, so that the matrix has a proven bound.
MAX_LANGUAGES = 1000
SLICE_CHARS = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def ngram_slices(texts: list[str | None]):
    """(first row, end row, buckets, offsets of each row's buckets) over whole texts."""
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE_CHARS):
            parts.append((texts[hi] or "").lower())
            size += len(parts[-1])
            hi += 1
        yield lo, hi, *_ngrams(parts)
        lo = hi


def _ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    letter = _letters()[chars]
    keep = letter.copy()  # a border stays only before a letter or at a row's end
    keep[:-1] |= letter[1:]
    keep[-1] = True
    last = np.cumsum([len(p) + 1 for p in parts])
    keep[last] = True
    rows = np.append(rows, len(parts))[keep]
    code = np.where(letter, chars, 0)[keep].astype(np.uint64)
    letter = letter[keep]
    out_rows, out = [], []
    value = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        value = (value[:m] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:]
        if n not in ORDERS:
            continue
        # within one row; only the first and, from the third on, the last character may be a border
        ok = letter[:m] if n == 1 else letter[1:m + 1] & (rows[1:m + 1] == rows[:m])
        for j in range(2, n - 1):
            ok = ok & letter[j:j + m]
        out.append((mix(value[ok]) >> np.uint64(64 - BITS)).astype(np.int32))
        out_rows.append(rows[:m][ok])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
    row, bucket = np.concatenate(out_rows), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return bucket[order], np.searchsorted(row[order], np.arange(len(parts) + 1))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities as buckets x languages; the last row holds the priors)."""
    prepare_workers(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, bucket, offsets in ngram_slices(batch.column(0).to_pylist()):
                of = np.repeat(langs[lo:hi], np.diff(offsets))
                for lang in set(langs[lo:hi]):
                    have = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                    have[:-1] += np.bincount(bucket[of == lang], minlength=1 << BITS)
                    have[-1] += int((langs[lo:hi] == lang).sum())
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())],
                                             ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(MAX_LANGUAGES * ((1 << BITS) + 1) + 1).toArrow()
    langs = sorted(set(found["lang"].unique().to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds at most {MAX_LANGUAGES}")
    counts = np.zeros(((1 << BITS) + 1, max(1, len(langs))))
    where = {lang: i for i, lang in enumerate(langs)}
    column = np.array([where[x] for x in found["lang"].to_pylist()], int)
    counts[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
    prior = np.log(counts[-1:] + 1) - np.log(counts[-1].sum() + counts.shape[1])
    body = counts[:-1] + SMOOTHING
    return langs, np.vstack([np.log(body) - np.log(body.sum(0)), prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang: str = "lang_pred", share: str = "score") -> DataFrame:
    """``docs`` with two more columns, the predicted language and its score."""
    spark = docs.sparkSession
    prepare_workers(spark)
    langs, table = model
    shared = spark.sparkContext.broadcast(table)
    fields = [*docs.schema.fields]
    text_at = docs.columns.index(text_col)

    def score(batches):
        table = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            best, certain = np.full(len(texts), -1), np.zeros(len(texts))
            for lo, hi, bucket, offsets in ngram_slices(texts):
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                if not len(some) or not langs:
                    continue
                total = np.add.reduceat(table[bucket], offsets[:-1][some], axis=0) + table[-1]
                scaled = (total - total.max(1, keepdims=True)) / np.sqrt(n[some])[:, None]
                p = np.exp(scaled)
                best[lo + some] = total.argmax(1)
                certain[lo + some] = 1 / p.sum(1)
            names = pa.array([langs[i] if i >= 0 else UND for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(certain, pa.float64())], [*(f.name for f in fields), lang, share])

    return docs.mapInArrow(score, T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(share, T.DoubleType())]))
