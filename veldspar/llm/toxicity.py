"""Toxicity: a support vector machine on sentences with a gap-weighted subsequence kernel and Nystroem landmarks.

Two words are as alike as their common subsequences of three characters; each gap inside a match costs a factor, so spread-out
letters and inserted characters lower the likeness but don't end it.  Punctuation inside a token and spaces between single letters are left
out before comparing.  A sentence is a bag of words and counts as its worst word, so a harmless word said a hundred times adds nothing.

Landmarks are words, or beginnings of words, of the training sentences: those that most tell toxic from other documents, and some common words.  With them a
word becomes a short vector (Nystroem), on which a linear support vector machine is trained, with the sentences as bags: the worst word of each
is found with the machine of the round before.  The trained machine is one number per word, computed once per different word in a Python worker.  A document scores as its worst sentence; a logistic curve
fitted on the training documents turns that into 0 to 1.

Training takes at most ``SAMPLE_ROWS`` labelled documents of each class, of at most ``SAMPLE_BYTES`` bytes each, by the order of a hash of
the id.  Labels are per document: a toxic one is stood for by the sentences with its most telling words, another one is a single bag of all its words.

Defined cases: null text is empty; a text without words scores as a sentence without words; a sentence of more than ``SENTENCE_WORDS`` words is cut
into several; words of more than ``WORD_CHARS`` characters are compared in overlapping parts; null labels are not learnt from; of repeated
label rows the largest label counts; without both classes every score is the share of label 1 (0 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.tables import prepare_workers
from veldspar.llm.text import LOWER, WORD, Rolling, slices, spans

SUBSEQUENCE = 3
BEGIN, END = "\x02", "\x03"
# Characters of a beginning, its mark included.
PREFIXES = range(4, 8)
DECAY = 0.6
POWER = 3
SENTENCE_WORDS = 32
WORD_CHARS = 24
TELLING_UNITS = 200
# Standard errors by which a unit's shares in toxic and other documents differ to count as telling.
TELLING_AT = 6.0
# Sentences with telling units that stand for a toxic document.
SENTENCES = 4
# Likeness below which a word takes no part in training.
LEAST_LIKE = 0.05
# Times the machine is trained, each time on the words that the one before finds worst.
ROUNDS = 3
STEPS = 3_000
TELLING_LANDMARKS = 32
OTHER_LANDMARKS = 4
SAMPLE_ROWS = 2_500
SAMPLE_BYTES = 64 << 10
MEMO_WORDS = 300_000


def clean(word: str) -> str:
    """The letters and digits of a token, lower-cased, between marks for its beginning and end; empty if it has none."""
    inner = "".join(c for c in word.lower() if c.isalnum())
    return BEGIN + inner + END if inner else ""


def units(word: str) -> list[str]:
    """What may be telling of a word: the whole of it and its beginnings."""
    return [word, *(word[:n] for n in PREFIXES if n < len(word) - 1)]


def _codes(words: list[str], length: int) -> np.ndarray:
    out = np.zeros((len(words), length), np.uint32)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _decay(n: int) -> np.ndarray:
    gap = np.subtract.outer(np.arange(n), np.arange(n)) - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights of the common subsequences of each row of ``a`` (rows x m codes, 0 pads) with ``b`` (n codes or rows x n codes)."""
    rows, m = a.shape
    n = b.shape[-1]
    a = a.T[:, :, None]
    same = ((a == b) & (a > 0)).astype(np.float32) * np.float32(DECAY ** 2)  # m x rows x n
    down, right = _decay(m), _decay(n).T
    at = same
    for _ in range(SUBSEQUENCE - 1):
        at = (down @ at.reshape(m, rows * n)).reshape(m * rows, n) @ right
        at = same * at.reshape(m, rows, n)
    return at.sum((0, 2))


def _characters(codes: np.ndarray) -> np.ndarray:
    """The characters of each row as bits."""
    bits = np.where(codes > 0, np.uint64(1) << (codes & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=-1)


class WordKernel:
    """Likeness (0 to 1, raised to POWER) of words to the landmark words; 0 if a word has few of the landmark's characters."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = [_codes([w], len(w))[0] for w in landmarks]
        self.own = np.array([float(_kernel(c[None], c)[0]) for c in self.codes])
        self.characters = [_characters(c) for c in self.codes]
        self.least = [max(SUBSEQUENCE, math.ceil(0.6 * int(np.bitwise_count(c)))) for c in self.characters]

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        parts, of = [], []
        for i, w in enumerate(words):
            if len(w) >= SUBSEQUENCE:
                cut = [w] if len(w) <= WORD_CHARS else [w[k:k + WORD_CHARS] for k in range(0, len(w) - WORD_CHARS // 2, WORD_CHARS // 2)]
                parts += cut
                of += [i] * len(cut)
        order = np.argsort([len(p) for p in parts], kind="stable")
        for lo in range(0, len(order), 1024):
            some = order[lo:lo + 1024]
            a = _codes([parts[i] for i in some], max(len(parts[i]) for i in some))
            rows = np.array([of[i] for i in some])
            has = _characters(a)
            alike = [np.flatnonzero(np.bitwise_count(has & self.characters[k]) >= min(self.least[k], len(code))) for k, code in enumerate(self.codes)]
            own, asked = np.zeros(len(a)), np.unique(np.concatenate(alike)) if alike else np.zeros(0, int)
            if len(asked):
                own[asked] = np.maximum(_kernel(a[asked], a[asked]), 1e-9)
            for k, (code, near) in enumerate(zip(self.codes, alike)):
                if len(near):
                    value = _kernel(a[near], code) / np.sqrt(own[near] * self.own[k])
                    np.maximum.at(out[:, k], rows[near], value ** POWER)
        return out


class Machine:
    """Landmarks, a weight for each, a bias, and the curve from the worst sentence to a score."""

    def __init__(self, constant: float):
        self.constant: float | None = constant
        self.kernel: WordKernel | None = None

    def train(self, bags: list[list[str]], signs: np.ndarray, landmarks: list[str], worth) -> None:
        """``worth`` is a first guess of how telling a word is; then each round takes the words the machine itself finds worst."""
        self.kernel, self.constant = WordKernel(landmarks), None
        like = self.kernel(landmarks)
        value, vector = np.linalg.eigh((like + like.T) / 2 + 1e-3 * np.eye(len(like)))
        root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        words, rows = self._alike(sorted({w for s in bags for w in s}))
        at = {w: i + 1 for i, w in enumerate(words)}
        # row 0 stands for a bag without a word that is like a landmark
        mapped = np.vstack([np.zeros((1, len(landmarks))), rows @ root])
        places = [np.array(sorted({at.get(w, 0) for w in s} | {0})) for s in bags]
        worst = np.array([0.0, *(worth(w) for w in words)])
        for _ in range(ROUNDS):
            x = mapped[[p[worst[p].argmax()] for p in places]]
            w, bias, ridge = np.zeros(x.shape[1]), 0.0, 1e-4
            for step in range(1, STEPS + 1):  # full subgradient steps on the hinge loss
                inside = (signs * (x @ w + bias) < 1) * signs / len(x)
                rate = 8 / (1 + step / 200)
                w += rate * (inside @ x - ridge * w)
                bias += rate * 0.25 * inside.sum()
            worst = mapped @ w
        self.weights, self.bias = root @ w, bias

    def _alike(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words that are like some landmark, and their kernel rows."""
        kept, rows = [], [np.zeros((0, len(self.kernel.landmarks)), np.float32)]
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            like = self.kernel(part)
            some = np.flatnonzero(like.max(1) >= LEAST_LIKE)
            kept += [part[i] for i in some]
            rows.append(like[some])
        return kept, np.concatenate(rows)

    def words(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.weights

    def calibrate(self, worst: np.ndarray, labels: np.ndarray) -> None:
        a, b = 1.0, 0.0
        for _ in range(3000):
            p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
            a -= 0.5 * float(((p - labels) * worst).mean())
            b -= 0.5 * float((p - labels).mean())
        self.curve = (a, b)

    def scores(self, worst: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(worst), self.constant)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))


class WordValues:
    """The machine's number of each word, kept by the hash of the word's bytes."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.memo: dict[int, float] = {}

    def worst(self, column: pa.Array) -> np.ndarray:
        """The largest sentence margin of each text."""
        out = np.full(len(column), self.machine.bias)  # a sentence without words
        for lo, hi, data, offsets in slices(column):
            first, last, starts, ends = tokens(data, offsets)
            if not len(starts):
                continue
            low = LOWER[data]
            values = self._values(low, starts, ends)
            row = np.searchsorted(offsets, starts, "right") - 1
            # the largest word of each sentence, then of the document
            np.maximum.at(out, lo + row[first], np.maximum.reduceat(values, first) + self.machine.bias)
        return out

    def _values(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, at, inverse = np.unique(Rolling(low).hash(starts, ends), return_index=True, return_inverse=True)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in memo]
        if new:
            words = [clean(low[starts[at[i]]:ends[at[i]]].tobytes().decode("utf-8", "ignore")) for i in new]
            memo.update(zip((listed[i] for i in new), self.machine.words(words).tolist()))
        return np.array([memo[k] for k in listed])[inverse]


_KEPT: list[WordValues] = []


def values_of(machine: Machine) -> WordValues:
    """The word values of a machine; the tasks that a Python worker runs one after the other share them, for the last machine only."""
    if not _KEPT or _KEPT[0].machine is not machine:
        _KEPT[:] = [WordValues(machine)]
    return _KEPT[0]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a slice and the first and last token of each sentence.

    A token is a run without white space, from its first to its last word byte; three or more single letters with one
    character between them are one token.
    """
    starts, ends = spans(data > 32, offsets)
    word = np.flatnonzero(WORD[data])
    a, b = np.searchsorted(word, starts), np.searchsorted(word, ends) - 1
    # a sentence ends with a run that ends in a mark, or before a line break
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    newline = np.flatnonzero(data == 10)
    stop[:-1] |= np.searchsorted(newline, ends[:-1]) < np.searchsorted(newline, starts[1:])
    row = np.searchsorted(offsets, starts, "right")
    stop[:-1] |= row[1:] != row[:-1]
    sentence = np.cumsum(stop) - stop
    keep = b >= a
    a, b, sentence = a[keep], b[keep], sentence[keep]
    starts, ends = word[a] if len(a) else np.zeros(0, np.int64), word[b] + 1 if len(b) else np.zeros(0, np.int64)
    single = (ends - starts == 1) & np.isin(LOWER[data[starts]], np.arange(97, 123)) if len(starts) else np.zeros(0, bool)
    joined = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
    run = np.flatnonzero(np.concatenate([[True], ~joined])) if len(starts) else np.zeros(0, np.int64)
    size = np.diff(np.append(run, len(starts)))
    drop = np.zeros(len(starts), bool)
    for r, n in zip(run[size > 2], size[size > 2]):
        ends[r] = ends[r + n - 1]
        drop[r + 1:r + n] = True
    starts, ends, sentence = starts[~drop], ends[~drop], sentence[~drop]
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    place = np.arange(len(starts)) - np.repeat(new, np.diff(np.append(new, len(starts)))) if len(starts) else starts
    first = np.flatnonzero(place % SENTENCE_WORDS == 0)
    return first, np.append(first[1:], len(starts)) - 1, starts, ends


def sentences_of(text: str, pool: dict[str, str] | None = None) -> list[list[str]]:
    """The training view of a text: its sentences as cleaned words, cut as in scoring; equal words are one object if there is a pool."""
    column = pa.array([text])
    _, _, data, offsets = next(slices(column))
    first, last, starts, ends = tokens(data, offsets)
    raw = data.tobytes()
    words = [clean(raw[s:e].decode("utf-8", "ignore")) for s, e in zip(starts, ends)]
    if pool is not None:
        words = [pool.setdefault(w, w) for w in words]
    return [words[f:x + 1] for f, x in zip(first, last)]


def distinct_words(words: list[str], most: int) -> list[str]:
    """The first ``most`` words that are not much like an earlier one."""
    like = WordKernel(words)(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < most and all(like[i, j] < 0.3 for j in chosen):
            chosen.append(i)
    return [words[i] for i in chosen]


def train(texts: list[str], labels: np.ndarray) -> Machine:
    machine = Machine(float(labels.mean()) if len(labels) else 0.0)
    if not len(labels) or labels.min() == labels.max():
        return machine
    pool: dict[str, str] = {}
    docs = [sentences_of(t, pool) for t in texts]
    n_toxic, n_other = int(labels.sum()), int(len(labels) - labels.sum())
    held = [{u for s in sentences for w in s if len(w) > SUBSEQUENCE for u in units(w)} if y else set() for sentences, y in zip(docs, labels)]
    toxic = Counter(u for x in held for u in x)
    toxic = {u: n for u, n in toxic.items() if n >= max(2, n_toxic // 200)}
    other = Counter(u for sentences, y in zip(docs, labels) if not y
                    for u in {u for s in sentences for w in s for u in units(w) if u in toxic})
    telling = {}
    for u, n in toxic.items():  # difference of shares over its standard error
        share = (n + other[u] + 1) / (n_toxic + n_other + 2)
        telling[u] = (n / n_toxic - other[u] / n_other) / math.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other))
    ranked = sorted(telling, key=lambda u: (-telling[u], -len(u), u))
    best = distinct_words(ranked[:TELLING_UNITS], TELLING_LANDMARKS)
    common = sorted((u for u in telling if u.endswith(END) and telling[u] < 1), key=lambda u: (-toxic[u], u))[:OTHER_LANDMARKS]
    landmarks = list(dict.fromkeys(best + common))
    sure = {u for u in ranked if telling[u] >= TELLING_AT} or set(best)
    chosen, signs = [], []
    for sentences, y in zip(docs, labels):
        sentences = [s for s in sentences if s]
        if not sentences:
            continue
        if y:
            worth = [max((telling[u] for w in s for u in units(w) if u in sure), default=0.0) for s in sentences]
            some = [i for i in np.argsort(worth)[::-1][:SENTENCES] if worth[i] > 0]
            chosen += [sentences[i] for i in some]
            signs += [1] * len(some)
        else:
            chosen.append([w for s in sentences for w in s])  # not one of its words may count as toxic
            signs.append(-1)
    if len(set(signs)) < 2 or not landmarks:
        return machine
    machine.train(chosen, np.array(signs, float), landmarks, lambda w: max((telling.get(u, 0.0) for u in units(w)), default=0.0))
    worst = WordValues(machine).worst(pa.array(texts))
    machine.calibrate(worst, labels)
    return machine


def fit(docs: DataFrame, labels: DataFrame, where, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        rows: int = SAMPLE_ROWS) -> Machine:
    """Train on at most ``rows`` documents of each class; ``where`` is the condition on id_col of ``labels``."""
    prepare_workers(docs.sparkSession)
    label = F.col(label_col)
    known = labels.filter(where & label.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    halves = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    sample = halves[0].union(halves[1])
    text = F.col(text_col).cast("string")
    some = docs.filter(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(id_col).alias("id"), text.alias("text")).join(
        F.broadcast(sample), "id").select("text", "label").limit(2 * rows)  # the sample has at most 2 * `rows` rows
    got = some.toArrow()
    order = np.lexsort([np.array([hash_text(t) for t in got["text"].to_pylist()], np.uint64)]) if got.num_rows else []
    got = got.take(pa.array(order, pa.int64()))
    return train(got["text"].to_pylist(), got["label"].to_numpy().astype(int))


def hash_text(text: str) -> int:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(Rolling(data).hash(np.array([0]), np.array([len(data)]))[0])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        values = values_of(shared.value) if shared.value.constant is None else None
        for batch in batches:
            worst = values.worst(batch.column(1)) if values else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(worst))], [id_col, "score"])

    return source.mapInArrow(run, f"{id_col} {source.schema['id'].dataType.simpleString()}, score double")
