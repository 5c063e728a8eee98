"""The training-data operators against brute force on small fixtures, and their defined cases."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import itertools
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from veldspar.llm.decontaminate import HashFilter
from veldspar.llm import (components, decontaminate, language_id, line_dedup, ngram_join, packing, quality, queries, repeats, text, topk, toxicity,
                          url_filter)
from veldspar.llm.tables import free_name, learnable, row_keyed

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(s):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOW))


def prose(rng, n, vocabulary="alpha beta gamma delta the of and to river stone cloud maß été niño window table 42".split()):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows():
    """Null and empty values, repeated rows, a very long text, clashing ids."""
    rng = random.Random(5)
    long = prose(rng, 6000, [f"w{i}" for i in range(900)])
    same = prose(rng, 120)
    rows = [(1, same), (2, same), (2, same), (3, same.replace("river", "rivers", 1)), (4, ""), (5, None), (None, same), (None, None), (6, "  \n\n "), (7, "...!!"),
            (8, long), (9, "short one"), (10, prose(rng, 400)), (11, long[:9000] + " tail"), (12, "Ünïcode ßtraße\x1c\x85 x")]
    return [(i, t, "en" if i and i % 2 else None, "src", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("key", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


# --- text helpers ---------------------------------------------------------------------------------------------------

def test_words_match_the_pattern():
    texts = ["Ab c-d", None, "", "é1_ x", "..", "\x00a"]
    column = pa.array(texts, pa.string())
    got = []
    for lo, hi, data, offsets in text.slices(column, limit=4):
        w = text.Words(data, offsets)
        low = w.data.tobytes()
        for i in range(hi - lo):
            got.append([low[s:e].decode() for s, e in zip(w.starts[w.offsets[i]:w.offsets[i + 1]], w.ends[w.offsets[i]:w.offsets[i + 1]])])
    assert got == [words_of(t) for t in texts]


def test_slices_of_an_offset_column():
    column = pa.array(["zz", "ab", "cd"]).slice(1)
    assert [d.tobytes() for _, _, d, _ in text.slices(column)] == [b"abcd"]


# --- 1 packing ------------------------------------------------------------------------------------------------------

def check_packing(rows, source, tokenizer, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    want = collections.Counter()
    for i, s in source:
        ids = t.encode(s or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for slots in seqs.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


def test_packing_defined_cases(docs, tokenizer):
    rows = packing.pack(docs, tokenizer, capacity=64).collect()
    used = check_packing(rows, [r[:2] for r in odd_rows()], tokenizer, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 1


def test_packing_of_nothing(nothing, tokenizer):
    assert packing.pack(nothing, tokenizer).count() == 0


def test_packed_sequences_hold_the_ids(docs, tokenizer):
    packed = packing.pack(docs, tokenizer, capacity=128, keep_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = whole[r.sequence_id][r.offset:r.offset + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32


def test_plan_is_complete_and_tight():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 15))}
        runs = packing.plan_runs(counts, 50)
        seen, room = collections.Counter(), collections.defaultdict(set)
        for length, low, high, first, offset in runs:
            for k in range(high - low):
                seen[length, low + k] += 1
                cells = set(range(offset, offset + length))
                assert not cells & room[first + k] and max(cells) < 50
                room[first + k] |= cells
        assert seen == {(n, k): 1 for n, c in counts.items() for k in range(c)}
        free = []  # best fit decreasing, piece by piece
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [k for k, f in enumerate(free) if f >= n]
            if fit:
                free[min(fit, key=lambda k: free[k])] -= n
            else:
                free.append(50 - n)
        assert len(room) == len(free)
        assert all(cells == set(range(len(cells))) for cells in room.values())


def test_encoder_equals_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    parts = ["a", "Bc", "'s", "it's", " ", "  ", "\n", "\t", "\n\n", "12", "é", "中", "½", ",", "!!", "$$$", "\x1c", "\x85", "\u00a0", "\u3000", "<|endoftext|>", "’", "_", ")", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for x, got in zip(texts, packing.ContractEncoder(tokenizer).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_added_tokens_as_the_tokenizer_has_them(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = ["before <|endoftext|> after", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\nb", "  <|endoftext|>  x\x85", "<|endoftext| >", "plain words", ""]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer, keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}
    assert {r.doc_id: r.ids for r in got}[0] == [19052, 220, 50256, 706, 0]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


# --- 2 decontamination ----------------------------------------------------------------------------------------------

def brute_hits(docs, items):
    out = []
    windows = []
    for item, t in items:
        w = words_of(t)
        windows += [(item, tuple(w[k:k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, n in windows:
            for k in range(len(w) - len(n) + 1):
                if tuple(w[k:k + len(n)]) == n:
                    hit |= set(range(k, k + len(n)))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [(1, prose(rng, 25)), (1, prose(rng, 12)), (2, prose(rng, 4)), (30, "River STONE"), (4, "stone"), (None, prose(rng, 14)), (6, None), (7, "--"), (8, prose(rng, 10))]
    items.append((9, items[0][1]))
    docs = [(i, prose(rng, rng.randint(0, 60)) + " " + (items[rng.randrange(6)][1] or "")[rng.randint(0, 20):] + "; " + prose(rng, 5)) for i in range(60)]
    docs += [(1, None), (None, items[0][1]), (None, items[0][1]), (3, ""), (5, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("window", F.lit(0)).withColumn("shingle", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == brute_hits(docs, items)
    assert all(sum(s.b - s.a for s in r.spans) == r.n_hit for r in got)


def test_decontamination_of_and_with_nothing(spark, docs, nothing):
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r for r in decontaminate.decontaminate(docs, b).collect() if r.n_hit] == []
    assert decontaminate.decontaminate(nothing, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = decontaminate.HashFilter(100, most_bits=1 << 12)
    f.add(own)
    assert len(f.might_hold(own)) == 5000
    wide = decontaminate.HashFilter(5000)
    wide.add(own)
    assert len(wide.might_hold(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64))) < 1000


# --- 3, 5, 9 classifiers --------------------------------------------------------------------------------------------

def toxic_rows(n=500):
    rng = random.Random(3)
    clean = [f"{a}{b}" for a in "the of and river stone cloud window table run walk".split() for b in ("", "s", "ing", "er")]
    bad = ["idiot", "moron", "loserface"]
    rows = []
    for i in range(n):
        s = ". ".join(prose(rng, 8, clean) for _ in range(4))
        y = i % 4 == 0
        if y:
            k = rng.choice(bad)
            form = rng.randrange(3)
            k = k if form == 0 else k[:2] + rng.choice("xz") + k[2:] if form == 1 else " ".join(k)
            s = s.replace("river", k, 1) if "river" in s else s + " " + k
        rows.append((i, s, int(y)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, learnable("doc_id", 3, 1)[1])
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in held]) >= 0.9
    assert all(0 <= s <= 1 for s in got.values())


def test_subsequence_kernel_by_brute_force():
    def plain(a, b):
        import itertools

        value = 0.0
        for s in itertools.combinations(range(len(a)), 3):
            for t in itertools.combinations(range(len(b)), 3):
                if all(a[x] == b[y] for x, y in zip(s, t)):
                    # every character counts DECAY, and so does every character skipped inside the match
                    value += toxicity.DECAY ** (s[-1] - s[0] + 1 + t[-1] - t[0] + 1)
        return value

    rng = random.Random(4)
    for _ in range(40):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(2))
        got = toxicity._kernel(toxicity._codes([a], len(a)), toxicity._codes([b], len(b))[0])[0]
        assert got == pytest.approx(plain(a, b), rel=1e-4)


def test_gapped_words_are_one_token():
    got = [[w.strip("\x02\x03") for w in s] for s in toxicity.sentences_of("you i d i o t now. A b-c")]
    assert got == [["you", "idiot", "now"], ["a", "bc"]]


def test_classifiers_without_labels_or_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    where = learnable("doc_id", 3, 1)[1]
    machine = toxicity.fit(docs, none, where)
    assert {r.score for r in toxicity.score(docs, machine).collect()} == {0.0}
    fm = quality.fit(docs, none, where)
    assert {r.score for r in quality.score(docs, fm).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    assert quality.score(nothing, quality.fit(docs, one, F.lit(True))).count() == 0
    assert toxicity.score(nothing, toxicity.fit(docs, one, F.lit(True))).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, one, F.lit(True))).collect()} == {1.0}


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        s = prose(rng, 80) if good else " ".join(w + "$$$" for w in prose(rng, 40).split()) if i % 2 else " ".join(["buy"] * 60)
        rows.append((i, s, len(s), int(good)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    machine = quality.fit(docs, labels, learnable("doc_id", 5, 0)[1])
    got = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[r[0]] >= 0.3) == bool(r[3]) for r in held]) >= 0.95


def test_factorisation_identity():
    m = quality.FactorisationMachine()
    rng = np.random.default_rng(2)
    feature, value = rng.choice(quality.FEATURES, 7, replace=False), rng.random(7).astype(np.float32)
    w, v = m.table[feature, 0], m.table[feature, 1:]
    pairs_ = sum(float(v[i] @ v[j]) * value[i] * value[j] for i in range(7) for j in range(i))
    assert m.margin(feature, value, np.array([0, 7]))[0] == pytest.approx(m.bias + float(w @ value) + pairs_, abs=1e-5)


def test_classifiers_take_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 1, 0), (10, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for op, column in ((quality, "quality"), (toxicity, "toxic")):
        got = op.score(docs, op.fit(docs, labels, F.lit(True), column)).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)


def test_language_id(spark, docs, nothing):
    vocabulary = {"en": "the river and stone with cloud".split(), "de": "der fluß und stein mit wolke".split(), "ru": "река и камень с облако".split()}
    rng = random.Random(6)
    rows = [(i, prose(rng, 12, vocabulary[lang]), lang) for i in range(120) for lang in [sorted(vocabulary)[i % 3]]]
    rows += [(900, "12 34 !", "en"), (901, None, "en"), (902, "", None), (903, "the river", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held, learn = learnable("doc_id", 4, 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d.select("doc_id", "text"), language_id.learn(d.filter(learn))).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows[:120]]) == 1
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903][0] == "en"
    model = language_id.learn(nothing)
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), model).collect()} == {"und"}
    assert language_id.predict(nothing, model, share="s").count() == 0


def test_language_counts_by_brute_force():
    def grams(s):
        out, text_ = [], "".join(c if c.isalpha() else " " for c in (s or "").lower())
        text_ = " " + " ".join(text_.split()) + " " if text_.split() else ""
        for n in language_id.ORDERS:
            for k in range(len(text_) - n + 1):
                g = text_[k:k + n]
                if g[1 if n > 1 else 0] != " " and " " not in g[1:-1]:
                    out.append(g)
        return out

    texts = ["Hello, World", None, "a", "  x  y1z ", "ßtraße"]
    for lo, hi, bucket, offsets in language_id.ngram_slices(texts):
        for i in range(lo, hi):
            assert offsets[i - lo + 1] - offsets[i - lo] == len(grams(texts[i])), texts[i]


# --- 4 n-gram join --------------------------------------------------------------------------------------------------

def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MOST_HASHES


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, links[i]) for i in members]
    return sorted(out, key=repr)


def near_copies(seed=12, groups=12, copies=7):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(groups):
        base = prose(rng, 80, vocabulary).split()
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((g * 100 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_ngram_join_against_brute_force(spark, monkeypatch, small_blocks):
    from veldspar.llm import pairs

    rows = near_copies() + [r[:2] for r in odd_rows()]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).repartition(4)
    if small_blocks:  # groups cut into several blocks
        units = pairs.units
        monkeypatch.setattr(pairs, "units", lambda items: units(items, 200, 3))
    got = ngram_join.jaccard_groups(d).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute_groups(rows)


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.jaccard_groups(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, None), (7, 7), (300, 301), (300, 301)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- 6 top-k --------------------------------------------------------------------------------------------------------

def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(100, rows[100][1]), (None, rows[0][1]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [1.0, 2.0]), (400, [0.5, 1.0]),
             (500, []), (600, []), (700, [float("inf")] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(0)).withColumn("size", F.lit("x"))
    got = topk.top_k(d, F.col("id") % 20 == 0, 5).collect()
    good = [(i, np.floor(np.array(v, float) * 1024)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for n, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            found = sorted(((-int(q @ c), j is None, j) for m, (j, c) in enumerate(good) if m != n and len(c) == len(q)), key=lambda x: (x[0], x[1], x[2] or 0))[:5]
            want += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0


# --- 7 repeats ------------------------------------------------------------------------------------------------------

def brute_spans(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[p:p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = [p for p in range(len(b)) if gone[p] and (not p or not gone[p - 1])]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_repeats_against_brute_force(spark, monkeypatch, small_blocks):
    rng = random.Random(21)
    shared = [prose(rng, n, [f"s{i}" for i in range(200)]) for n in (20, 60, 90)]
    rows = [r[:2] for r in odd_rows()] + near_copies(4, 4, 6)
    rows += [(1000 + i, prose(rng, 30) + rng.choice(shared)[rng.randint(0, 30):] + prose(rng, 20)) for i in range(40)]
    rows += [(2000, "ab" * 150), (2001, "aaab" * 60), (2002, "é" * 130), (2003, "x" * 199)]
    if small_blocks:
        monkeypatch.setattr(repeats, "UNIT_BYTES", 800)
        monkeypatch.setattr(repeats, "UNIT_SEGMENTS", 2)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit(0)).repartition(4)
    for length in (200,) if small_blocks else (200, 70):
        got = repeats.remove_repeats(d, length=length).collect()
        have = [(r.doc_id, r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), r.kept_sha256) for r in got]
        assert sorted(have, key=repr) == brute_spans(rows, length)


def test_maximal_repeats_by_brute_force():
    rng = random.Random(13)
    for _ in range(25):
        length = 4
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 14))) for _ in range(5)]
        starts = np.array([len(s) - length + 1 for s in segments])
        got = {(n, frozenset(zip(s.tolist(), p.tolist()))) for n, s, p in repeats.maximal_repeats(segments, starts, length)}
        want = set()
        places = collections.defaultdict(set)
        for i, s in enumerate(segments):
            for p in range(len(s) - length + 1):
                for n in range(length, len(s) - p + 1):
                    places[s[p:p + n]].add((i, p))
        for s, where in places.items():
            right = {segments[i][p + len(s):p + len(s) + 1] or (i, p) for i, p in where}
            left = {segments[i][p - 1] if p else (i, p) for i, p in where}
            if len(where) > 1 and len(right) > 1 and len(left) > 1:
                want.add((len(s), frozenset(where)))
        assert got == want


def test_repeats_of_nothing(nothing):
    assert repeats.remove_repeats(nothing).count() == 0


# --- 8 line dedup ---------------------------------------------------------------------------------------------------

def test_banded_distance():
    rng = random.Random(3)
    for t in (1, 2, 3):
        a, b = [], []
        for _ in range(800):
            x = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
            y = list(x)
            for _ in range(rng.randint(0, t + 2)):
                p = rng.randint(0, len(y))
                y[p:p + rng.randint(0, 1)] = [rng.choice(b"abc")] * rng.randint(0, 1)
            a.append(x)
            b.append(bytes(y))
        assert line_dedup.within(a, b, t).tolist() == [line_dedup._plain_distance(x, y) <= t for x, y in zip(a, b)]


def brute_lines(rows):
    where = collections.defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k, line in enumerate((t.split("\n") if t is not None else [])):
            b = line.encode().strip(bytes(range(33)))
            if len(b) >= line_dedup.MIN_BYTES:
                where[b].append((i is None, i or 0, n, k))
    lines = sorted(where)
    root, links = {b: b for b in lines}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and line_dedup._plain_distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for b in lines:
        classes[find(b)] += where[b]
    gone, n_links = collections.Counter(), collections.Counter()
    for members in classes.values():
        for x in sorted(members)[1:]:
            gone[x[2]] += 1
    for b in lines:
        for x in where[b]:
            n_links[x[2]] += links[b]
    return sorted(((i, len(t.split("\n")) if t is not None else 0, gone[n], n_links[n]) for n, (i, t) in enumerate(rows)), key=repr)


def line_rows():
    rng = random.Random(31)
    base = [prose(rng, rng.randint(3, 9)) for _ in range(40)]

    def noisy(s):
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            p = rng.randrange(len(s) + 1)
            s = s[:p] + rng.choice(["", "q", "é"]) + s[p + rng.randint(0, 1):]
        return s

    return [(i, "\n".join(noisy(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(80)]


def test_line_dedup_against_brute_force(spark):
    rows = line_rows() + [(1000, " \n\n}\n"), (1001, None), (1002, ""), (None, line_rows()[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(0)).withColumn("number", F.lit(0)).repartition(4)
    got = line_dedup.line_classes(d).collect()
    assert sorted(((r.doc_id, r.n_lines, len(r.repeats), r.n_links) for r in got), key=repr) == brute_lines(rows)


def long_line_rows():
    """Lines of 60 to 700 bytes, some with a replaced word, and some with so many edits that the threshold decides."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrst中é") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [prose(rng, n, words) for n in (9, 12, 16, 25, 40, 90)]

    def changed(s):
        w = s.split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, len(w) // 12])):
            w[rng.randrange(len(w))] = rng.choice(words)
        for _ in range(rng.choice([0, 0, 1])):
            w.insert(rng.randrange(len(w)), rng.choice(words))
        return " ".join(w)

    return [(i, "\n".join(changed(rng.choice(base)) for _ in range(2))) for i in range(27)]


def brute_long_lines(rows):
    """(id, lines that go, links) with one edit for 16 bytes of the shorter line, two at least."""
    where = collections.defaultdict(list)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            where[line.encode()].append((i, k))
    lines, group = sorted(where), {b: {b} for b in where}
    links, gone = collections.Counter(), collections.Counter()
    for k, a in enumerate(lines):
        for b in lines[:k]:
            most = max(2, min(len(a), len(b)) // 16)
            if abs(len(a) - len(b)) <= most and line_dedup._plain_distance(a, b) <= most:
                links.update((a, b))
                both = group[a] | group[b]
                group.update((x, both) for x in both)
    for members in {frozenset(g) for g in group.values()}:
        gone.update(i for i, _ in sorted(p for b in members for p in where[b])[1:])
    return sorted((i, gone[i], sum(links[x.encode()] for x in t.split("\n"))) for i, t in rows)


def test_long_lines_with_replaced_words(spark):
    rows = long_line_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.line_classes(d, per_edit=line_dedup.PER_EDIT).collect()
    want = brute_long_lines(rows)
    assert sorted((r.doc_id, len(r.repeats), r.n_links) for r in got) == want
    assert sum(n for _, _, n in want) > sum(r.n_links for r in line_dedup.line_classes(d).collect())


def test_lines_of_hot_buckets_meet_in_units(spark):
    rows = long_line_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (2, 5):
        got = line_dedup.line_classes(d, per_edit=line_dedup.PER_EDIT, hot_lines=most).collect()
        assert sorted((r.doc_id, len(r.repeats), r.n_links) for r in got) == brute_long_lines(rows)


def test_pairs_that_share_many_buckets_are_listed_once(spark):
    """Only where something else stands before each, and only for lengths that fit; the steps that have been read don't stay."""
    tokens = [(k, 100, 7, k) for k in (1, 2, 3)] + [(k, 100, 8, k % 2) for k in (1, 2, 3)] + [(4, 120, 8, 4)] + [(k, 60, 9, k) for k in range(10, 20)]
    t = spark.createDataFrame(tokens, "item long, bytes int, bucket long, left long")
    got = sorted(map(tuple, line_dedup._pairs(t, 2, 16, 5).collect()))
    assert got == [(1, 2), (1, 3), (2, 3)] + [(k, k) for k in range(10, 20)]
    assert line_dedup._pairs(t.filter("bucket = 8 and item < 4"), 2, 16, 5).count() == 2


def test_lines_meet_in_units_of_any_size_without_the_driver(spark, monkeypatch):
    """No filter of keys goes through the driver, and small units, shards of a bin, parts of what they meet and several jobs find the same links."""
    def refused(*_, **__):
        raise AssertionError("rows are read by the driver one by one")

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refused)
    for name, size in (("UNIT_BYTES", 400), ("LEAST_UNIT", 400), ("PROBE_BYTES", 900), ("JOB_BYTES", 12_000)):
        monkeypatch.setattr(line_dedup, name, size, raising=False)
    rows = long_line_rows() + [(100, long_line_rows()[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.line_classes(d, per_edit=line_dedup.PER_EDIT).collect()
    assert sorted((r.doc_id, len(r.repeats), r.n_links) for r in got) == brute_long_lines(rows)


def test_units_cover_every_two_lengths_once():
    least = line_dedup._bins()
    sizes = {k: 50 + 37 * (k % 5) * (k % 7) for k in range(20, 600, 3)}
    units = [u for job in line_dedup._units(sizes, 2, 16, 10**6) for u in job]
    assert max(u.of for u in units) == 1
    for k in sizes:
        own = [u for u in units if u.lo <= k <= u.hi]
        longest = int(least[k + 1]) - 1
        reach = int(np.searchsorted(least, longest + max(2, longest // 16), "right")) - 1
        assert all(sum(u.first <= m <= u.last for u in own) == 1 for m in sizes if k <= m <= reach)


def test_lines_with_much_to_verify_are_left_to_blocks(monkeypatch):
    """What a unit verifies itself and what its blocks find are the same pairs, each once."""
    lines = sorted({x.encode() for _, t in long_line_rows() for x in t.split("\n")}, key=len)
    sizes = np.array([len(x) for x in lines])
    items = np.arange(len(lines)) * 7 + 1
    chunk = line_dedup.Chunk(items.tobytes(), sizes.astype(np.int32).tobytes(), line_dedup._packed(lines))
    found = []
    for load in (1 << 40, 0):
        for name in ("UNIT_LOAD", "LINE_LOAD"):
            monkeypatch.setattr(line_dedup, name, load)
        pairs, blocks = [], []
        for batch in line_dedup._join_unit("u", line_dedup.Unit(0, 9, 0, 1, 0, 9), [(5, chunk)], 2, 16, 256):
            for r in batch.to_pylist():
                (blocks if r["a"] is None else pairs).append(r)
        pairs = [(r["a"], r["b"]) for r in pairs]
        for held, met in itertools.product(*([r for r in blocks if r["side"] == k] for k in (0, 1))):
            pairs.extend(line_dedup._join_blocks(*(line_dedup.Chunk(r["items"], r["sizes"], r["line"]) for r in (held, met)), 2, 16).tolist())
        assert bool(blocks) == (load == 0) and len(set(map(tuple, pairs))) == len(pairs)
        found.append(sorted(map(tuple, pairs)))
    close = sorted((7 * i + 1, 7 * j + 1) for j in range(len(lines)) for i in range(j) if line_dedup._close(lines[i], lines[j], max(2, len(lines[i]) // 16)))
    assert found[0] == found[1] == close


def test_steps_that_were_read_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("veldspar.session.shared_folder", lambda _, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    rows = long_line_rows()
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"), per_edit=line_dedup.PER_EDIT)
    kept = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "line-classes" in kept and not kept & {"line-texts", "repeated-texts", "probes", "index"}
    assert sorted((r.doc_id, len(r.repeats), r.n_links) for r in got.collect()) == brute_long_lines(rows)


def test_edits_of_many_pairs():
    rng = random.Random(9)
    a, b, most = [], [], []
    for _ in range(1500):
        x = bytes(rng.choice(b"abc\0") for _ in range(rng.randint(0, 30)))
        y = bytes(rng.choice(b"abc\0") for _ in range(rng.randint(0, 30))) if rng.random() < 0.4 else x[:8] + b"b" * rng.randint(0, 3) + x[rng.randint(6, 10):]
        a, b, most = [*a, x], [*b, y], [*most, rng.randint(0, 12)]
    found = line_dedup.Edits(a + b).within(np.arange(len(a)), len(a) + np.arange(len(a)), np.array(most))
    assert sorted(found.tolist()) == [k for k in range(len(a)) if line_dedup._plain_distance(a[k], b[k]) <= most[k]]


def test_query_links_a_replaced_word(spark, tmp_path):
    rng = random.Random(4)
    line = prose(rng, 30)
    rows = [(1, line, None, None, 0), (2, line.replace(" stone ", " quartz ", 1), None, None, 0)]
    assert rows[0][1] != rows[1][1]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_short_lines_that_repeat(spark, tmp_path):
    short = ["Read more", "Share this", "été", "7", "}", "--", "", " * ", "中"]
    rows = [(i, "\n".join(short if i < 3 else ["Read mora", " Read more\t", "---", "own words of a line that is long"]), None, None, 0) for i in range(4)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [(x.number, x.first_id, x.first_number) for x in r["repeats"]] for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    words = [(k, 0, k) for k in (0, 1, 2, 3, 8)]
    assert got == {0: [], 1: words, 2: words, 3: [(1, 0, 0)]}
    kept = {r.doc_id: r.text for r in corpus_pipeline.distinct_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert kept == {0: rows[0][1], 1: "}\n--\n\n * ", 2: "}\n--\n\n * ", 3: "Read mora\n---\nown words of a line that is long"}


def test_distance_of_any_threshold():
    rng = random.Random(8)
    for _ in range(600):
        x = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        y = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25))) if rng.random() < 0.4 else x[:8] + b"b" * rng.randint(0, 3) + x[rng.randint(6, 10):]
        t = rng.randint(0, 12)
        assert line_dedup._close(x, y, t) == (line_dedup._plain_distance(x, y) <= t)


def test_long_lines_share_a_bucket_after_different_bytes():
    """However the edits lie, the shorter line's keys and the longer line's probes meet in a bucket that counts."""
    rng = random.Random(12)
    for n in range(240):
        a = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(48, 420)))
        t = len(a) // 16
        size = 16 * t // (t + 1)
        if n % 3:  # two edits in every other segment, or one in each but the last
            places = [size * (2 * k + 1) + m for k in range(t // 2) for m in (3, 9)] if n % 3 == 1 else [size * k + rng.randrange(size) for k in range(t)]
        else:
            places = rng.sample(range(len(a)), t)
        b = list(a)
        for p in sorted(places, reverse=True):
            b[p:p + rng.randint(0, 1)] = [rng.choice(b"xyz")] * rng.randint(0, 1)
        a, b = sorted((a, bytes(b)), key=len)
        if len(a) < 48 or not line_dedup._close(a, b, len(a) // 16):
            continue
        cut = line_dedup.Cut(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
        first, chains = HashFilter(1000), HashFilter(4000)
        own, singles = line_dedup.index_keys(cut, np.array([0, 1]), 2, 16)
        first.add(singles)
        chains.add(own.bucket)
        probes = line_dedup.probe_keys(cut, np.array([0, 1]), 2, 16, first, chains, (-1, 1000))
        held = [{(x, y) for k in (own, probes) for z, x, y in zip(k.line.tolist(), k.bucket.tolist(), k.left.tolist()) if z == i} for i in (0, 1)]
        assert a == b or any(x == z and y != w for x, y in held[0] for z, w in held[1])


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.line_classes(nothing).count() == 0


def test_without_lines(spark):
    d = spark.createDataFrame([("a\nb\n\nc", [1, 2]), ("a", [0]), ("x\ny", None), (None, [1]), ("\n", [])], "t string, n array<int>")
    assert [r[0] for r in d.select(line_dedup.without_lines(F.col("t"), F.col("n"))).collect()] == ["a\nc", "", "x\ny", None, "\n"]


# --- 10 url filter --------------------------------------------------------------------------------------------------

def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    jump = '<META http-equiv=refresh content="0; url={}">'
    rows = [
        (1, "http://A.Net/x?q#f", None), (2, "https://sub.example.net/en/a", ""), (3, "https://example.com/de/", None), (4, None, "x"), (5, "no scheme", link.format("http://b.net/")),
        (6, "http://plain.test/p", link.format("http://q.net/blocked")), (7, "http://other.test/p", jump.format("http://plain.test/p")),
        (8, "http://mixed.test/1", link.format("http://q.net/b2")), (9, "http://mixed.test/2", link.format("http://mixed.test/1") + link.format("http://z.org/fr/ok")),
        (10, "http://rel.test/a", link.format("/b")), (11, "http://rel.test/b", jump.format("//c.net/")), (12, "http://self.test/", link.format("http://self.test/")),
        (13, "http://org/fr/", None), (14, "http://net", None), (14, "http://net", None), (None, "x://example.net/english", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("component", F.lit(2))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(d, queries.URL_RULES).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r[0], r[3], r[4]) for r in got] == [
        (1, "net/", "block"), (2, "example.net/en/", "allow"), (3, "example.com/de/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "block"), (7, None, "block"),
        (8, None, "allow"), (9, None, "allow"), (10, None, "block"), (11, None, "block"), (12, None, "allow"), (13, "org/fr/", "allow"), (14, None, "allow"),
        (14, None, "allow"), (None, "net/", "block")]
    assert got[0][1:3] == ("a.net", "/x") and got[3][1:3] == ("", "") and got[4][1:3] == ("", "")
    log = spark.createDataFrame([("http://mixed.test/1", "http://self.test/")], "source string, target string")
    more = {r.page_id: r.verdict for r in url_filter.filter_urls(d, queries.URL_RULES, redirects=log).collect()}
    assert more[12] == "allow"
    assert url_filter.filter_urls(d.limit(0), queries.URL_RULES).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------

def test_row_keys(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    docs.write.parquet(path)
    read = spark.read.parquet(path)
    name = free_name(read, "row")
    assert name == "_row"
    for frame in (read, docs):
        keys = [r[0] for r in row_keyed(frame, name).select(name).collect()]
        assert len(set(keys)) == len(keys) == len(odd_rows())


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    item = prose(random.Random(40), 15)
    rng = random.Random(41)
    lines = [(i, "\n".join(prose(rng, 30, [f"{a}{b}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "mi", "no", "te", "sh")]) for _ in range(4))) for i in range(30)]
    rows = [*lines, (100, lines[0][1]), (101, lines[1][1].replace("ba", "bo", 1)), (102, prose(rng, 30) + " " + item), (103, "12 34"), (104, None), (None, lines[2][1]),
            (105, lines[3][1].split("\n")[0] + "\nsomething of its own here")]
    made = dt.date(2020, 1, 1)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), made) for i, t in rows], DOCS + ", row_key date").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = {name: stage(spark, read, folder) for name, stage in list(stages.items())[:-1]}
    for frame in got.values():
        assert frame.schema.names == read.schema.names and [f.dataType for f in frame.schema] == [f.dataType for f in read.schema]
    ids = {name: collections.Counter(r.doc_id for r in frame.collect()) for name, frame in got.items()}
    everything = collections.Counter(i for i, _ in rows)
    assert everything - ids["language ID"] == collections.Counter([103, 104])
    assert everything - ids["line dedup"] == collections.Counter([100, 101, None])
    texts = {r.doc_id: (r.text, r.n_chars) for r in got["line dedup"].collect()}
    assert texts[105] == ("something of its own here", 25) and texts[0][0] == lines[0][1]
    assert everything - ids["n-gram Jaccard join"] == collections.Counter([100, 101, None])
    assert everything - ids["benchmark decontamination"] == collections.Counter([102])
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(range(30)) | {105}


def test_stages_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_no_query_is_missing():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(corpus_pipeline.STAGES) == 5 and isinstance(T.LongType(), T.DataType)
