"""HTML extraction, hard negatives and clustering against brute force and hand-made cases."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

from veldspar.llm import clustering, hard_negatives, html_extract, recurrent, vectors
from veldspar.llm.html_blocks import Paths, leaves

# --- 11 extraction --------------------------------------------------------------------------------------------------


def texts_of(page):
    return [text for _, text, _ in leaves(page, Paths(1 << 13))]


@pytest.mark.parametrize("page, blocks", [
    (None, []), ("", []), ("  \n ", []), ("plain &lt;b&gt; text", ["plain <b> text"]),
    ("<p>a<b>b</b> c<p>d<br>e&nbsp;\n f</p>g", ["ab c", "d e f", "g"]),
    ("<div>a<script>var t='</p>';</script>b<!-- <p>x</p> -->c</div>", ["abc"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
    ("x < y & z &amp &am &#233; &copy; &zz;", ["x < y & z & &am é © &zz;"]),
    ("<p title='a>b' class=\"x>y\">t</p><p title=it's>u</p><img alt='<p>'>v", ["t", "u", "v"]),
    ("<script>never ends <p>x</p>", []), ("<p>a<!-- never ends <p>b", ["a"]), ("<p>a</p></div></p><p", ["a"]),
    ("<STYLE>x</STYLE ><P>a</P ><SELECT><OPTION>o</SELECT>b", ["a", "b"])])
def test_blocks(page, blocks):
    assert texts_of(page) == blocks


def test_paths_hold_the_elements_around():
    paths = Paths(1 << 13)
    found = {text: path for path, text, _ in leaves("<div class='mainMenu top'><p>a</p></div><p>b</p><article><p><a href=x>c</a></p></article>", paths)}
    assert found["b"] == {*paths.element("p", ""), paths.leaf("p")}
    assert found["a"] - found["b"] == paths.element("div", "class='mainMenu top'") and len(paths.element("div", "class='mainMenu top'")) == 4
    assert found["c"] - found["b"] == paths.element("article", "")
    assert [link for _, _, link in leaves("<p><a>ab</a>cd</p>", paths)] == [0.5]


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    model = recurrent.Labeller.fresh(20, 20, 3, 1, path_size=3, word_size=2, hidden=4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = recurrent.padded(rng.normal(size=(9, 8)), [4, 2, 3])
    label = rng.random(mask.shape) < 0.5
    _, grads, d_x = model._gradients(x, mask, label)
    for name in ("out", "out bias", "ahead in", "ahead own", "back own", "back bias"):
        w = model.weights[name]
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            old, ends = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                ends.append(model._gradients(x, mask, label)[0])
            w[at] = old
            assert math.isclose((ends[0] - ends[1]) / 2e-3, grads[name][at], rel_tol=2e-2, abs_tol=2e-5)
    assert (d_x[~mask] == 0).all()


def sample_pages(n=120, seed=4):
    """Pages of one template; the truth is between the article's tags."""
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "do", "ki", "lu", "ße") for b in ("ra", "mi", "no", "té")]
    says = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    for k in range(n):
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(words, 5))
        body = "".join(f"<p>{says(rng.randint(1, 60))}{'' if rng.random() < 0.2 else '</p>'}" for _ in range(rng.randint(1, 9)))
        yield f"<html><body><nav><ul>{menu}</ul></nav><div class='ad'>{says(9)}</div><article><h1>{says(4)}</h1>{body}</article><footer>&copy; x &middot; {says(3)}</footer>"


def truth(page):
    inside = re.search(r"<article>(.*)</article>", page)[1]
    return "\n".join(t for part in re.split(r"</?(?:p|h1)>", inside) if (t := " ".join(html.unescape(part).split())))


TALK = "The council met on Tuesday to discuss the new bridge over the river."
HAND_MADE = [
    (f"<body><header><h1>Daily Site</h1><p>News that matter.</p></header><nav><a href=/>Home</a> <a href=/b>World</a></nav><main><article><h1>Bridge</h1><p>{TALK}</p>"
     f"<p>{TALK} <em>Yes</em></p><ul><li>One</li></ul></article><aside><h3>Related</h3><p>Another story about a mayor.</p></aside></main>"
     "<section class=comments><h2>Comments</h2><article class=comment><p>I like this bridge.</p></article></section><footer>© 2024 Site</footer></body>",
     f"Bridge\n{TALK}\n{TALK} Yes\nOne"),
    (f"<div id=page><div class=top-bar><a href=/>Logo</a></div><div class=cookie-notice>We use cookies.</div><div class='post-content'><h2>Bridge</h2><p>{TALK}</p>"
     f"<div class='ad-slot'>Buy boots now.</div><p>{TALK}</p></div><div id=sidebar><h3>Popular</h3><ul><li><a href=/1>Mayor speaks</a></li></ul></div>"
     "<div id=comments><p>Nice.</p><p>I agree with all of it.</p></div><form><p>Your name</p></form><div id=footer>Copyright</div></div>", f"Bridge\n{TALK}\n{TALK}"),
    (f"<h1>Bridge</h1><p>{TALK}<p>{TALK}", f"Bridge\n{TALK}\n{TALK}")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://x/{k}", p) for k, p in enumerate([*sample_pages(), *(p for p, _ in HAND_MADE)])]
    rows += [(900, None, None), (901, "u", ""), (901, "u", ""), (None, "u", rows[0][2]), (902, "u", "<nav><ul><li><a href=/x>Home</a></li></ul></nav>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.fixture(scope="module")
def labeller(pages):
    return html_extract.fit(pages)


def test_extraction_of_unseen_pages(spark, pages, labeller):
    unseen = list(sample_pages(80, seed=77))
    got = html_extract.Reader(labeller).chosen(unseen)
    assert sum("\n".join(g) != truth(p) for g, p in zip(got, unseen)) <= 1
    layouts = list(html_extract.layouts(unseen, 150, 5, Paths(html_extract.PATH_BUCKETS)))
    reader = html_extract.Reader(labeller)
    right = total = 0
    for page, labels in layouts:
        items, texts = html_extract.items_of(page, reader.paths)
        if items:
            x, mask = recurrent.padded(reader._inputs(items), [len(items)])
            right += int(((labeller.logits(x, mask)[:, 0] > 0) == labels).sum())
            total += len(labels)
    assert right / total > 0.99


def test_extraction_defined_cases(pages, labeller):
    odd = pages.selectExpr("*", "1 AS text", "2 AS raw_page", "3 AS n_chars")
    got = html_extract.extract(odd, labeller).collect()
    assert set(got[0].asDict()) == {"page_id", "url", "raw_page", "n_chars", "blocks", "text"}
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r.text)
    assert len(got) == odd.count() and by_id[900] == [""] and by_id[901] == ["", ""] and by_id[902] == [""] and by_id[None] == by_id[0]
    for k, (_, want) in enumerate(HAND_MADE):
        assert by_id[120 + k] == [want]
    assert html_extract.extract(pages.limit(0), labeller).count() == 0


def test_extraction_of_long_and_deep_pages(labeller, monkeypatch):
    long = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{TALK} {k}</p>" for k in range(20_000)) + "</article><footer>© x</footer>"
    deep = "<div>" * 30_000 + f"<p>{TALK}</p>" + "</div>" * 30_000 + "</section>" * 30_000
    one = f"<article><p>{'word ' * 300_000}</p></article>"
    reader = html_extract.Reader(labeller)
    got = reader.chosen([long, deep, one, None])
    assert len(got[0]) == 20_000 and got[1] == [TALK] and len(got[2][0]) == 1_499_999 and got[3] == []
    some = list(sample_pages(30, seed=9))
    together = reader.chosen(some)
    monkeypatch.setattr(html_extract, "BATCH_BLOCKS", 1)
    assert reader.chosen(some) == together


def test_labeller_without_pages(spark, pages):
    model = html_extract.fit(pages.limit(0), n=20, rounds=1)
    assert html_extract.extract(pages, model).count() == pages.count()


# --- 12 hard negatives ----------------------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int, key int, size string"


def vector_rows(n=230, size=6, seed=2):
    rng = random.Random(seed)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rng.randint(-6, 9) / 8 for _ in range(size)], 0 if rng.random() < 0.4 else rng.randint(1, 3)) for k in range(n)]
    rows += [(200, list(rows[200][1]), 1), (300, None, 1), (301, [0.5] * (size - 1) + [None], 1), (302, [nan] * size, 1), (303, [inf] + [0.1] * (size - 1), 0),
             (400, [0.5] * (size + 1), 0), (401, [0.5] * (size + 1), 0), (402, [0.25] * (size + 1), 1), (500, [], 0), (501, [], 0), (502, [], 1), (None, rows[3][1], 0), (None, rows[4][1], 1),
             (600, rows[0][1], None), (700, [0.0] * size, 0), (800, [0.5] * size, 99)]
    return [(i, v, label, 7, "s") for i, v, label in rows]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    kept = [(k, i, [math.floor(256 * x) for x in v], label) for k, (i, v, label, *_) in enumerate(rows) if good(v) and label is not None]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for key, a, v, label in kept:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other == label) for k, i, w, other in kept if k != key and len(w) == len(v)]
        for p, p_id, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            near = sorted((r for r in scored if not r[2] and 80 * p <= 100 * r[0] <= 100 * p), key=order)[:5]
            out += [(a, p_id, rank + 1, n_id, p, n) for rank, (n, n_id, _) in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, anchors", [(4096, 512), (16, 2)])
def test_hard_negatives_against_brute_force(spark, block, anchors):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(frame, hard_negatives.F.col("id") % 100 == 0, block=block, anchors_in_block=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows) != []


def test_threshold_search_stops_and_loses_nothing():
    rng = np.random.default_rng(5)
    x = np.rint(rng.normal(size=(5000, 4)) * 100)
    lists, allowed = hard_negatives.Lists(x), rng.random(5000) < 0.5
    fewer = 0
    for _ in range(30):
        a = np.rint(rng.normal(size=4) * 100)
        scores = x @ a
        high = np.sort(scores)[-40]
        windows = np.array([[0.8 * high, high], [-np.inf, np.inf]])
        found, got, seen = lists.search(a, allowed, windows, 5)
        fewer += seen < 5000
        assert (scores[found] == got).all()
        for low, top in windows:
            want = np.sort(scores[allowed & (scores >= low) & (scores <= top)])[::-1][:5]
            assert (np.sort(got[(got >= low) & (got <= top)])[::-1][:5] == want).all()
    assert fewer == 30
    found, got, seen = lists.search(np.zeros(4), allowed, np.array([[0.0, 0.0]]), 5)
    assert seen == 5000 and len(found) == allowed.sum()


def test_large_components(spark):
    big = [(0, [99_000.0, 98_999.0], 0, 0, ""), (1, [99_001.0, 99_000.0], 0, 0, ""), (2, [98_000.0, 90_000.0], 1, 0, ""), (3, [97_999.0, 90_001.0], 1, 0, "")]
    got = hard_negatives.hard_negatives(spark.createDataFrame(big, SCHEMA), hard_negatives.F.col("id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(big)
    with pytest.raises(Exception, match="or more"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 0, 0, "")], SCHEMA), hard_negatives.F.col("id") == 0).collect()
    wide = vectors.matrix(np.array([1 << 25, 3, -(1 << 25), 5]), 2, 2)
    assert wide.dtype == np.float64 and vectors.matrix(np.full(80, 1 << 25), 2, 40).dtype == np.int64


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, hard_negatives.F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, 0, ""), (1, [1.0, 2.0], 2, 0, "")], SCHEMA)
    assert hard_negatives.hard_negatives(alone, hard_negatives.F.col("id") % 100 == 0).count() == 0


# --- 13 clustering --------------------------------------------------------------------------------------------------

def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if good(v) and len(v) == size]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda n: (far(v, centroids[n]), n))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, centroids)]
    placed = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept]
    total = sum(d for *_, d in placed)
    return sorted(((i, n, d, sum(e for _, m, e in placed if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in placed), key=repr)


@pytest.mark.parametrize("k, marks", [(16, 1 << 24), (5, 10), (400, 1 << 24)])
def test_clusters_against_brute_force(spark, monkeypatch, k, marks):
    monkeypatch.setattr(clustering, "MARKS", marks)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", hard_negatives.F.lit("x")).withColumn("vec", hard_negatives.F.lit(0)).repartition(3)
    got, centroids = clustering.cluster(frame, k=k, size=6)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, k, 3, 6)
    assert len(centroids) == min(k, sum(good(r[1]) and len(r[1]) == 6 for r in rows))


def test_orchard_search_measures_fewer():
    rng = np.random.default_rng(1)
    spots = rng.integers(-1000, 1000, (60, 3))
    x = spots[rng.integers(0, 60, 2000)] + rng.integers(-20, 20, (2000, 3))
    found, distance, measured = clustering.Orchard(spots).nearest(x)
    every = ((x[:, None] - spots[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all() and measured < 0.5 * every.size


def test_clusters_of_nothing(spark):
    got, centroids = clustering.cluster(spark.createDataFrame([(1, None, 0, 0, ""), (2, [0.5], 0, 0, "")], SCHEMA))
    assert got.count() == 0 and centroids.shape == (0, 64)
    same = spark.createDataFrame([(k % 2, [0.5] * 64, 0, 0, "") for k in range(5)], SCHEMA)
    assert {(r.cluster, r.distance) for r in clustering.cluster(same, k=3)[0].collect()} == {(0, 0)}
