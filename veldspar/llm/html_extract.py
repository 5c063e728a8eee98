"""Main text of raw pages: a recurrent labeller reads every block of a page with the blocks before and after it and says which belong to the article.

``fit`` trains on the driver.  A bounded sample of pages gives words and sentences; they are laid out as pages of many forms (``layouts``), so what is article and what
is menu, notice or reader comment is known by construction, and the marks of the given pages (``article``, ``nav``, ...) are only some of many.  Classes and tags
are left out at random, so order, links and neighbouring blocks count too.  ``extract`` labels every block of every page in tasks, in batches of bounded size: blocks of
one page never leave its task, and a page is as long as it is (its blocks are read one after the other).

Defined cases: a null or empty page, or one without a main text, has the empty text; repeated pages and ids are judged row by row; an empty table gives no rows and an
untrained labeller; pages that break off are read to their end; headings and captions inside an article belong to it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm import recurrent
from veldspar.llm.html_blocks import Paths, bucket, leaves
from veldspar.llm.tables import free_name, prepare_workers

PATH_BUCKETS, WORD_BUCKETS, PLAIN = 1 << 13, 1 << 11, 7
# Pages whose words the layouts are made of, bytes read of each, and layouts to train on.
SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS = 200, 8192, 1500
# Blocks of a batch, padding included; a longer page is a batch of its own.
BATCH_BLOCKS = 1 << 14


def words_of(text: str) -> list[int]:
    return [bucket(w, WORD_BUCKETS) for w in text.lower().split()]


def plain_of(text: str, n_words: int, linked: float, place: float) -> list[float]:
    return [np.log1p(n_words) / 5, linked, float(text[-1] in ".!?:;…\"'”»)"), float(any(c in text for c in "©|·»›")), float(n_words <= 3), place, 1 - place]


def items_of(page: str | None, paths: Paths) -> tuple[list, list[str]]:
    """The labeller's input for each block of a page, and the blocks' texts."""
    found = leaves(page, paths)
    items = []
    for k, (path, text, linked) in enumerate(found):
        words = words_of(text)
        items.append((path, words, plain_of(text, len(words), linked, k / len(found))))
    return items, [text for _, text, _ in found]


# --- layouts to learn from ------------------------------------------------------------------------------------------

_MENU = "nav menu navbar topnav navigation breadcrumb breadcrumbs toc links".split()
_HEADER = "header masthead topbar branding logo banner hero site-header page-header".split()
_FOOTER = "footer copyright colophon legal bottom site-footer page-footer".split()
_SIDE = "sidebar aside side widget related recommended popular archive secondary rail tags more-stories rightcol".split()
_NOTICE = "cookie cookies consent notice alert gdpr popup modal overlay paywall privacy warning message banner-notice announcement".split()
_ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adslot commercial adsbygoogle".split()
_FORM = "form search login signup subscribe newsletter contact register".split()
_COMMENT = "comments comment reply replies discussion respond commentlist thread feedback disqus responses".split()
_SHARE = "share social sharing follow buttons toolbar".split()
_ARTICLE = "article content post entry story main article-body post-content entry-content page-content maincontent text body".split()
_COMMON = {
    "menu": "Home News Sport About Contact Start Über Kontakt Accueil Inicio Archive Blog".split(),
    "footer": ["© {t}", "Copyright 2024 {t}", "All rights reserved.", "Privacy policy", "© {t} · {s}", "Impressum", "Mentions légales", "Terms of use"],
    "notice": ["This site uses cookies. {s}", "{s} Accept all cookies", "Accept", "Wir verwenden Cookies. {s}", "{s}", "Please enable JavaScript.", "Nous utilisons des cookies."],
    "advert": ["{s}", "Advertisement", "Sponsored: {s}", "Anzeige", "{s} {s}", "Publicité", "Buy now!"],
    "form": ["Name", "E-mail", "Password", "Search", "Subscribe to our newsletter", "Send", "Log in", "{t}"],
    "heading": ["Comments", "3 comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "12 responses"],
    "author": ["{t} says:", "{t}", "{t} wrote on 3 May", "Reply", "Guest"],
    "side": ["Related articles", "Most read", "Tags", "Recent posts", "{t}"],
    "share": ["Share", "Tweet", "Share on Facebook", "Print", "Follow us"],
}


class _Maker:
    """One page of random form; boxes are written as HTML, and each block's label goes along."""

    def __init__(self, rng: random.Random, sentences: list[str], words: list[str], paths: Paths):
        self.rng, self.sentences, self.words, self.paths = rng, sentences, words, paths
        self.html: list[str] = []
        self.labels: list[bool] = []

    def short(self) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(1, 4)))

    def sentence(self) -> str:
        return self.rng.choice(self.sentences)

    def phrase(self, kind: str) -> str:
        return self.rng.choice(_COMMON[kind]).format(t=self.short(), s=self.sentence())

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5))))

    def block(self, tag: str, text: str, label: bool, link: bool = False, attributes: str = "") -> None:
        text = text.replace("&", "&amp;").replace("<", "&lt;")
        if not text.split():
            return
        self.html.append(f"<{tag}{attributes}><a href='/x'>{text}</a></{tag}>" if link else f"<{tag}{attributes}>{text}</{tag}>")
        self.labels.append(label)

    def named(self, names: list[str], sure: float) -> str:
        """Class or id of a box; sometimes none, or one that says nothing."""
        r = self.rng
        if r.random() > sure:
            return r.choice(("", "", ' class="box"', ' class="col row"', ' id="s1"', ' class="wrap inner"'))
        name = r.choice(names)
        extra = r.choice(("", "", " box", " clearfix", " col"))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "", "site-", "main-", "the-"))}{name}{extra}"'

    def box(self, tag: str, attributes: str, inside) -> None:
        self.html.append(f"<{tag}{attributes}>")
        inside()
        self.html.append(f"</{tag}>")

    # what surrounds an article

    def menu(self):
        r = self.rng
        tag, sure = r.choice((("nav", 0.3), ("nav", 0.3), ("div", 0.95), ("ul", 0.95), ("header", 0.3)))

        def links():
            for _ in range(r.randint(2, 9)):
                self.block(r.choice(("li", "li", "li", "div", "p")), r.choice((self.short(), r.choice(_COMMON["menu"]))), False, r.random() < 0.9)
        self.box(tag, self.named(_MENU, sure), (lambda: self.box("ul", "", links)) if tag != "ul" and r.random() < 0.7 else links)

    def header(self):
        def inside():
            self.block(self.rng.choice(("h1", "h2", "p", "div", "div")), self.short(), False, self.rng.random() < 0.4)
            if self.rng.random() < 0.5:
                self.block(self.rng.choice(("p", "div")), self.rng.choice((self.sentence(), self.short())), False)
            if self.rng.random() < 0.4:
                self.menu()
        tag, sure = self.rng.choice((("header", 0.3), ("header", 0.3), ("div", 1.0)))
        self.box(tag, self.named(_HEADER, sure), inside)

    def footer(self):
        def inside():
            for _ in range(self.rng.randint(1, 4)):
                self.block(self.rng.choice(("p", "div", "li", "p")), self.phrase("footer"), False, self.rng.random() < 0.3)
        tag, sure = self.rng.choice((("footer", 0.2), ("footer", 0.2), ("div", 1.0)))
        if self.rng.random() < 0.3:
            self.html.append(f"<{tag}{self.named(_FOOTER, sure)}>{self.phrase('footer').replace('&', '&amp;')}</{tag}>")
            self.labels.append(False)
        else:
            self.box(tag, self.named(_FOOTER, sure), inside)

    def texts(self, names: list[str], kind: str, tags: tuple, bare: bool = True):
        """A box of a few texts of one kind, or a box that is the text."""
        r = self.rng
        tag, sure = r.choice(tags)
        if tag == "p" or bare and r.random() < 0.5:
            self.block(tag, self.phrase(kind), False, attributes=self.named(names, sure))
            return

        def inside():
            for _ in range(r.randint(1, 4)):
                text = self.phrase(kind) if r.random() < 0.6 else r.choice((self.paragraph(), self.short()))
                self.block(r.choice(("p", "p", "div", "li", "h3", "h4", "button" if kind in ("notice", "form", "share") else "p")), text, False, r.random() < 0.3)
        self.box(tag, self.named(names, sure), inside)

    def side(self):
        self.texts(_SIDE, "side", (("aside", 0.3), ("aside", 0.3), ("div", 1.0), ("section", 1.0)), bare=False)

    def notice(self):
        self.texts(_NOTICE, "notice", (("div", 1.0), ("div", 1.0), ("section", 1.0), ("p", 1.0), ("dialog", 0.5), ("aside", 0.6)))

    def advert(self):
        self.texts(_ADVERT, "advert", (("div", 1.0), ("div", 1.0), ("aside", 0.6), ("p", 1.0), ("section", 1.0)))

    def form(self):
        self.texts(_FORM, "form", (("form", 0.3), ("form", 0.3), ("fieldset", 0.3), ("div", 1.0)), bare=False)

    def share(self):
        self.texts(_SHARE, "share", (("div", 1.0), ("ul", 1.0)), bare=False)

    def comments(self):
        r = self.rng
        tag, sure = r.choice((("section", 1.0), ("div", 1.0), ("div", 1.0), ("ol", 1.0), ("aside", 0.7)))

        def one():
            if r.random() < 0.7:
                self.block(r.choice(("h4", "p", "div", "div")), self.phrase("author"), False, r.random() < 0.3)
            for _ in range(r.randint(1, 2)):
                self.block("p", self.paragraph(), False)

        def inside():
            if r.random() < 0.7:
                self.block(r.choice(("h2", "h3", "h4")), self.phrase("heading"), False)
            inner = r.choice(("li", "div", "article", "none", "none"))
            for _ in range(r.randint(1, 4)):
                if inner == "none":
                    one()
                else:
                    self.box(inner, self.named(_COMMENT, 0.6), one)
            if r.random() < 0.3:
                self.form()
        self.box(tag, self.named(_COMMENT, sure), inside)

    # the article itself

    def article(self):
        r = self.rng
        tag, sure = r.choice((("article", 0.3), ("article", 0.3), ("article", 0.3), ("main", 0.3), ("div", 1.0), ("div", 1.0), ("section", 1.0), ("td", 0.8), ("div", 0.0)))

        def body():
            for k in range(r.choice((0, 1, 2, 3, 5, 8, 14))):
                part = r.random()
                if part < 0.66:
                    # the words alone must not decide: an article may say what a footer or a notice says
                    text = r.choice((self.paragraph, self.paragraph, self.sentence, lambda: self.short() + r.choice((".", ".", "!", "…", "", " %%")), lambda: self.phrase(r.choice(list(_COMMON)[1:]))))()
                    for _ in range(r.choice((1, 1, 1, 1, 1, 1, 6))):
                        self.block("p", text, True, attributes=r.choice(("", "", "", ' class="lead"')))
                elif part < 0.74:
                    self.block(r.choice(("h2", "h3")), r.choice((self.short(), self.sentence())), True)
                elif part < 0.80:
                    def points():
                        for _ in range(r.randint(1, 4)):
                            self.block("li", r.choice((self.sentence(), self.short())), True, r.random() < 0.15)
                    self.box(r.choice(("ul", "ol")), "", points)
                elif part < 0.83:
                    self.box("blockquote", "", lambda: self.block("p", self.paragraph(), True))
                elif part < 0.86:
                    self.block("pre", self.sentence(), True)
                elif part < 0.88:
                    self.box("figure", "", lambda: self.block("figcaption", self.sentence(), True))
                elif part < 0.90:
                    self.box("table", "", lambda: self.box("tr", "", lambda: [self.block("td", self.short(), True) for _ in range(3)]))
                elif part < 0.92:
                    self.block("div", self.paragraph(), True)
                elif part < 0.95:
                    self.advert()
                else:
                    r.choice((self.side, self.share, self.notice, self.form))()

        def inside():
            if r.random() < 0.85:
                heading = lambda: self.block(r.choice(("h1", "h1", "h2")), r.choice((self.sentence(), self.short())), True)
                if tag in ("article", "main") and r.random() < 0.12:
                    self.box("header", "", heading)
                else:
                    heading()
            if r.random() < 0.25:
                self.box(r.choice(("div", "section")), self.named(_ARTICLE, 0.7), body)
            else:
                body()
            if tag in ("article", "main") and r.random() < 0.15:
                r.choice((self.comments, self.footer, self.side, self.share))()
        self.box(tag, self.named(_ARTICLE, sure), inside)

    def page(self):
        r = self.rng
        before = [self.menu] if r.random() < 0.8 else []
        for part, share in ((self.header, 0.4), (self.notice, 0.3), (self.advert, 0.5), (self.side, 0.15), (self.form, 0.15), (self.share, 0.05)):
            if r.random() < share:
                before.append(part)
        r.shuffle(before)
        after = [part for part, share in ((self.share, 0.15), (self.advert, 0.25), (self.comments, 0.4), (self.side, 0.35), (self.form, 0.2), (self.notice, 0.2), (self.menu, 0.1))
                 if r.random() < share]
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.footer)
        wraps = [r.choice(("div", "section")) for _ in range(r.choice((0, 0, 0, 1, 2)))]
        if r.random() < 0.04:
            wraps.append("form")
        for tag in wraps:
            self.html.append(f'<{tag}{self.named(["wrapper", "page", "container", "site", "main"], 0.8)}>')
        for part in before:
            part()
        middle = r.random()
        wrap = r.choice(("main", "div")) if middle < 0.3 else ""
        if wrap:
            self.html.append(f"<{wrap}>")
        if r.random() < 0.97:
            self.article()
        inner = after[:1] if wrap and r.random() < 0.5 else []
        for part in inner:
            part()
        if wrap:
            self.html.append(f"</{wrap}>")
        for part in after[len(inner):]:
            part()
        return "<html><body>" + "".join(self.html) + "</body></html>"


def layouts(pages: list[str], n: int, seed: int, paths: Paths) -> Iterator[tuple[str, list[bool]]]:
    """Pages of many forms made of the sentences and words of ``pages``: (html, label of each block)."""
    rng = random.Random(seed)
    texts = [text for page in pages for _, text, _ in leaves(page, paths)]
    sentences = [s for text in texts for part in text.split(". ") if (s := part.strip()[:400])] or ["a b c."]
    words = [w for s in sentences for w in s.split()] or ["a"]
    for _ in range(n):
        maker = _Maker(rng, sentences, words, paths)
        page = maker.page()
        yield page, maker.labels


def _training(pages: list[str], n: int, seed: int, paths: Paths) -> list:
    out = []
    for page, labels in layouts(pages, n, seed, paths):
        items, _ = items_of(page, paths)
        if items and len(items) == len(labels):
            out.append([(*item, label) for item, label in zip(items, labels)])
    return out


def _sample(pages: DataFrame, html_col: str, sample: int, sample_bytes: int) -> list[str]:
    """The beginnings of the ``sample`` pages with the smallest hashes, each text once; a task hands on no more than ``sample`` hashes."""
    hashed = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("x"), F.col(html_col).alias("h"))

    def smallest(batches):
        kept = np.zeros(0, np.int64)
        for batch in batches:
            kept = np.unique(np.concatenate([kept, batch.column("x").to_numpy()]))[:sample]
        yield pa.RecordBatch.from_arrays([pa.array(kept)], names=["x"])

    last = hashed.select("x").mapInArrow(smallest, "x long").distinct().orderBy("x").limit(sample).agg(F.max("x")).first()[0]
    if last is None:
        return []
    chosen = hashed.filter(F.col("x") <= last).groupBy("x").agg(F.min(F.substring("h", 1, sample_bytes)).alias("h"))
    return [r["h"] for r in sorted(chosen.collect())]


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, n: int = LAYOUTS, seed: int = 11,
        rounds: int = 8) -> recurrent.Labeller:
    """Train on layouts made of a sample of at most ``sample`` pages (the first ``sample_bytes`` characters of each), chosen by a hash of their text."""
    prepare_workers(pages.sparkSession)
    rows = _sample(pages, html_col, sample, sample_bytes)
    paths = Paths(PATH_BUCKETS)
    model = recurrent.Labeller.fresh(PATH_BUCKETS, WORD_BUCKETS, PLAIN, seed)
    recurrent.train(model, _training(rows, n, seed, paths), rounds, 24, seed)
    return model


# --- labelling ------------------------------------------------------------------------------------------------------

class Reader:
    """Labels the blocks of many pages; path vectors are kept for the paths of a batch only."""

    def __init__(self, model: recurrent.Labeller):
        self.model, self.paths = model, Paths(PATH_BUCKETS)

    def _inputs(self, items: list) -> np.ndarray:
        number: dict[frozenset[int], int] = {}
        place = np.fromiter((number.setdefault(item[0], len(number)) for item in items), int, len(items))
        weights = self.model.weights
        by_path = recurrent.pooled(weights["path"], [sorted(p) for p in number], False)
        return np.concatenate([by_path[place], recurrent.pooled(weights["word"], [item[1] for item in items], True),
                               np.array([item[2] for item in items], np.float32)], 1)

    def chosen(self, pages: list) -> list[list[str]]:
        """The article's blocks of each page."""
        read = [items_of(page, self.paths) for page in pages]
        out: list[list[str]] = [[] for _ in pages]
        order = sorted((k for k in range(len(pages)) if read[k][0]), key=lambda k: len(read[k][0]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(read[order[end]][0]) * (end + 1 - at) <= BATCH_BLOCKS:
                end += 1
            batch = order[at:end]
            at = end
            x, mask = recurrent.padded(self._inputs([i for k in batch for i in read[k][0]]), [len(read[k][0]) for k in batch])
            yes = self.model.logits(x, mask) > 0
            for b, k in enumerate(batch):
                out[k] = [text for text, keep in zip(read[k][1], yes[:, b]) if keep]
        return out


def _portions(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def extract(pages: DataFrame, model: recurrent.Labeller, html_col: str = "html", name: str = "text", blocks_name: str = "blocks") -> DataFrame:
    """``pages`` without the HTML, with the article's blocks and its text (blocks joined by a line feed); columns of these names are replaced."""
    spark = pages.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    raw = free_name(pages, "raw_page")
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), name.lower(), blocks_name.lower())]
    sent = pages.select(*others, F.col(html_col).cast("string").alias(raw))
    schema = T.StructType([*(sent.schema[c] for c in others), T.StructField(blocks_name, T.ArrayType(T.StringType(), False), False)])

    def label(batches):
        reader = Reader(shared.value)
        for batch in batches:
            column = batch.column(raw)
            rest = [batch.column(c) for c in others]
            for lo, hi in _portions(column):
                got = reader.chosen(column.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), pa.array(got, pa.list_(pa.string()))], names=[*others, blocks_name])

    return sent.mapInArrow(label, schema).withColumn(name, F.array_join(blocks_name, "\n"))
