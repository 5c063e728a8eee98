"""HTML as a sequence of leaf blocks: the text between two block boundaries, with the tags, classes and ids it lies in.

Tags that only format text don't end a block; everything else does.  Elements whose end is implied (p, li, td, ...) are closed as browsers do; end tags without a
start and starts without an end do no harm.  Comments, declarations and elements that hold no running text (scripts, styles, drawings, option lists) are skipped
whole; one that never ends reaches to the end of the page.  Character references are decoded, also those without a semicolon where HTML allows it; white space,
line breaks included, becomes one space.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

# Names from the HTML standard (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math output q rb rp rt rtc ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script style noscript template textarea title iframe noframes noembed xmp svg select datalist object audio video canvas".split()
# An element on the left ends an open one of the names on the right, unless one of the containers lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tr"),
        "tfoot": ("tbody", "tr")}
CONTAINERS = frozenset("ul ol menu dl table body html button".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(SKIPPED)})(?=[\s/>])(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
NAMED = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def bucket(word: str, buckets: int) -> int:
    """A word's place in a hashed table; bytes that are no text are kept as they are."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


class Paths:
    """Tags, classes and ids as hashed numbers; a path is the set of numbers of all elements around a block, and of its own tag once more."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[str, frozenset[int]] = {}

    def element(self, tag: str, attributes: str) -> frozenset[int]:
        at = f"{tag} {attributes}"
        found = self.known.get(at)
        if found is None:
            words = [f"tag {tag}"]
            for name in NAMED.finditer(attributes):
                words += [f"name {w.lower()}" for w in WORD.findall(name[2] or name[3] or name[4] or "")]
            found = frozenset(bucket(w, self.buckets) for w in words)
            if len(self.known) < 20_000 and len(at) < 500:  # a memo only; anything beyond is worked out again
                self.known[at] = found
        return found

    def leaf(self, tag: str) -> int:
        return bucket(f"leaf {tag}", self.buckets)


def leaves(page: str | None, paths: Paths) -> list[tuple[frozenset[int], str, float]]:
    """(path, text, share of the text that is linked) of every block with text, in page order."""
    page = page or ""
    stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
    open_now: Counter[str] = Counter()
    out, parts = [], []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join(html.unescape(raw).split())
            if text:
                tag, path = stack[-1]
                out.append((path | {paths.leaf(tag)}, text, min(1.0, linked / len(raw))))
        linked = 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    def back_to(k):
        open_now.subtract(name for name, _ in stack[k:])
        del stack[k:]

    def close(names):
        if any(open_now[name] > 0 for name in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return back_to(k)
                if stack[k][0] in CONTAINERS:
                    return

    for found in TAG.finditer(page):
        add(page[at:found.start()])
        at = found.end()
        tag = found[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not found[2]
        elif tag in INLINE:
            continue
        elif found[2]:
            flush()
            if open_now[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                back_to(k)
        else:
            flush()
            if tag not in VOID:
                close(("p",))
                if tag in ENDS:
                    close(ENDS[tag])
                stack.append((tag, stack[-1][1] | paths.element(tag, found[4] or "")))
                open_now[tag] += 1
    add(page[at:])
    flush()
    return out
