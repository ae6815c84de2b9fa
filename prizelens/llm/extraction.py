"""Main text of pages by a tree-structured graphical model over the DOM.

Every block element of a page is a variable, article or not. A unary potential looks at
the block itself (tag, names, links, length); a pairwise potential, by kind of child,
ties it to its parent. The DOM is a tree, so one upward and one downward pass of
sum-product messages gives exact marginals. The weights maximise the likelihood of the
labels of ``labelled_pages``, whose gradient needs just these marginals.

Pages are read in the tasks, one Arrow batch at a time; the messages of all trees of a
batch travel together, level by level.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.llm.labelled_pages import N_PAGES, labelled_pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)>",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r'data-label="([01])"')
CUT_TAG = re.compile(r"<[/a-zA-Z]")  # behind the last ">": a tag that the page's end cuts off
BLOCK_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
# What HTML says of elements.
RAW = frozenset("script style noscript iframe textarea title".split())
MUTE = frozenset("template svg canvas audio video select button datalist annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html ins li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul caption legend label"
).split()) - {"label", "legend"}
CLOSES_P = BLOCK - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "ins"}
# An opening tag that ends an open one, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
KINDS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu", "dir"},
    {"div", "center", "section", "details", "ins"}, {"article", "main"}, {"nav"}, {"header"}, {"footer", "address"},
    {"aside", "dialog"}, {"form", "fieldset"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"blockquote", "pre", "figure", "figcaption", "summary"}, {"html", "body"},
]
KIND_OF = {tag: i for i, tags in enumerate(KINDS) for tag in tags}
# Words in class and id names, by what they speak for.
HINTS = [
    set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle".split()),
    set("nav navbar navigation menu breadcrumb breadcrumbs toc links pagination pager tabs".split()),
    set("footer copyright legal bottom imprint colophon".split()),
    set("header masthead topbar banner logo top".split()),
    set("sidebar aside widget related recommended popular trending more rail".split()),
    set("cookie cookies notice consent gdpr popup modal alert overlay newsletter subscribe subscription signup login promo".split()),
    set("comment comments commentlist discussion replies reply respond disqus feedback reader".split()),
    set("share social sharing tags tag author meta byline search form".split()),
    set("content article post entry story main text body prose page".split()),
]
N_KINDS, N_HINTS = len(KINDS), len(HINTS)
N_FEATURES = 1 + N_KINDS + N_HINTS + 7
STEPS, STEP_SIZE, DECAY = 400, 0.1, 5e-4


def element_ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a kind end, by where they open; those never closed are left out."""
    opened: list[int] = []
    ends: dict[int, int] = {}
    until = 0
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])", page, re.I):
        if m.start() < until:  # inside the tag before
            continue
        until = page.find(">", m.end())
        if until < 0:
            break
        if m[1]:
            if opened:
                ends[opened.pop()] = m.start()
        elif page[until - 1] != "/":
            opened.append(m.start())
    return ends


def mute_end(page: str, at: int, end: int | None, outer: Counter) -> int:
    """Where an element without text of the article ends: at its end tag, or before it where
    a block of ``outer`` ends; one never closed holds no block."""
    inner: list[str] = []
    for m in BLOCK_TAG.finditer(page, at, len(page) if end is None else end):
        tag = m[2].lower()
        if tag not in BLOCK:
            continue
        if end is None:
            return m.start()
        if not m[1]:
            inner.append(tag)
        elif tag in inner:
            while inner.pop() != tag:
                pass
        elif outer[tag]:
            return m.start()
    return len(page) if end is None else end


def read_page(page: str) -> tuple[list, list, list]:
    """Blocks ``[parent, depth, kind, hints, label, chars, link chars, stops]`` in page order,
    texts ``(block, text)`` in page order, nothing else of the page."""
    blocks = [[-1, 0, N_KINDS - 1, 0, -1, 0, 0, 0]]
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: Counter = Counter()  # how often a tag stands in the stack
    pieces: list[str] = []
    ends: dict[str, dict[int, int]] = {}
    links, at, in_head = 0, 0, False
    cut = CUT_TAG.search(page, page.rfind(">") + 1)
    if cut:
        page = page[: cut.start()]

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack[-1][1]
                texts.append((top, text))
                blocks[top][5] += len(text)
                blocks[top][7] += text[-1] in ".!?:;…\"”)"

    def add(raw: str) -> None:
        if in_head or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            blocks[stack[-1][1]][6] += len(text)

    def close_to(k: int) -> None:
        nonlocal links
        flush()
        for tag, _ in stack[k:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    def close(tags: set[str], stops: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                close_to(k)
                return
            if stack[k][0] in stops:
                return

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag == "head":
                in_head = False
            elif tag == "br" or tag == "p" and not opened["p"]:
                pieces.append(" ")
            elif tag in BLOCK and opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close_to(k)
                        break
            elif tag == "a" and links:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "a":
                        del stack[k]
                        opened["a"] -= 1
                        links -= 1
                        break
                    if stack[k][0] in BLOCK:
                        break
            continue
        if tag in MUTE:
            if not attrs.endswith("/"):
                if tag not in ends:
                    ends[tag] = element_ends(page, tag)
                at = mute_end(page, at, ends[tag].get(m.start()), opened)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "head":
            in_head = True
        elif tag == "br" or tag == "hr" or tag == "img":
            pieces.append(" ")
            if tag == "hr":
                flush()
        elif tag == "a":
            links += 1
            stack.append(("a", stack[-1][1]))
            opened["a"] += 1
        elif tag in BLOCK:
            in_head = False
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "table", "button"})
            if tag in ENDS:
                close(*ENDS[tag])
            flush()
            parent = stack[-1][1]
            hints = 0
            label = -1
            if attrs:
                names = " ".join(x for found in NAMES.findall(attrs) for x in found if x)
                parts = {p for p in SPLIT.split(names.lower()) if p} if names else ()
                for i, words in enumerate(HINTS):
                    if not words.isdisjoint(parts):
                        hints |= 1 << i
                marked = LABEL.search(attrs)
                label = int(marked[1]) if marked else -1
            blocks.append([parent, blocks[parent][1] + 1, KIND_OF.get(tag, 4), hints, label, 0, 0, 0])
            stack.append((tag, len(blocks) - 1))
            opened[tag] += 1
    flush()
    return blocks, texts, stack


class Forest:
    """The blocks of many pages as arrays; parents come before their children."""

    def __init__(self, pages: list[list]):
        rows, first = [], []
        for blocks in pages:
            first.append(len(rows))
            base = len(rows)
            rows += [[b[0] + base if b[0] >= 0 else -1, *b[1:]] for b in blocks]
        a = np.array(rows, np.int64).reshape(-1, 8)
        self.first = np.array([*first, len(rows)])
        self.parent, self.kind, self.label = a[:, 0], a[:, 2], a[:, 4]
        self.levels = [np.flatnonzero(a[:, 1] == d) for d in range(int(a[:, 1].max(initial=0)) + 1)]
        chars, links = a[:, 5].astype(float), a[:, 6].astype(float)
        x = np.zeros((len(a), N_FEATURES))
        x[:, 0] = 1
        x[np.arange(len(a)), 1 + self.kind] = 1
        for i in range(N_HINTS):
            x[:, 1 + N_KINDS + i] = (a[:, 3] >> i) & 1
        own = x[:, 1 + N_KINDS + N_HINTS :]
        own[:, 0] = np.log1p(chars) / 5
        own[:, 1] = chars > 0
        own[:, 2] = np.where(chars > 0, np.minimum(links / np.maximum(chars, 1), 1), 0)
        own[:, 3] = (chars > 0) & (a[:, 7] > 0)
        own[:, 4] = (chars > 0) & (chars < 25)
        # Links in what stands below: lists of links are menus even where items are short.
        below = np.stack([chars, links], 1)
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
        own[:, 5] = np.minimum(below[:, 1] / np.maximum(below[:, 0], 1), 1)
        own[:, 6] = np.log1p(below[:, 0]) / 8
        self.x = x

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(block is article) and, per block, the joint table with its parent.

        ``pair[kind of child, parent label, child label]`` in logarithms.
        """
        n = len(self.parent)
        up = np.zeros((n, 2))  # product of messages from below, with the own potential
        up[:, 1] = unary
        sent = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            table = pair[self.kind[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(table[:, :, 0], table[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            table = (up[p] + down[p] - sent[level])[:, :, None] + pair[self.kind[level]]
            down[level] = np.logaddexp(table[:, 0, :], table[:, 1, :])
            table = table + up[level][:, None, :]
            table = np.exp(table - table.max((1, 2), keepdims=True))
            joint[level] = table / table.sum((1, 2), keepdims=True)
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), joint


def train(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the unary and logarithms of the pairwise potentials (by Adam steps)."""
    forest = Forest([read_page(p)[0] for p in pages])
    y = np.where(forest.label < 0, 1, forest.label)  # page roots hold the article
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]], y[child]] = 1
    w, pair = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, STEPS + 1):
        p, joint = forest.marginals(forest.x @ w, pair)
        g_w = forest.x.T @ (y - p) / len(pages) - DECAY * w
        g_pair = np.zeros_like(pair)
        np.add.at(g_pair, forest.kind[child], seen[child] - joint[child])
        g_pair = g_pair / len(pages) - DECAY * pair
        for g, first, second, value in ((g_w, 0, 1, w), (g_pair, 2, 3, pair)):
            moments[first] = 0.9 * moments[first] + 0.1 * g
            moments[second] = 0.99 * moments[second] + 0.01 * g * g
            value += STEP_SIZE * (moments[first] / (1 - 0.9**t)) / (np.sqrt(moments[second] / (1 - 0.99**t)) + 1e-8)
    return w, pair


def main_texts(pages: list[str], w: np.ndarray, pair: np.ndarray) -> list[str]:
    read = [read_page(p) for p in pages]
    forest = Forest([r[0] for r in read])
    keep = forest.marginals(forest.x @ w, pair)[0] > 0.5
    return [
        " ".join(text for block, text in texts if keep[first + block])
        for first, (_, texts, _) in zip(forest.first, read)
    ]


PAGES_AT_ONCE = 200


def extractor(w: np.ndarray, pair: np.ndarray):
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        out: list[str] = []
        for start in range(0, len(pages), PAGES_AT_ONCE):
            part = [p or "" for p in pages.slice(start, PAGES_AT_ONCE).to_pylist()]
            out += main_texts(part, w, pair)
        return pa.array(out, pa.string())

    return extract


def extract_text(pages: DataFrame, html_column: str = "html", sample: int = N_PAGES) -> DataFrame:
    """``pages`` with ``text``, the article of the page, and ``n_chars``, its code points.

    The model is trained on ``sample`` labelled pages, a fixed number that does not grow
    with the input. Null or empty html gives an empty text. White space inside a block
    becomes one space; blocks are joined in page order. A button, drawing or player that is not
    closed ends where the next block begins or ends, so it takes no text along. Columns named like the new ones
    are replaced; repeated rows get the same text.
    """
    extract = extractor(*train(labelled_pages(sample)))
    out = pages.withColumn("_text", extract(F.col(html_column)))
    return out.withColumns({"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}).drop("_text")
