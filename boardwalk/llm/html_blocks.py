"""Main text of web pages from flat text blocks, by a decision tree.

A page is cut into text blocks at its block elements. A block is described by its words and link density and those of the
blocks before and after it, and by where it stands: under a menu, form, notice or the like, and in which kind of container.
A decision tree, trained on the blocks of the labelled pages in ``labelled_pages``, says which are the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import over_texts
from boardwalk.llm.labelled_pages import MARK, PAGES

# Elements of HTML by what they do to text.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNREAD = frozenset("audio canvas iframe math noembed noframes noscript object script style svg template textarea title video".split())
SHELLS = frozenset("aside button dialog dir footer form label menu nav search select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id that tell menus, notices and the like; the first list as whole words, the second as parts of words.
WHOLE = "ad ads adv adbox banner bar box-ad gdpr lang legal login menu modal nav pager popup promo rail related reply replies search share side signup skip social tags teaser toc tools top-bar widget"
PARTS = "advert breadcrumb comment consent cookie copyright disclaimer discuss disqus footer masthead menubar navbar navig newsletter notice notification pagination popular privacy recommend respond sidebar sidenav sponsor subscri toolbar topbar trending"
HOLDERS = "article content entry main post story"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HINT = re.compile(rf"(?<![a-z])(?:{'|'.join(WHOLE.split())})(?![a-z])|{'|'.join(PARTS.split())}")
_HOLDER = re.compile(rf"(?<![a-z])(?:{'|'.join(HOLDERS.split())})(?![a-z])|articlebody")
_HEADER = re.compile(r"(?<![a-z])header(?![a-z])")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

IN_NONE, IN_NAMED, IN_MAIN, IN_ARTICLE = range(4)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    shell: bool
    holder: int
    heading: bool
    marked: bool


def standing(tag: str, attributes: str, shell: bool, holder: int) -> tuple[bool, int, bool]:
    """Whether an element is (in) a shell, its container's kind, and whether it is marked as labelled."""
    own = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip("/ \n\t") else {}
    names = _HUMPS.sub("-", f"{own.get('class', '')} {own.get('id', '')}").lower()
    role = own.get("role", "").lower()
    if tag in ("html", "body"):
        return shell, holder, MARK in own
    named = bool(_HOLDER.search(names)) or own.get("itemprop", "").lower() == "articlebody"
    if tag == "article" or role == "article":
        holder = max(holder, IN_ARTICLE)
    elif tag == "main" or role == "main":
        holder = max(holder, IN_MAIN)
    elif named:
        holder = max(holder, IN_NAMED)
    shell = shell or tag in SHELLS or role in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
    shell = shell or bool(_HIDDEN.search(own.get("style", "").lower()))
    if tag != "main" and role != "main":
        shell = shell or bool(_HINT.search(names))
    if holder < IN_MAIN and not named:
        shell = shell or tag == "header" or bool(_HEADER.search(names))
    return shell, holder, MARK in own


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Elements that are not closed end with what holds them, as do cut pages."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []
    shell, holder, marked = False, IN_NONE, False
    texts: list[str] = []
    words = linked = links = 0
    heading = False
    place = 0

    def close():
        nonlocal words, linked, texts
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                n = text.count(" ") + 1
                found.append(Block(text, n, min(n, linked), shell, holder, heading, marked))
        texts, words, linked = [], 0, 0

    def add(text):
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            texts.append(text)
            if links:
                linked += len(text.split())

    def pop_to(at):
        nonlocal shell, holder, marked, links, heading
        for tag, *_ in stack[at:]:
            links -= tag == "a"
            heading = heading and tag[0] != "h"
        _, shell, holder, marked = stack[at]
        del stack[at:]

    while (tag := _TAG.search(page, place)) is not None:
        add(page[place : tag.start()])
        place = tag.end()
        if tag[2] is None:
            continue
        name, ends = tag[2].lower(), tag[1]
        if name in UNREAD and not ends:
            if not tag[3].endswith("/"):
                end = re.compile(rf"</{name}(?![\w-])[^>]*>?", re.I).search(page, place)
                place = end.end() if end else len(page)
            continue
        if name in BREAKS:
            close()
        elif name in ("br", "img", "input", "wbr"):
            texts.append("" if name == "wbr" else " ")
        if ends:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                if name not in BREAKS and any(s[0] in BREAKS for s in stack[at:]):
                    continue  # an inline element ends no block
                pop_to(at)
            continue
        if name in VOID:
            continue
        if name in BREAKS:
            at = _implied(stack, name)
            if at is not None:
                pop_to(at)
        stack.append((name, shell, holder, marked))
        links += name == "a"
        heading = heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")
        shell, holder, own = standing(name, tag[3], shell, holder)
        marked = marked or own
    add(page[place:])
    close()
    return found


_LISTED = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _implied(stack: list, name: str) -> int | None:
    """Where the stack is cut as ``name`` begins: it ends an open paragraph, and a list item, row or cell its sibling."""
    same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
    for i in range(len(stack) - 1, -1, -1):
        tag = stack[i][0]
        if tag == "p" or name in _LISTED and tag in same:
            return i
        if tag in BREAKS and (name not in _LISTED or tag in _LISTED[name]):
            return None
    return None


FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after", "shell", "holder", "below_best", "heading", "shell_before", "shell_after")


def figures(page: list[Block]) -> np.ndarray:
    """For each block its words and link density and its neighbours', and where it stands. ``below_best``: whether the page
    has text in a better kind of container."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    links = np.array([b.linked for b in page]) / words
    shell = np.array([b.shell for b in page], float)
    holder = np.array([b.holder for b in page], float)
    best = max((b.holder for b in page if not b.shell), default=0)

    def before(x, end=0.0):
        return np.concatenate([[end], x[:-1]])

    def after(x, end=0.0):
        return np.concatenate([x[1:], [end]])

    heading = [float(b.heading) for b in page]
    return np.column_stack([before(words), before(links), words, links, after(words), after(links), shell, holder, holder < best, heading, before(shell, 1.0), after(shell, 1.0)])


class Tree:
    """A binary decision tree by Gini impurity: ``depth`` splits at most, ``least`` rows on either side."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 7, least: int = 2):
        self.feature, self.cut, self.low, self.high, self.share = [], [], [], [], []
        self._grow(rows, labels.astype(float), depth, least)
        self.feature, self.cut, self.low, self.high, self.share = map(np.array, (self.feature, self.cut, self.low, self.high, self.share))

    def _grow(self, rows, labels, depth, least) -> int:
        node = len(self.share)
        for part, value in ((self.feature, -1), (self.cut, 0.0), (self.low, node), (self.high, node), (self.share, labels.mean())):
            part.append(value)
        split = self._split(rows, labels, least) if depth and 0 < labels.mean() < 1 else None
        if split:
            feature, cut = split
            under = rows[:, feature] <= cut
            self.feature[node], self.cut[node] = feature, cut
            self.low[node] = self._grow(rows[under], labels[under], depth - 1, least)
            self.high[node] = self._grow(rows[~under], labels[~under], depth - 1, least)
        return node

    @staticmethod
    def _split(rows, labels, least):
        """The feature and border with the least impurity; of equal ones the first feature, and its lowest border."""
        n, best, found = len(labels), len(labels) * labels.mean() * (1 - labels.mean()) - 1e-9, None
        for feature in range(rows.shape[1]):
            order = np.argsort(rows[:, feature], kind="stable")
            x, ones = rows[order, feature], np.cumsum(labels[order])
            at = np.flatnonzero(x[1:] > x[:-1]) + 1
            at = at[(at >= least) & (at <= n - least)]
            if len(at):
                a, b = ones[at - 1], ones[-1] - ones[at - 1]
                impurity = a * (1 - a / at) + b * (1 - b / (n - at))
                i = int(impurity.argmin())
                if impurity[i] < best:
                    best, found = impurity[i], (feature, (x[at[i]] + x[at[i] - 1]) / 2)
        return found

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """True where at least half of the training rows of the same leaf were the article."""
        node = np.zeros(len(rows), int)
        while (self.feature[node] >= 0).any():
            inner = self.feature[node] >= 0
            under = rows[np.arange(len(rows)), np.maximum(self.feature[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(under, self.low[node], self.high[node]), node)
        return self.share[node] >= 0.5


def labelled_table(pages=PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The figures of the blocks of labelled pages, and whether each is marked as the article."""
    parsed = [blocks(p) for p in pages]
    return np.concatenate([figures(p) for p in parsed]), np.array([b.marked for p in parsed for b in p])


def train(pages=PAGES) -> Tree:
    return Tree(*labelled_table(pages))


def _judged(column: pa.Array, tree: Tree):
    """For each page its blocks and which of them are the article; all blocks of the batch go through the tree at once."""
    parsed = [blocks(p or "") for p in column.to_pylist()]
    main = tree.predict(np.concatenate([np.zeros((0, len(FEATURES))), *map(figures, parsed)]))
    at = 0
    for page in parsed:
        yield page, main[at : at + len(page)]
        at += len(page)


def _columns(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    return pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{text}`").cast("string").alias("text"))


def extract(pages: DataFrame, tree: Tree | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: page_id, url, the main text (blocks joined by an empty line; empty if there is none) and its code points.

    A scan, page by page, of whole pages. Null and empty pages have no text; rows without an id or address are returned as
    they are, repeated rows as often as they come. Other columns are not read. Without any container the word counts and
    link densities decide, so plain text is the article.
    """
    held = pages.sparkSession.sparkContext.broadcast(tree or train())

    def work(batch):
        texts = ["\n\n".join(b.text for b, m in zip(p, main.tolist(), strict=True) if m) for p, main in _judged(batch.column("text"), held.value)]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return over_texts(_columns(pages, key, url, page), work, "page_id long, url string, text string, n_chars long")


BLOCKS = "page_id long, block int, text string, words int, link_density double, shell boolean, main boolean"


def block_table(pages: DataFrame, tree: Tree | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Every block of every page with its figures and the tree's answer, to look into or to label for a tree of one's own."""
    held = pages.sparkSession.sparkContext.broadcast(tree or train())

    def work(batch):
        rows = []
        for i, (own, main) in zip(batch.column("page_id").to_pylist(), _judged(batch.column("text"), held.value), strict=True):
            rows += [(i, n, b.text, b.words, b.linked / b.words, b.shell, m) for n, (b, m) in enumerate(zip(own, main.tolist(), strict=True))]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return dict(zip(("page_id", "block", "text", "words", "link_density", "shell", "main"), map(list, columns), strict=True))

    return over_texts(_columns(pages, key, url, page), work, BLOCKS)
