"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features of a block and its neighbours.

A page is cut at block-level tags. Each block has its word count and the share of its words in links, the same of the
blocks before and after it, the frame it stands in (article, page furniture or neither) and whether it is a heading. The
tree is grown on the labelled blocks of ``block_labels.csv``; it decides each block by itself. Pages are rows, so nothing
is shuffled.
"""

from __future__ import annotations

import csv
import html
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.shared import raw_text, reach_workers

LABELS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "block_labels.csv")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "frame", "heading")
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()),
                   ("n_blocks", pa.int64()), ("n_kept", pa.int64())])
PAGES_DDL = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

# Element names of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea noscript iframe noframes xmp template svg math canvas object audio video select datalist".split())
RAW = frozenset("script style title textarea iframe noframes xmp noscript".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr output q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr meter progress picture source link meta param""".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
ARTICLE = frozenset(["article", "main"])
FURNITURE = frozenset("nav footer aside menu dialog button fieldset legend form".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# Words of class, id and role that name page furniture or the article.
NAMED_FURNITURE = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead nav navbar navigation menu
breadcrumb breadcrumbs sidebar aside rail widget footer foot header topbar toolbar cookie cookies consent gdpr notice alert warning popup
modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment
comments disqus reply replies respond discussion reactions pagination pager tags copyright disclaimer search complementary contentinfo form
skip skiplink""".split())
NAMED_ARTICLE = frozenset("article content post entry story main maincontent bodytext articlebody text".split())
REMARKS = frozenset("comment comments disqus reply replies respond discussion reactions".split())
NOT_ITSELF = frozenset("has with no without is".split())  # has-sidebar: not a sidebar

NAME = r"[a-zA-Z][^\s/>]*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)({NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
PLAIN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)({NAME})([^>]*+)(?:>|\Z)", re.S)
OPENING = re.compile(r"<[a-zA-Z/!?]")
NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    words: int
    links: float
    frame: int
    heading: int


@dataclass
class State:
    """What an open element passes on: frame 1 article, -1 furniture, 0 neither; fixed: no element inside changes it."""

    name: str
    frame: int = 0
    fixed: bool = False
    seen: bool = True
    heading: int = 0


@dataclass
class Page:
    """Open elements and the block that is being read."""

    stack: list[State] = field(default_factory=lambda: [State("")])
    opened: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if raw and self.stack[-1].seen:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.in_link:
                self.linked += len(plain.split())

    def close_block(self) -> None:
        words = "".join(self.parts).split()
        if words:
            top = self.stack[-1]
            self.blocks.append(Block(" ".join(words), len(words), min(1.0, self.linked / len(words)), top.frame, top.heading))
        self.parts.clear()
        self.linked = 0

    def pop(self) -> State:
        gone = self.stack.pop()
        self.opened[gone.name] -= 1
        return gone

    def pop_to(self, names: tuple[str, ...], limits: set[str]) -> None:
        """Close the nearest open element of these names, unless one of the limits stands before it."""
        if not any(self.opened[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].name in limits:
                return

    def open(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = 1
        if name in ("br", "hr", "wbr") or name in VOID:
            if name == "br":
                self.parts.append(" ")
            elif name == "hr":
                self.close_block()
            return
        block = name not in INLINE
        if block:
            self.close_block()
            self.pop_to(("p",), set())
            if name in ITEMS:
                self.pop_to(SAME.get(name, (name,)), ITEMS[name])
        self.stack.append(state_of(name, attributes, self.stack[-1], bool(self.opened["article"] or self.opened["main"])))
        self.opened[name] += 1

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        if name in VOID:
            return
        if name not in INLINE:
            self.close_block()
        self.pop_to((name,), set() if name not in INLINE else {"p", "div", "td", "li", "article", "section"})


def names_in(attributes: str) -> set[str]:
    """Lower-case words of class, id and role."""
    out = set()
    for found in NAMING.findall(attributes):
        for token in "".join(found).split():
            parts = [p.lower() for p in PART.findall(token)]
            if parts and parts[0] not in NOT_ITSELF:
                out.update(parts)
    return out


def state_of(name: str, attributes: str, above: State, in_article: bool) -> State:
    """State of an element: furniture and comments hold for all that is inside, a form only until an article opens in it."""
    out = State(name, above.frame, above.fixed, above.seen and name not in UNSEEN, above.heading or int(name in HEADINGS))
    if not out.seen or (attributes and HIDDEN.search(attributes)):
        out.seen = False
        return out
    if above.fixed or name in ("html", "body"):
        return out
    named = names_in(attributes) if "=" in attributes else set()
    if named & REMARKS:
        out.frame, out.fixed = -1, True
    elif name in ARTICLE:
        out.frame = 1
    elif name == "form":
        out.frame = -1
    elif name in FURNITURE or (name == "header" and not in_article):
        out.frame, out.fixed = -1, True
    elif named & NAMED_FURNITURE - ({"header"} if in_article or named & NAMED_ARTICLE else set()):
        out.frame, out.fixed = -1, True
    elif named & NAMED_ARTICLE and above.frame < 1:
        out.frame = 1
    return out


def blocks_of(source: str) -> list[Block]:
    """Flat blocks of a page in order. Comments, scripts, styles and hidden elements hold none; an unfinished tag ends the page."""
    page, at, rule = Page(), 0, TOKEN
    while True:
        start = OPENING.search(source, at)
        if start is None:
            page.text(source[at:])
            break
        page.text(source[at:start.start()])
        found = rule.match(source, start.start())
        if found is None and rule is TOKEN and not source.startswith("</", start.start()):
            rule = PLAIN  # a quote that is never closed: tags end at the next bracket from here on
            found = rule.match(source, start.start())
        if found is None:
            found = PLAIN.match(source, start.start())
        if found is None:  # such as </3
            page.text(source[start.start():start.end()])
            at = start.end()
            continue
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            page.close(name)
        elif name in RAW:
            end = END_OF[name].search(source, at)
            at = end.start() if end else len(source)
        else:
            page.open(name, found[3])
    page.close_block()
    return page.blocks


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; beyond the page's ends stand blocks without words."""
    own = np.array([(b.words, b.links, b.frame, b.heading) for b in blocks], dtype=np.float64).reshape(-1, 4)
    padded = np.vstack([np.zeros((1, 4)), own, np.zeros((1, 4))])
    return np.hstack([own[:, :2], padded[:-2, :2], padded[2:, :2], own[:, 2:]])


@dataclass
class Tree:
    """Node k sends a row with feature[k] <= threshold[k] to left[k], else to right[k]; feature -1: a leaf of that label."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=np.int64)
        while (inner := self.feature[node] >= 0).any():
            at = node[inner]
            low = rows[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(low, self.left[at], self.right[at])
        return self.label[node]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10, least: int = 1) -> Tree:
    """A classification tree by least Gini impurity; thresholds lie midway, ties go to the first feature and value."""
    nodes: list[list] = []

    def add(own: np.ndarray, level: int) -> int:
        k, y = len(nodes), labels[own]
        nodes.append([-1, 0.0, 0, 0, int(2 * y.sum() >= len(y))])
        if level == depth or y.min() == y.max():
            return k
        best = None
        for j in range(rows.shape[1]):
            order = np.argsort(rows[own, j], kind="stable")
            x, ones = rows[own, j][order], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = np.flatnonzero((x[1:] > x[:-1]) & (n >= least) & (len(y) - n >= least))
            if len(cut):
                a, b = n[cut], len(y) - n[cut]
                p, q = ones[cut] / a, (ones[-1] - ones[cut]) / b
                cost = a * p * (1 - p) + b * q * (1 - q)
                i = int(np.argmin(cost))
                if best is None or cost[i] < best[0] - 1e-12:
                    best = (cost[i], j, (x[cut[i]] + x[cut[i] + 1]) / 2)
        if best is None:
            return k
        low = rows[own, best[1]] <= best[2]
        nodes[k][:2] = best[1:]
        nodes[k][2] = add(own[low], level + 1)
        nodes[k][3] = add(own[~low], level + 1)
        return k

    add(np.arange(len(labels)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes)))


def labelled_blocks(path: str = LABELS) -> tuple[np.ndarray, np.ndarray]:
    with open(path, newline="", encoding="utf-8") as file:
        rows = list(csv.DictReader(file))
    return np.array([[float(r[f]) for f in FEATURES] for r in rows]), np.array([int(r["content"]) for r in rows])


def extract(source: str, tree: Tree) -> tuple[str, int, int]:
    """(text, blocks, kept blocks) of a page."""
    blocks = blocks_of(source)
    if not blocks:
        return "", 0, 0
    kept = [b.text for b, good in zip(blocks, tree.predict(features_of(blocks))) if good]
    return " ".join(kept), len(blocks), len(kept)


def main_text(pages: DataFrame, labels: str = LABELS) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_kept, one row per row of ``pages``.

    Null and empty pages have the empty text. Null ids and urls stay null, repeated rows repeated. Pages of any length are
    read whole. Columns other than page_id, url and html are ignored. An empty table gives no rows.
    """
    reach_workers(pages.sparkSession)
    tree = grow(*labelled_blocks(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.decode("utf-8", "replace"), tree) for x in batch.column(2).to_pylist()]
            text, blocks, kept = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()),
                                              pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())], schema=PAGES)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw_text("html").alias("html"))
    return rows.mapInArrow(run, PAGES_DDL)
