"""Main text of web pages by sum-product on the DOM tree.

A page becomes a tree of elements and text runs. Every node is content or not; the model is a hidden tree: the root is not
content, a child's state depends on its parent's by the child's kind (article, boilerplate by tag or by class and id words,
block, inline, text run), and a node's looks (length, sentence end and link of a text run; the kind of an element's name
words) depend on its state. Messages run upward from the leaves and downward again, which gives each text run's exact
marginal; runs above one half are the text.

Both tables are counted on labelled pages on top of fixed prior counts: pages with exactly one ``article`` or ``main``
element label themselves, its blocks outside boilerplate are content and all else is not. Training reads a bounded sample
(``TRAIN_PAGES`` pages of at most ``TRAIN_BYTES`` bytes, by a hash of the id); every whole page is extracted.

Text: character references decoded, white space inside a block one blank, trimmed, blocks joined by a line break. Scripts,
styles, titles and markup are never nodes; a tag cut off by the end of the page is dropped. Defined cases: null or empty html
gives an empty text; repeated rows give equal rows; without labelled pages the prior alone decides. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import tidy

TRAIN_PAGES = 500
TRAIN_BYTES = 65_536

# HTML element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style iframe textarea title".split())  # hold text up to their end tag, or to the page's end
_HIDDEN = frozenset("noscript template svg math object select".split())  # hold elements; without an end tag they hide nothing
_FOREIGN = frozenset("svg math".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot".split())
_SAME = {"li": "li", "option": "option", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd"}
_ARTICLE = frozenset(("article", "main"))
_SIDE = frozenset("nav header footer aside form menu button dialog fieldset".split())
# Name words of elements around the main text.
_SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_MAIN_WORDS = frozenset("article articlebody content entry main post story".split())

KINDS = ("article", "side", "block", "inline", "text")
#: Prior counts of (not content, content) children under a parent that is (not content, content).
_PRIOR_STEP = np.array([[[2, 38], [1, 39]], [[99, 1], [97, 3]], [[38, 2], [1, 39]], [[38, 2], [1, 39]], [[39, 1], [1, 39]]], float)
_LENGTHS = (10, 25, 50, 100, 200)
_LOOKS = 24 + 3
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I | re.A) for n in _RAW | _HIDDEN}
#: Elements that may hold HTML inside svg and math, and those that end svg and math anywhere else in them.
_HOLDERS = "foreignobject|desc|title|annotation-xml|mtext|mi|mo|mn|ms"
_BREAKS = "|".join(sorted(_BLOCKS)) + "|b|big|br|code|em|embed|head|i|img|listing|meta|nobr|ruby|s|small|span|strong|strike|sub|sup|tt|u|var"
_INSIDE = {
    n: re.compile(
        rf"<!--.*?(?:-->|\Z)|<(/?)(?:({n})|({_HOLDERS if n in _FOREIGN else '(?!)'})|({_BREAKS if n in _FOREIGN else '(?!)'}))(?=[\s/>])([^>]*)>",
        re.I | re.A | re.S,
    )
    for n in _HIDDEN
}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _prior_looks() -> np.ndarray:
    """Prior counts of looks by state: longer runs that end a sentence outside links lean to content."""
    out = np.ones((2, _LOOKS))
    for length in range(6):
        for ends in (0, 1):
            for linked in (0, 1):
                lean = 0.6 * (length - 2) + 0.8 * ends - 1.6 * linked
                out[1, length * 4 + ends * 2 + linked] = 4 / (1 + np.exp(-lean))
                out[0, length * 4 + ends * 2 + linked] = 4 / (1 + np.exp(lean))
    out[:, 24:] = [[6, 3, 1], [6, 0.2, 3]]  # plain, side words, main words
    return out


@dataclass
class Model:
    step: np.ndarray = field(default_factory=lambda: np.log(_PRIOR_STEP / _PRIOR_STEP.sum(-1, keepdims=True)))
    looks: np.ndarray = field(default_factory=lambda: np.log(_prior_looks() / _prior_looks().sum(1, keepdims=True)))


@dataclass
class Tree:
    """Nodes in page order: parent, kind, look; text of runs, and the block each run belongs to."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    look: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, parent: int, kind: int, look: int, name: str, text: str | None, block: int) -> int:
        for column, value in zip((self.parent, self.kind, self.look, self.name, self.text, self.block), (parent, kind, look, name, text, block)):
            column.append(value)
        return len(self.parent) - 1


def _words(attributes: str) -> set[str]:
    return {w for m in _NAMES.findall(attributes) for v in m if v for w in _SPLIT.split(v.lower())}


def _hidden_end(page: str, name: str, start: int) -> tuple[int, bool]:
    """Where a hidden element ends whose start tag ends at ``start``, and whether its tags are paired.

    Nested ones of its name are counted; where they do not come out even, it ends at the first end tag, and without one at
    ``start``.
    """
    depth, held, first = 1, 0, start
    for m in _INSIDE[name].finditer(page, start):
        if m[2]:
            depth += -1 if m[1] else not (name in _FOREIGN and m[5].endswith("/"))
            if m[1] and first == start:
                first = m.end()
            if not depth:
                return m.end(), True
        elif m[3]:
            held = max(0, held - 1) if m[1] else held + (not m[5].endswith("/"))
        elif m[4] and not m[1] and not held:
            return m.start(), True
    return first, False


def parse(page: str) -> Tree:
    """The tree of a page; tolerant of unclosed and stray tags."""
    tree = Tree()
    stack = [tree.add(-1, 2, 24, "#page", None, 0)]
    opened: dict[str, int] = {}
    block, at, links = 0, 0, 0
    odd: set[str] = set()  # hidden elements whose tags were found unpaired up to the page's end: not counted again
    gone: set[str] = set()  # those of them without a further end tag

    def close(name: str) -> None:
        nonlocal block, links
        while stack[1:]:
            top = tree.name[stack.pop()]
            opened[top] -= 1
            links -= top == "a"
            block += top in _BLOCKS
            if top == name:
                return

    def say(raw: str) -> None:
        words = " ".join(html.unescape(raw).split()) if raw else ""
        if not words:
            if raw and tree.text[-1] is not None and tree.block[-1] == block:
                tree.text[-1] += " "
            return
        size = sum(len(words) >= n for n in _LENGTHS)
        ends = words[-1] in ".!?:;…\"'»”"
        lead = " " if raw[0].isspace() else ""
        tail = " " if raw[-1].isspace() else ""
        tree.add(stack[-1], 4, size * 4 + ends * 2 + (links > 0), "#text", lead + words + tail, block)

    while m := _TAG.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if opened.get(name):
                close(name)
            elif name in _BLOCKS:
                block += 1
            continue
        attributes = m[3] or m[6] or ""
        if name == "head":  # nothing of its own: what stands in it is void or raw, all else belongs to the body
            continue
        if name in _RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _HIDDEN:
            if name in odd:
                end = _END[name].search(page, at) if name not in gone else None
                at = end.end() if end else at
                gone |= set() if end else {name}
            elif not attributes.endswith("/") or name not in _FOREIGN:
                at, paired = _hidden_end(page, name, at)
                if not paired:
                    odd.add(name)
            continue
        if name in _VOID:
            if name == "br" and tree.text[-1] is not None:
                tree.text[-1] += " "
            block += name == "hr"
            continue
        if name in _CLOSES_P and opened.get("p"):
            close("p")
        for twin in _SAME.get(name, "").split():
            if opened.get(twin) and tree.name[stack[-1]] == twin:
                close(twin)
        words = _words(attributes) if attributes else set()
        side = name in _SIDE or bool(words & _SIDE_WORDS)
        main = name in _ARTICLE or bool(words & _MAIN_WORDS)
        kind = 1 if side else 0 if name in _ARTICLE else 2 if name in _BLOCKS else 3
        if name in ("html", "body"):
            kind, side, main = 2, False, False
        block += name in _BLOCKS
        stack.append(tree.add(stack[-1], kind, 25 if side else 26 if main else 24, name, None, block))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
    if at < len(page):
        say(page[at:])
    return tree


def label(tree: Tree) -> list[int] | None:
    """States of all nodes of a page that labels itself, else None."""
    heads = [k for k, n in enumerate(tree.name) if n in _ARTICLE]
    heads = [k for k in heads if not any(tree.name[p] in _ARTICLE for p in _above(tree, k))]
    if len(heads) != 1:
        return None
    state = [0] * len(tree.parent)
    for k in range(1, len(state)):
        state[k] = int(k == heads[0] or (state[tree.parent[k]] and tree.kind[k] != 1))
    return state


def _above(tree: Tree, k: int) -> Iterator[int]:
    while tree.parent[k] >= 0:
        k = tree.parent[k]
        yield k


def fit(pages: list[str]) -> Model:
    step, prior = _PRIOR_STEP.copy(), _prior_looks()
    looks = np.zeros_like(prior)
    for n, page in enumerate(pages):
        tree = parse(page)
        state = label(tree)
        if state is None:
            continue
        if n % 2:  # every other page hides the name of its article, so that plain blocks can start one too
            for k, kind in enumerate(tree.kind):
                if kind == 0:
                    tree.kind[k], tree.look[k] = 2, 24
        for k in range(1, len(state)):
            step[tree.kind[k], state[tree.parent[k]], state[k]] += 1
            looks[state[k], tree.look[k]] += 1
    # Looks keep a tenth of the prior's weight however many pages were counted: labelled pages of one style must not
    # make a look of another style, such as a linked run inside an article, impossible.
    looks += prior * np.maximum(1.0, 0.1 * looks.sum(1) / prior.sum(1))[:, None]
    return Model(np.log(step / step.sum(-1, keepdims=True)), np.log(looks / looks.sum(1, keepdims=True)))


def marginals(tree: Tree, model: Model) -> list[float]:
    """Log-odds of content of every node: messages to the root, then back to the leaves."""
    from math import exp, log1p

    def plus(a: float, b: float) -> float:
        return (a + log1p(exp(b - a))) if a >= b else (b + log1p(exp(a - b)))

    step, looks = model.step.tolist(), model.looks.tolist()
    n = len(tree.parent)
    off, on = [looks[0][v] for v in tree.look], [looks[1][v] for v in tree.look]
    up0, up1 = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):  # children come after their parent
        s = step[tree.kind[k]]
        up0[k] = plus(s[0][0] + off[k], s[0][1] + on[k])
        up1[k] = plus(s[1][0] + off[k], s[1][1] + on[k])
        off[tree.parent[k]] += up0[k]
        on[tree.parent[k]] += up1[k]
    off[0], on[0] = off[0], float("-inf")  # the page itself is not content
    odds = [float("-inf")] * n
    for k in range(1, n):
        p, s = tree.parent[k], step[tree.kind[k]]
        out0, out1 = off[p] - up0[k], on[p] - up1[k]  # what the parent believes without this child
        down0 = plus(out0 + s[0][0], out1 + s[1][0])
        down1 = plus(out0 + s[0][1], out1 + s[1][1])
        off[k] += down0
        on[k] += down1
        odds[k] = on[k] - off[k]
    return odds


def extract(page: str, model: Model) -> str:
    if not page:
        return ""
    tree = parse(page)
    odds = marginals(tree, model)
    blocks: list[str] = []
    last = None
    for k, text in enumerate(tree.text):
        if text is None or odds[k] <= 0:
            continue
        if tree.block[k] == last:
            blocks[-1] += text
        else:
            blocks.append(text)
            last = tree.block[k]
    return "\n".join(b for b in (" ".join(t.split()) for t in blocks) if b)


def train(pages: DataFrame) -> Model:
    ids = (
        pages.filter(F.col("page_id").isNotNull() & (F.octet_length("html") <= TRAIN_BYTES)).select("page_id")
        .orderBy(F.xxhash64(F.lit("pages"), "page_id"), "page_id").limit(TRAIN_PAGES).distinct()
    )
    rows = (
        pages.select("page_id", "html").filter(F.octet_length("html") <= TRAIN_BYTES)
        .join(F.broadcast(ids), "page_id").select("html").distinct().limit(2 * TRAIN_PAGES).collect()
    )
    return fit(sorted(r["html"] for r in rows))


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                texts = [extract(p or "", model) for p in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
