"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word
count and link density, those of the blocks before and after it, whether it
stands in an element that names itself page furniture (a whole class, id or role
of such words, not a word in another name), and whether it is in the page's
article. A decision tree, grown here on a small labelled table of such
descriptions, says which blocks are main text.

Defined results: null, empty and text-free pages have an empty text; markup is
read leniently to the end whatever is left open; nulls in other columns stay;
repeated rows are extracted as often as they stand there; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, ready

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea title iframe object svg canvas select option datalist audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mfrac mi mn mo mrow msqrt msub msubsup msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("aside button dialog fieldset footer form head legend menu nav label".split())
ARTICLE = frozenset("article main".split())
#: Words in a class, an id or a role that name page furniture.
NAMES = frozenset(
    "ad ads adslot advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr hidden login masthead menu menubar modal nav navbar navigation navigational newsletter notice notification pager pagination paywall popup promo promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Words that such a name can also have; any other word makes it a name of its own ("share-price", "has-sidebar").
BESIDE = frozenset(
    "above area article articles bar below block blog body bottom box button buttons card center col column container content count desktop fixed float floating form foot footer global group head header heading holder icon icons id inline inner item items js large layer left level link links list main message mini mobile module new number outer overlay page panel post posts primary reader right row secondary section site slot small static sticky story text the title toggle top unit user users view vertical wp wrap wrapper zone".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool


def _names_furniture(attributes: str, in_article: bool) -> bool:
    for name, *values in _NAMED.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = {p.lower() for p in _PART.findall(token)}
                if (parts & NAMES or not in_article and "header" in parts) and parts <= NAMES | BESIDE:
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    # Open elements: (name, furniture, article, link); what is inside inherits.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    opened: dict[str, int] = {}

    def close_block() -> None:
        nonlocal linked
        if pieces:
            words = " ".join(entities.unescape("".join(pieces)).split())
            if words:
                _, furniture, article, _ = stack[-1]
                out.append(Block(words, words.count(" ") + 1, linked, furniture, article))
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if stack[-1][3]:
                linked += len(text.split())

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            if tag[0].startswith("<![CDATA["):
                say(entities.escape(tag[0][9:].removesuffix("]]>")))
            continue
        name = tag[2].lower()
        if tag[1]:
            if not opened.get(name):
                if name not in INLINE:
                    close_block()
                continue
            depth = len(stack) - 1
            while stack[depth][0] != name:
                depth -= 1
            inner, outer = stack[-1], stack[depth - 1]
            if name not in INLINE or inner[1] != outer[1]:
                close_block()
            for gone, *_ in stack[depth:]:
                opened[gone] -= 1
            del stack[depth:]
            continue
        if name in SKIPPED:
            if name not in INLINE:
                close_block()
            if not tag[3].endswith("/"):
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = closing.end() if closing else end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                close_block()
            continue
        _, furniture, article, link = stack[-1]
        inside = article or name in ARTICLE
        own = furniture or name in FURNITURE or name == "header" and not article or bool(tag[3]) and _names_furniture(tag[3], inside)
        if name == "main" and not article:
            own = bool(tag[3]) and _names_furniture(tag[3], inside)  # it is the main text whatever the elements around it are called
        elif name == "html":
            own = furniture
        elif name == "body":
            own = bool(tag[3]) and bool(re.search(r"\shidden(?=[\s/>=]|$)", tag[3], re.I))
            while len(stack) > 1 and stack[-1][0] != "html":
                opened[stack.pop()[0]] -= 1
        if name not in INLINE or own != furniture:
            close_block()
        if name == "p" and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
            opened[stack.pop()[0]] -= 1
        stack.append((name, own, inside, link or name == "a"))
        opened[name] = opened.get(name, 0) + 1
    close_block()
    return out


#: The labelled table. Columns: words, link density in hundredths, the same of the block before and of the block
#: after, furniture (1: stands in page furniture), article (2: inside the article, 1: the page marks none, 0: outside), and
#: the label (1: main text). Counts of 0 beside a density of 0 mean no such block.
LABELLED = """
   9   0    4   0  60   0  0 2  1
   3   0    1 100  40   0  0 2  1
   1   0   40   0  35   0  0 2  1
   1   0    1   0   1   0  0 2  1
   2   0    2   0   3   0  0 2  1
   1   0    0   0   0   0  0 2  1
   2   0   12   0   1 100  0 2  1
  45   0    9   0  50   0  0 2  1
 120   4   45   0  70   0  0 2  1
 300   1  120   0   8   0  0 2  1
  35  20   50   0  60   5  0 2  1
  18  33   40   0  30   0  0 2  1
  60   0    0   0   0   0  0 2  1
   5 100   60   0   6 100  0 2  0
   1 100   40   0   1 100  0 2  0
   6  50   40   0  50   0  0 2  1
   8  63   70   0   9 100  0 2  1
  20  80   60   0   4 100  0 2  1
  10  90   30   0  40   0  0 2  1
  30  45    5   0   0   0  0 2  1
   8 100   70   0   9 100  0 2  0
   3 100    0   0   0   0  0 2  0
  12 100   30   0  25   0  0 2  1
   2 100   50   0  70   0  0 2  1
   6 100   40   0   9   0  0 2  1
   8 100    5   0   4   0  0 2  1
   8 100   60   0  60   0  0 2  1
   5 100   20   0  15   0  0 2  1
  25 100   50   0  40   0  0 2  1
   4 100    0   0  60   0  0 2  1
   2 100    9   0  12   0  0 2  1
   3 100   40   0   0   0  0 2  0
   4 100   30   0   3 100  0 2  0
   2 100    3 100  30   0  0 2  0
   7   0   60   0   2 100  1 2  0
  40   0   60   0  20   0  1 2  0
 150   0   90   0  10   0  1 2  0
   1   0    1   0   1   0  1 2  0
   5   0    1 100   1 100  1 0  0
   1 100    1 100   1 100  1 0  0
  30   0    5   0  60   0  1 0  0
  80   2    4 100   9   0  1 0  0
   8  25   90   0   0   0  1 0  0
   1 100    0   0   1 100  1 0  0
  60   0   60   0  60   0  1 0  0
   4   0    3 100  60   0  0 0  0
  25   0    2 100   9   0  0 0  0
  90   0   10   0   5   0  0 0  0
   6 100    6 100   6 100  0 0  0
   2   0    0   0  40   0  0 0  0
  15  40   30   0   2   0  0 0  0
   1 100    1 100   1 100  1 1  0
  10   0    1 100  70   0  1 1  0
  70   0   80   0  90   0  1 1  0
   8  20   90   0   0   0  1 1  0
   7   0    3 100  60   0  0 1  1
   5   0    2 100  20   0  0 1  1
   3   0    1 100  18   0  0 1  1
   4   0    2   0  22   0  0 1  1
   8   0    3   0 200   0  0 1  1
   4   0   45   0  50   0  0 1  1
   2   0   60   0  70   0  0 1  1
   3   0   50   0   4   0  0 1  1
   5   0    4   0  60   0  0 1  1
   2   0    3   0   2   0  0 1  1
   1   0    1   0   1   0  0 1  1
   6   0    0   0   9   0  0 1  1
   8   0    0   0  30   0  0 1  1
   9   0    5   0   8   0  0 1  1
  12   0    9 100 120   2  0 1  1
  12   0   40   0   1 100  0 1  1
  14   0   16   0  13   0  0 1  1
  11   0   30   0  14   0  0 1  1
  13   0    2 100   3 100  0 1  1
  16   6   30   0   2 100  0 1  1
  20   0    0   0   0   0  0 1  1
  25  10   60   0  30   0  0 1  1
  25  12   60   0   4 100  0 1  1
  30   0    3 100   1 100  0 1  1
  30   0    0   0   2 100  0 1  1
  45   0   80   0   6 100  0 1  1
  45   3   20   0   2 100  0 1  1
  60   0    7   0  80   0  0 1  1
  60   0   10   0   0   0  0 1  1
  80   3   60   0  45   0  0 1  1
  90   0    0   0   5 100  0 1  1
 150   8    2 100   3   0  0 1  1
 200   0    0   0   0   0  0 1  1
 300   1    1 100   1 100  0 1  1
   3 100    2 100   2 100  0 1  0
   1 100    0   0   1 100  0 1  0
   9  90    4 100   7 100  0 1  0
  20  80   60   0   4 100  0 1  0
  40  75   60   0  30   0  0 1  0
   6 100   60   0  50   0  0 1  0
  12 100   30   0   9   0  0 1  0
   2   0    3 100   2 100  0 1  0
   4   0    1 100   5 100  0 1  0
   3   0    2   0   4 100  0 1  0
   2   0   60   0   4 100  0 1  0
   1   0   20   0   3 100  0 1  0
   3   0    4 100   3 100  0 1  0
   5   0   25   0   9 100  0 1  0
   6   0   40   0   2 100  0 1  0
   1   0    5   0   1 100  0 1  0
   6  50    4 100   3   0  0 1  0
   4  50    2 100  30   0  0 1  0
"""
FEATURES = 8


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([list(map(float, x.split())) for x in LABELLED.strip().splitlines()])
    return rows[:, :FEATURES], rows[:, FEATURES] > 0


class Tree(NamedTuple):
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    share: list[float]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        feature, cut, left, right, share = map(np.array, self)
        at = np.zeros(len(rows), int)
        while (open_ := np.flatnonzero(feature[at] >= 0)).size:
            n = at[open_]
            at[open_] = np.where(rows[open_, feature[n]] <= cut[n], left[n], right[n])
        return share[at] >= 0.5


def grow(rows: np.ndarray, label: np.ndarray, depth: int = 8) -> Tree:
    """A binary tree by Gini impurity; ties go to the earlier feature and the lower cut."""
    tree = Tree([], [], [], [], [])

    def node(own: np.ndarray, left: int) -> int:
        me, y = len(tree.feature), label[own]
        for column, value in zip(tree, (-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0), strict=True):
            column.append(value)
        best = None
        if left and 0 < y.sum() < len(y):
            for f in range(rows.shape[1]):
                values = np.unique(rows[own, f])
                for low, high in zip(values, values[1:], strict=False):
                    side = rows[own, f] <= (low + high) / 2
                    impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (side, ~side))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(low + high) / 2, side)
        if best:
            tree.feature[me], tree.cut[me] = best[1], best[2]
            tree.left[me], tree.right[me] = node(own[best[3]], left - 1), node(own[~best[3]], left - 1)
        return me

    node(np.arange(len(rows)), depth)
    return tree


def described(blocks: list[Block]) -> np.ndarray:
    marked = any(b.article and not b.furniture for b in blocks)
    own = np.array([[b.words, 100.0 * min(1.0, b.linked / b.words)] for b in blocks]).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    place = np.array([[b.furniture, 2 if b.article else 0 if marked else 1] for b in blocks], float).reshape(-1, 2)
    return np.concatenate([own, before, after, place], 1)


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    every = [blocks_of(p) if p else [] for p in pages]
    rows = np.concatenate([described(b) for b in every if b] or [np.zeros((0, FEATURES))])
    good, at, out = tree.predict(rows), 0, []
    for blocks in every:
        out.append("\n".join(b.text for b, g in zip(blocks, good[at : at + len(blocks)], strict=True) if g))
        at += len(blocks)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    ready(pages.sparkSession)
    tree = grow(*labelled())

    def run(batches):
        claim("html_text")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), tree)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
