"""Main text of HTML pages: flat text blocks judged by a small decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described by its
word count and link density, by those of its neighbours, and by where it stands (inside
an article or main element, inside boilerplate markup, heading).  A decision
tree, grown from the labelled table below, says which blocks are main text.

Scripts, styles, comments in markup and other unseen elements are no text.  Character
references are decoded, white space inside a block becomes one space, and kept blocks
are joined by a line feed in page order.

Null, empty and textless pages give an empty text.  Unclosed and misnested tags are
closed as browsers would: at the end of what encloses them.  Repeated rows are treated
alike; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import read
from llm.registry import query

COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article", "heading")

#: Labelled blocks: COLUMNS, then 1 for main text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0),
    (7, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (40, 0.0, 30, 0.0, 12, 0.0, 1, 0, 0, 0),
    (25, 0.1, 60, 0.0, 20, 0.1, 1, 1, 0, 0), (9, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0), (5, 0.4, 120, 0.0, 0, 0.0, 1, 0, 0, 0),
    (60, 0.0, 40, 0.0, 55, 0.0, 1, 0, 0, 0), (3, 0.0, 50, 0.0, 2, 1.0, 1, 1, 1, 0), (90, 0.02, 70, 0.0, 10, 0.0, 1, 1, 0, 0),
    (8, 0.0, 9, 0.0, 20, 0.0, 0, 1, 1, 1), (3, 0.0, 1, 1.0, 80, 0.0, 0, 1, 1, 1), (11, 0.0, 7, 0.0, 1, 0.0, 0, 1, 1, 1),
    (120, 0.0, 9, 0.0, 80, 0.0, 0, 1, 0, 1), (20, 0.0, 90, 0.0, 60, 0.0, 0, 1, 0, 1), (1, 0.0, 50, 0.0, 70, 0.0, 0, 1, 0, 1),
    (5, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 1), (2, 0.0, 40, 0.0, 10, 0.4, 0, 1, 0, 1), (70, 0.1, 60, 0.0, 40, 0.0, 0, 1, 0, 1),
    (45, 0.3, 20, 0.0, 80, 0.1, 0, 1, 0, 1), (14, 0.5, 30, 0.1, 60, 0.0, 0, 1, 0, 1), (30, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 1),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1), (6, 0.3, 5, 0.0, 90, 0.0, 0, 1, 0, 1), (150, 0.02, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (3, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0, 0), (5, 1.0, 5, 1.0, 4, 1.0, 0, 1, 0, 0), (8, 0.95, 7, 1.0, 6, 0.9, 0, 1, 0, 0),
    (2, 1.0, 90, 0.0, 9, 0.0, 0, 1, 0, 0), (10, 0.9, 70, 0.0, 9, 0.95, 0, 1, 0, 0),
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (40, 0.0, 8, 0.0, 90, 0.0, 0, 0, 0, 1), (35, 0.1, 50, 0.0, 5, 0.4, 0, 0, 0, 1),
    (25, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1), (18, 0.0, 45, 0.0, 80, 0.0, 0, 0, 0, 1), (120, 0.2, 5, 1.0, 60, 0.0, 0, 0, 0, 1),
    (6, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0, 1), (4, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (9, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1, 1),
    (5, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (55, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (4, 0.8, 90, 0.0, 3, 1.0, 0, 0, 0, 0),
    (12, 0.9, 10, 1.0, 15, 0.8, 0, 0, 0, 0), (30, 0.9, 8, 1.0, 6, 1.0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.2, 3, 1.0, 2, 0.9, 0, 0, 0, 0), (8, 0.0, 4, 0.5, 4, 0.0, 0, 0, 0, 0), (4, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0),
    (7, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 80, 0.0, 2, 0.0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 4, 0.6, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0), (2, 0.0, 30, 0.5, 4, 1.0, 0, 0, 1, 0),
)


class Tree:
    """Decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.leaf = float(y.mean() >= 0.5)
        self.column = -1
        best = len(y) * y.mean() * (1 - y.mean())
        for column in range(x.shape[1]):
            values = np.unique(x[:, column])
            for at in (values[1:] + values[:-1]) / 2:
                left = x[:, column] < at
                impurity = sum(part.sum() * (1 - part.mean()) for part in (y[left], y[~left]))
                if impurity < best - 1e-9:
                    best, self.column, self.at = impurity, column, float(at)
        if self.column >= 0:
            left = x[:, self.column] < self.at
            self.sides = Tree(x[~left], y[~left]), Tree(x[left], y[left])

    def predict(self, row: tuple) -> float:
        while self.column >= 0:
            self = self.sides[int(row[self.column] < self.at)]  # noqa: PLW0642
        return self.leaf


#: Neighbours (words and links before, words and links after) among which a block with telling markup keeps its label.
NEIGHBOURS = ((0, 0.0, 0, 0.0), (1, 1.0, 1, 1.0), (8, 0.0, 60, 0.0), (60, 0.0, 5, 0.0), (90, 0.0, 80, 0.0), (3, 1.0, 50, 0.0), (40, 0.1, 2, 1.0), (5, 0.0, 4, 0.3))


def labelled_table() -> np.ndarray:
    """The labelled blocks; those whose markup decides are repeated with every kind of neighbour."""
    rows = list(LABELLED)
    for words, links, *_, boiler, article, heading, label in LABELLED:
        if boiler or article:
            rows += [(words, links, *around, boiler, article, heading, label) for around in NEIGHBOURS]
    return np.array(rows, float)


def grown_tree() -> Tree:
    table = labelled_table()
    return Tree(table[:, :-1], table[:, -1])


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=[^a-zA-Z/!?])|<|[^<]+", re.S)
ATTRIBUTES = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNSEEN = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template textarea select button iframe svg object canvas title option".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup sidebar widget menu nav navbar navigation navigator breadcrumb breadcrumbs share sharing social related recommended "
    "comment comments respond reply replies disqus footer masthead copyright legal disclaimer login search pagination pager toolbar".split()
)
BOILER_WHOLE = {"header", "site-header", "page-header", "top-header"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
SPLIT_NAMES = re.compile(r"[^a-z]+")
BODY = {"html", "body", "article", "main"}


def is_boiler(tag: str, attributes: str) -> bool:
    """Markup that says: not main text."""
    if tag in BOILER_TAGS:
        return True
    if not attributes or tag in BODY:
        return False
    for name, *values in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            if value.strip() in BOILER_WHOLE or BOILER_NAMES.intersection(SPLIT_NAMES.split(value)):
                return True
        elif (name == "role" and value in BOILER_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def flat_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, boiler, article, heading) of every flat block with text."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # tag, boiler, article
    in_link = False
    position, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                boiler, article = stack[-1][1:] if stack else (False, False)
                words = text.count(" ") + 1
                heading = any(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" for tag, *_ in stack[-2:])
                out.append((text, words, min(1.0, linked / words), int(boiler), int(article), int(heading)))
        parts, linked = [], 0

    while position < n:
        m = TOKEN.match(page, position)
        position = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<":
                parts.append(piece)
                if in_link:
                    linked += len(html.unescape(piece).split())
            elif piece == "<":
                parts.append(piece)
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in UNSEEN:
            if tag not in ("select", "option", "button", "textarea", "svg") or closing:
                flush() if tag in ("script", "style", "title") else None
            if not closing and not m[3].endswith("/"):
                end = UNSEEN[tag].search(page, position)
                position = end.end() if end else n
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if not closing and tag not in VOID and is_boiler(tag, m[3]):
                flush()
                stack.append((tag, True, stack[-1][2] if stack else False))
            elif closing and any(t == tag for t, *_ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            in_link = False
            if any(t == tag for t, *_ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option"):  # closed by the next of its kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    break
        elif stack and stack[-1][0] == "p":  # a block ends a paragraph
            stack.pop()
        boiler, article = stack[-1][1:] if stack else (False, False)
        if not m[3].endswith("/"):
            stack.append((tag, boiler or is_boiler(tag, m[3]), article or tag in ("article", "main")))
    flush()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    """Kept blocks joined by line feeds."""
    blocks = flat_blocks(page or "")
    kept = []
    for i, (text, words, links, boiler, article, heading) in enumerate(blocks):
        before = blocks[i - 1][1:3] if i else (0, 0.0)
        after = blocks[i + 1][1:3] if i + 1 < len(blocks) else (0, 0.0)
        if tree.predict((words, links, *before, *after, boiler, article, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the HTML, with ``text`` and ``n_chars``."""
    plain = pages.drop("text", "n_chars").select(html_col, *[c for c in pages.columns if c not in (html_col, "text", "n_chars")])
    rest = plain.schema.fields[1:]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grown_tree()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(page, tree) for page in part.column(0).to_pylist()]
                columns = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "text string", "n_chars bigint"])
    return plain.mapInArrow(run, schema)


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
