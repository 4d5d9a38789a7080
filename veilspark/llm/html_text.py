"""Main text of web pages by scoring the tree.

A page becomes a tree of elements. Text between block borders is a paragraph; each paragraph
gives points for itself, its length and its commas to its parent, half of them to the
grandparent and less to those above. An element's points are discounted by the share of its text that
lies in links. The element with most points is the container; it widens to the article or main element
around it, else siblings that score like content, or are headings and paragraphs of it, are kept too.

Never part of a text: scripts, styles and other things that are not shown, and elements whose
tag or role marks them as menu, header, footer, sidebar, notice, advert, form or reader
comments. A header within an article is the article's own.

Words of classes and ids only put an element aside. It counts again if it holds the page's main element, or if
nothing but such elements has text. Headings and paragraphs are put aside by a class that is such a word as a whole,
never by their id; what follows ``with``, ``has``, ``no`` or ``without`` in a name says nothing about the element.

Defined results: null and empty pages, and pages without any paragraph, have an empty text; broken
markup is read as it comes: unclosed elements end with their parent, stray end tags are
ignored, a quote that never closes is a character of its tag, a lone ``<`` is text; of containers with equal points the
outer and earlier one is taken; equal rows get equal rows; other columns are not read. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements of HTML by how they are shown, roles, and words of class names.
NOT_SHOWN = frozenset(
    "head title script style noscript template svg math canvas iframe object embed audio video map select option datalist"
    " textarea button input label form nav footer aside dialog menu".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
PARAGRAPHS = HEADINGS | frozenset("p pre td th li dt dd blockquote".split())
#: Ancestors that a paragraph gives points to.
LEVELS = 8
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar masthead header footer copyright"
    " sidebar aside widget widgets related recommended recommendations share sharing social"
    " notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist respond replies disqus"
    " form search searchform hidden".split()
)
#: Words of a name that tell what an element goes with, not what it is.
BESIDE = frozenset("with has have no without and".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {
    "p": BLOCKS - {"body", "html"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|))*+)>|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAMES = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its blocks of text are ``(order, text, link characters)``."""

    __slots__ = ("tag", "parent", "children", "dropped", "aside", "block", "points", "chars", "linked", "blocks")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, aside: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.aside = tag, parent, dropped, aside
        self.children: list[Node] = []
        #: The nearest block, itself included.
        self.block: Node = self if parent is None or tag in BLOCKS or tag in ENDS else parent.block
        self.blocks: list[tuple[int, str, int]] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        if parent is not None:
            parent.children.append(self)


def _marked(tag: str, attributes: str, within_content: bool) -> tuple[bool, bool]:
    """Whether an element is not shown or no part of the article by tag and role, and whether its names put it aside."""
    if tag in NOT_SHOWN or (tag == "header" and not within_content):
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    plain, aside = tag in PARAGRAPHS, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and _UNSEEN.search(value):
            return True, False
        if name == "class" or name == "id" and not plain:
            aside = aside or any(_names_other(one, plain) for one in value.split())
    hidden = bool(_HIDDEN.search(_QUOTED.sub("", attributes)))
    return hidden, aside and tag != "header"


def _names_other(name: str, whole: bool) -> bool:
    """Whether a class or id names something beside the article; ``whole``: only as one word."""
    if whole:
        return name in UNWANTED
    parts = _NAMES.split(name)
    for i, part in enumerate(parts):
        if part in BESIDE:
            parts = parts[:i]
            break
    return bool(parts) and (parts[0] in UNWANTED or parts[-1] in UNWANTED)


def tree(page: str) -> Node:
    """Elements of a page with their paragraphs; what is not shown has none."""
    root = here = Node("", None, False)
    parts: list[tuple[str, bool]] = []  # of the open paragraph: text, and whether it is in a link
    order, links, content = 0, 0, 0
    at, n, last = 0, len(page), page.rfind(">")
    opened: dict[str, int] = {}

    def leave(node: Node) -> None:
        """Ends ``node`` and all that is open in it."""
        nonlocal here, links, content
        while here is not node.parent:
            links -= here.tag == "a"
            content -= here.tag in CONTENT
            opened[here.tag] -= 1
            here = here.parent

    def close() -> None:
        nonlocal order
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join([t for t, _ in parts]))).strip()
            if text and not here.dropped:
                linked = sum(len(t) for t, inside in parts if inside)
                here.block.blocks.append((order, text, min(linked, len(text))))
                order += 1
            parts.clear()

    while at < n:
        if at > last and not page.startswith(("<!", "<?"), at):  # no tag ends any more: brackets are text
            end = min([i for i in (page.find("<!", at), page.find("<?", at)) if i >= 0], default=n)
            if not here.dropped:
                parts.append((page[at:end], links > 0))
            at = end
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m.group(4)
        if text:
            if not here.dropped:
                parts.append((text, links > 0))
            continue
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if not opened.get(tag):  # nothing to end
                if tag in BLOCKS:
                    close()
                continue
            node = here
            while node.tag != tag:
                node = node.parent
            if tag in BLOCKS or _holds_block(here, node):
                close()
            leave(node)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not here.dropped:
                parts.append((" ", links > 0))
            continue
        if tag in BLOCKS:
            close()
        node = here.block  # what this one ends
        while node.parent is not None and tag not in ENDS.get(node.tag, ()) and node.tag in ("tbody", "thead", "tfoot"):
            node = node.parent.block
        if node.parent is not None and tag in ENDS.get(node.tag, ()):
            close()
            leave(node)
        if tag in VOID:
            continue
        attributes = m.group(3)
        if attributes.rstrip().endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        never, aside = (True, False) if here.dropped else _marked(tag, attributes, content > 0)
        here = Node(tag, here, never, aside)
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        content += tag in CONTENT
    close()
    return root


def _holds_block(node: Node, top: Node) -> bool:
    while node is not top:
        if node.tag in BLOCKS:
            return True
        node = node.parent
    return False


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(reversed(node.children))
    return nodes


def _settle(nodes: list[Node]) -> None:
    """Decides about elements that are put aside; ``nodes`` have parents before children."""
    if not any(node.aside for node in nodes):
        return
    holds = {id(node) for node in nodes if node.tag == "main" and not node.dropped}
    for node in reversed(nodes):
        if id(node) in holds and node.parent is not None:
            holds.add(id(node.parent))
    for node in nodes:
        if id(node) in holds:
            node.aside = False
        elif node.parent is not None and node.parent.aside:
            node.aside = True
    if not any(node.blocks and not node.aside for node in nodes):
        return
    for node in nodes:
        if node.aside:
            node.dropped = True
            node.blocks.clear()


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by empty lines."""
    if not page:
        return ""
    root = tree(page)
    nodes = _walk(root)
    _settle(nodes)
    for node in nodes:
        for _, text, linked in node.blocks:
            own = 0.5 if node.tag in HEADINGS else 1.0 + text.count(",") + min(len(text) / 100, 3.0)
            up = node.parent if node.tag in PARAGRAPHS else node
            level = 0
            while up is not None and level < LEVELS:
                up.points += own * (1.0 if level == 0 else 0.5 if level == 1 else 1.0 / (3 * level))
                up, level = up.parent, level + 1
            node.chars += len(text)
            node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    best = max(nodes, key=lambda x: x.points * (1 - _density(x)))
    if not best.chars:
        return ""
    wide = best
    while wide is not None and wide.tag not in CONTENT:
        wide = wide.parent
    kept = [wide or best]
    if wide is None and best.parent is not None:
        least = max(1.0, 0.2 * best.points * (1 - _density(best)))
        for other in best.parent.children:
            if other is best or other.dropped:
                continue
            alike = other.points * (1 - _density(other)) >= least
            plain = other.tag in HEADINGS or other.tag in ("p", "blockquote", "pre")
            if other.chars and _density(other) < 0.5 and (alike or plain):
                kept.append(other)
    blocks = [b for top in kept for node in _walk(top) for b in node.blocks]
    return "\n\n".join(text for _, text, _ in sorted(blocks))


def extract(pages: DataFrame, html_column: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(keys, text, n_chars)`` of every page; each page is read by itself, nothing is shuffled."""
    out = T.StructType([*[pages.schema[k] for k in keys], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(keys))]
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names
            )

    return pages.select(*keys, html_column).mapInArrow(run, out)
